"""Substring dedup, suffix dedup, near dedup and decontamination against brute force on small awkward tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lithic.llm import decontaminate, neardup, recompress, suffixes
from lithic.llm.common import ALNUM, NON_SPACE, Words, mix

SPACE = re.compile("[^\x20\x09-\x0d]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(seed=1, n=60):
    """Random texts with copies, shared passages, near copies, runs, tiny, empty and null texts, repeated rows."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["é", "Äa", "x"]
    passages = [" ".join(rng.choices(vocab, k=k)) for k in (49, 50, 51, 60, 75, 120, 200)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 150)))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        if i % 9 == 0:
            parts.append(("ab " * rng.choice([40, 55, 70, 130])).strip())
        if i % 10 == 3:
            parts.append("p q r " * 30)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    for i in range(0, n, 7):
        words = rows[i][1].split(" ")
        rows.append((n + i, rows[i][1]))
        if len(words) > 5:
            words[rng.randrange(len(words))] = "changed"
        rows.append((2 * n + i, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "  \n "), (903, "one two"), (903, "one two"), (904, rows[5][1]), (904, rows[5][1]), (None, rows[5][1]), (905, "a" * 5000), (906, "b " + "a" * 3000)]
    return rows


SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)


# ------------------------------------------------------------------ substring dedup
def brute_windows(rows, k=50):
    first = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        if i is not None:
            for p in range(len(w) - k + 1):
                g = tuple(w[p : p + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = set()
        if i is not None:
            for p in range(len(w) - k + 1):
                if first[tuple(w[p : p + k])] < i:
                    gone.update(range(p, p + k))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), sha(" ".join(kept))))
    return out


def as_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_substring_digest(spark, docs, rows):
    got = as_rows(recompress.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute_windows(rows), key=repr)
    assert sum(r[2] > 0 for r in got) > 20


@pytest.mark.parametrize("rounds", [0, 3, 16])
def test_substring_any_number_of_rounds(spark, docs, rows, rounds):
    got = as_rows(recompress.digest(docs, rounds=rounds, window=20), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute_windows(rows, 20), key=repr)


def test_substring_remove_cuts_the_text(spark, docs, rows):
    out = {(r.doc_id, i) for i, r in enumerate(recompress.remove(docs).collect())}
    assert len(out) == len(rows)
    kept = sorted(((r.doc_id, sha(" ".join(SPACE.findall(r.text or "")))) for r in recompress.remove(docs).collect()), key=repr)
    assert kept == sorted(((i, s) for i, _, _, s in brute_windows(rows)), key=repr)
    same = {r.doc_id: r.text for r in recompress.remove(docs).collect()}
    clean = [i for i, _, n, _ in brute_windows(rows) if n == 0 and i not in (None, 903, 904)]
    texts = dict(rows)
    assert all(same[i] == texts[i] for i in clean)


def test_substring_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert recompress.digest(empty).count() == 0
    assert recompress.remove(empty).columns == ["doc_id", "text", "lang"]


def test_symbols_are_alike_inside_equal_words():
    rng = np.random.default_rng(3)
    body = mix(rng.integers(0, 50, 300).astype(np.uint64))
    for _ in range(5):
        a = np.concatenate([mix(rng.integers(0, 50, 40).astype(np.uint64)), body])
        b = np.concatenate([mix(rng.integers(0, 50, 77).astype(np.uint64)), body])

        class One:
            pass

        names = []
        for h, skip in ((a, 40), (b, 77)):
            w = One()
            w.row, w.first, w.count = np.zeros(len(h), np.int64), np.array([0, len(h)]), np.array([len(h)])
            at, name = recompress.anchors(h, w)
            names.append(name[at >= skip])
        assert (names[0] == names[1]).all()


# ------------------------------------------------------------------ suffix dedup
def brute_bytes(rows, k):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = defaultdict(int)
    for _, t in texts:
        for p in range(len(t) - k + 1):
            count[t[p : p + k]] += 1
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - k + 1):
            if count[t[p : p + k]] > 1:
                gone[p] += 1
                gone[p + k] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, sha(bytes(np.frombuffer(t, np.uint8)[~gone]))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "gap", "range_bytes"), [(400, 128, 12 << 20), (400, 128, 20_000), (90, 30, 4_000), (60, 50, 3_000)])
def test_suffix_digest(spark, docs, rows, length, gap, range_bytes):
    got = as_rows(suffixes.digest(docs, length=length, gap=gap, range_bytes=range_bytes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(rows, length)


def morse(n, make, a, b):
    """Two sequences that share no longer part, equal under every odd base modulo a power of two: a and b swapped in Thue-Morse order."""
    x, y = make(), make()
    for i in range(n):
        one = bin(i).count("1") % 2
        x[i * (len(x) // n)], y[i * (len(x) // n)] = (a, b) if one else (b, a)
    return x, y


def test_structured_texts_are_not_taken_for_copies(spark):
    rng = random.Random(8)
    base = rng.choices(b"abcdefgh", k=16384)
    x, y = morse(64, lambda: list(base), ord("y"), ord("z"))
    docs = spark.createDataFrame([(1, bytes(x).decode()), (2, bytes(y).decode())], "doc_id long, text string")
    assert [r.n_removed for r in suffixes.digest(docs).collect()] == [0, 0]
    words = [f"w{k}" for k in rng.choices(range(40), k=4096)]
    x, y = morse(128, lambda: list(words), "y", "z")
    docs = spark.createDataFrame([(1, " ".join(x)), (2, " ".join(y))], "doc_id long, text string")
    assert [r.n_removed for r in recompress.digest(docs).collect()] == [0, 0]


def test_suffixes_of_a_passage_that_very_many_share(spark):
    """Range bounds split equal suffixes, and whole texts of several chunks are read."""
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    rows = [(i, "".join(rng.choices("ijklmnop ", k=300)) + passage + "".join(rng.choices("qrstuv", k=100))) for i in range(80)]
    rows += [(100, "".join(rng.choices("abcdefgh ", k=2_300_000))), (101, None)]
    rows += [(102, rows[80][1][1_200_000:1_200_900] + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = as_rows(suffixes.digest(docs, range_bytes=6000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    short = [r for r in rows if r[0] != 100] + [(100, rows[80][1][1_190_000:1_210_000])]
    want = {r[0]: r for r in brute_bytes(short, 400)}
    assert all(r == want[r[0]] for r in got if r[0] != 100)
    assert [r[2] for r in got if r[0] == 100] == [want[100][2]]


def test_windows_of_several_chunks(spark):
    rng = random.Random(10)
    long_ = " ".join(f"w{rng.randrange(10**6)}" for _ in range(330_000))  # over two chunks
    words = long_.split(" ")
    rows = [(5, long_), (7, " ".join(["own", *words[200_000:200_090], "words"])), (9, " ".join(words[100:149]))]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, _id string, copy string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in recompress.digest(docs).collect()}
    assert got == {5: (330_000, 0), 7: (92, 90), 9: (49, 0)}
    out = recompress.remove(docs)
    assert out.columns == docs.columns
    cut = {r.doc_id: (r.text, r["_id"], r.copy) for r in out.collect()}
    assert cut == {5: (long_, "a", "b"), 7: ("own words", "a", "b"), 9: (rows[2][1], "a", "b")}


def test_suffix_empty_table(spark):
    assert suffixes.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merge_is_a_merge():
    rng = random.Random(5)
    for runs in (1, 2, 3, 7):
        keys = [sorted("".join(rng.choices("ab", k=rng.randint(0, 9))).encode() for _ in range(rng.randint(0, 40))) for _ in range(runs)]
        coded = []
        for k in keys:
            shared, rest, raw = suffixes.front_code(k)
            coded.append(suffixes._decoded(shared.tobytes(), rest.tobytes(), raw))
        out = list(suffixes.merge(coded))
        assert [k for _, _, k in out] == sorted(x for k in keys for x in k)
        for (_, _, a), (_, h, b) in zip(out, out[1:], strict=False):
            assert h == suffixes.common_prefix(a, b)


# ------------------------------------------------------------------ near dedup
def brute_components(rows, percent=75):
    sets = defaultdict(set)
    size = {}
    for i, t in rows:
        w = SPACE.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        s = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())
        size.setdefault(i, len(s))
        if i is not None:
            sets[i] = s
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return sorted(((i, size[i], root(i) if i is not None else None, i is None or root(i) == i) for i, _ in rows), key=repr)


@pytest.mark.parametrize("small", [64, 2])
def test_near_dedup(spark, docs, rows, small):
    got = as_rows(neardup.find(docs, small=small), "doc_id", "n_shingles", "component_id", "kept")
    want = brute_components(rows)
    assert got == want


def test_near_dedup_of_a_large_group(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = [(5, " ".join(base))]
    for i in range(80):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(1000 + i, " ".join(rng.choices([f"v{k}" for k in range(5000)], k=80))) for i in range(40)]
    out = {r.doc_id: r.component_id for r in neardup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[100 + i] == 5 for i in range(80))
    assert all(out[1000 + i] == 1000 + i for i in range(40))


def components_of(spark, rows):
    return sorted((r.doc_id, r.component_id) for r in neardup.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def test_near_dedup_of_short_documents_sharing_a_line(spark):
    """Longer documents at the smallest ids share the line too, so that stars with the smallest id link nothing."""
    rng = random.Random(4)
    line = " ".join(f"l{i}" for i in range(11))
    rows = [(i, f"{line} " + " ".join(f"a{i}x{k}" for k in range(rng.randint(5, 15)))) for i in range(400)]
    rows += [(500 + i, f"{line} own{i}") for i in range(250)]
    rows += [(800 + i, f"{line} two{i} more{i}") for i in range(60)]
    assert components_of(spark, rows) == sorted((i, c) for i, _, c, _ in brute_components(rows))


def test_near_dedup_keeps_one(spark, docs, rows):
    want = {i for i, _, _, kept in brute_components(rows) if kept}
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == want


def test_near_dedup_of_one_id_with_two_texts_and_clashing_columns(spark):
    rng = random.Random(6)
    a, b = (" ".join(rng.choices([f"v{k}" for k in range(5000)], k=80)) for _ in "ab")
    rows = [(1, a), (2, b), (3, a + " tail"), (3, b + " tail"), (4, "own words only here"), (None, a)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _gone string, gone string")
    assert dict(sorted({(r.doc_id or 0, r.component_id) for r in neardup.find(docs).collect()})) == {0: None, 1: 1, 2: 1, 3: 1, 4: 4}
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r["_gone"], r.gone) for r in out.collect()) == [(0, "x", "y"), (1, "x", "y"), (4, "x", "y")]


def test_near_dedup_of_a_template_whose_copies_differ_much(spark):
    """Large nodes that branching does not thin out: many members below the threshold, some linked among each other only."""
    rng = random.Random(7)
    base, rows = [f"b{i}" for i in range(150)], []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8, 12])):
            w[rng.randrange(150)] = f"x{i}y{rng.randrange(9)}"
        rows.append((10 + i, " ".join(w)))
        if i % 10 == 0:  # a near copy of a far one
            w[rng.randrange(150)] = "z"
            rows.append((1000 + i, " ".join(w)))
    assert components_of(spark, rows) == sorted((i, c) for i, _, c, _ in brute_components(rows))


def test_intersections_all_at_once():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120))).astype(np.uint64) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    assert len(i) > 8 * len(sets)
    assert neardup._common(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def test_near_dedup_empty_table(spark):
    assert neardup.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    got = dict(neardup.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


# ------------------------------------------------------------------ decontamination
def brute_hits(docs, items, n=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = {c: c + 32 for c in range(65, 91)}
    windows = defaultdict(set)
    for item, t in items:
        w = word.findall((t or "").translate(low))
        for p in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[p : p + n])].add(item)
    out = []
    for i, t in docs:
        w = word.findall((t or "").translate(low))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                g = tuple(w[p : p + size])
                if g in windows:
                    hit.update(range(p, p + size))
                    found |= {x for x in windows[g] if x is not None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t in rows if t and len(t.split()) > 40]
    out = [(i, " ".join(t.upper().split()[7 : 7 + 9 + i])) for i, t in enumerate(texts[:12])]
    return out + [(50, "one"), (51, "TWO"), (52, ""), (53, None), (53, "absent words"), (None, "ab ab ab"), (2, out[2][1]), (54, "p q r p q r p q r p q")]


@pytest.mark.parametrize(("shard_bytes", "block_bytes", "wave_blocks"), [(4 << 20, 4 << 20, 16), (900, 4 << 20, 16), (2000, 300, 16), (2000, 300, 2), (900, 150, 1)])
def test_contamination(spark, rows, items, shard_bytes, block_bytes, wave_blocks):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = as_rows(decontaminate.digest(decontaminate.contamination(d, b, shard_bytes=shard_bytes, block_bytes=block_bytes, wave_blocks=wave_blocks)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute_hits(rows, items)


@pytest.mark.parametrize(("block_bytes", "wave_blocks"), [(4 << 20, 16), (300, 16), (300, 2)])
def test_decontaminate_cuts_what_is_hit(spark, rows, items, block_bytes, wave_blocks):
    numbered = [(k, i, t, "a", "b", "c") for k, (i, t) in enumerate(rows)]  # clashing names, repeated and null ids
    d, b = spark.createDataFrame(numbered, "k long, doc_id long, text string, _id string, spans string, `Row` string"), spark.createDataFrame(items, "item_id long, text string")
    result = decontaminate.decontaminate(d, b, block_bytes=block_bytes, wave_blocks=wave_blocks)
    assert result.columns == d.columns
    out = {r.k: r for r in result.collect()}
    assert len(out) == len(rows) and all(r.spans == "b" and r["_id"] == "a" for r in out.values())
    for k, (_, text) in enumerate(rows):
        (_, n, hit, _, _, any_hit), text_out = brute_hits([(k, text)], items)[0], out[k].text
        if not any_hit:
            assert text_out == text
        else:
            assert Words(np.frombuffer(text_out.lower().encode(), np.uint8), np.array([0, len(text_out.encode())]), ALNUM).count[0] == n - hit


def test_contamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("size(spans) > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_all_blocks_of_phrases_pass_one_index_in_one_scan(spark, rows, items, monkeypatch):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    plan = decontaminate.contamination(d, b, block_bytes=150)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "parquet" not in plan
    built = []
    monkeypatch.setattr(decontaminate, "FMIndex", lambda *a, index=decontaminate.FMIndex: built.append(1) or index(*a))
    blocks = [decontaminate.Phrases([item]) for item in items]
    wave, shard = decontaminate.Wave(blocks), decontaminate.Shard()
    for _, text in rows:
        raw = (text or "").encode()
        shard.add(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), wave)
    assert len(list(shard.hits(wave))) > 2 and len(built) == 1


def test_words_match_the_pattern():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab \n\té\x0b\x0cZ", k=rng.randint(0, 30))) for _ in range(50)] + ["", "", " "]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = Words(data, offs, NON_SPACE)
    got = [[data[a:b].tobytes().decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [SPACE.findall(t) for t in texts]
