"""Chat formatting, classifiers, mixing, URL rules and top-k on small awkward tables."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.llm import chat, language, mixing, quality, topk, urls
from lithic.llm.common import Words, mix


# ------------------------------------------------------------------ chat
def test_template_is_reversible(spark):
    nasty = ["", "a\\n<|im_end|>\n<|im_start|>user\nx", "\\", "\\<|", "<\\|", "\n", "<|im_start|>assistant ok", "ends in \\", "<|<|", "é\u2028"]
    rows = [(i % 3, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a\nb", "<|x") for t in nasty)]
    df = spark.createDataFrame(rows + [(9, 1, None, None), (None, 1, "user", "q")], "conv_id long, turn long, role string, text string")
    out = {r.key: r for r in chat.format_trees(chat.linear_messages(df)).collect()}
    for k in range(3):
        want = [(r, t) for c, _, r, t in rows if c == k]
        assert chat.parse(out[f"={k}"].formatted) == want
        assert chat.masked_text(out[f"={k}"].formatted, [(s.start, s.length) for s in out[f"={k}"].loss_spans]) == "".join(t for r, t in want if r == "assistant")
    assert chat.parse(out["=9"].formatted) == [("", "")]
    assert chat.parse(out["null"].formatted) == [("user", "q")]


def test_ties_and_repeats_are_turns(spark):
    df = spark.createDataFrame([(1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (1, None, "system", "s")], "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.linear_messages(df)).collect()
    assert [t for _, t in chat.parse(out[0].formatted)] == ["s", "a", "a", "b"]
    assert chat.format_trees(chat.linear_messages(df.limit(0))).count() == 0


def test_trees_of_one_message(spark):
    """All messages are roots: nothing climbs, and the tables that hold them must not go."""
    rows = [(f"k{i}", 1, None, 1.0, "assistant", f"t{i}") for i in range(5)] + [("k0", 2, 77, 0.5, "user", "orphan"), (None, 1, None, 1.0, "user", "no key")]
    df = spark.createDataFrame(rows, "key string, id long, parent long, score double, role string, text string")
    got = {r.key: chat.parse(r.formatted) for r in chat.format_trees(df).collect()}
    assert got == {f"k{i}": [("assistant", f"t{i}")] for i in range(5)}
    again = {(r.key, r.branch_rank): chat.parse(r.formatted) for r in chat.format_trees(df.unionByName(df), 2).collect()}
    assert again["k0", 2] == [("user", "orphan")] and len(again) == 6


def test_a_conversation_in_many_partitions(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}" * 3) for i in range(500)] + [(2, 0, "user", "x")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    out = {r.key: chat.parse(r.formatted) for r in chat.format_trees(chat.linear_messages(df), unique=True).collect()}
    assert out["=1"] == [(r, t) for _, _, r, t in rows[:500]] and out["=2"] == [("user", "x")] * 40


def brute_paths(nodes, n):
    kids, ids = {}, {i for i, _, _ in nodes}
    score = {i: s or 0.0 for i, _, s in nodes}
    for i, p, _ in nodes:
        kids.setdefault(p if p in ids else None, []).append(i)
    found = []

    def walk(i, path):
        path = [*path, i]
        if i in kids:
            for c in kids[i]:
                walk(c, path)
        else:
            found.append((-sum(score[x] for x in path) / len(path), -len(path), i, path))

    for r in kids.get(None, []):
        walk(r, [])
    return [x[3] for x in sorted(found)[:n]]


def test_trees_against_brute_force(spark):
    rng = random.Random(1)
    rows, trees = [], {}
    for key in ("a", "b", "c"):
        nodes = [(0, None, 1.0)]
        for i in range(1, 60):
            nodes.append((i, rng.choice([i - 1, i - 1, rng.randrange(i), 999 if i == 30 else i - 1]), rng.choice([None, *range(8)])))
        trees[key] = nodes
        rows += [(key, i, p, None if s is None else float(s), "user", f"t{i}") for i, p, s in nodes]
    rows += [("loop", 1, 2, 0.0, "user", "x"), ("loop", 2, 1, 0.0, "user", "y")]
    df = spark.createDataFrame(rows, "key string, id long, parent long, score double, role string, text string")
    got = {(r.key, r.branch_rank): [int(t[1:]) for _, t in chat.parse(r.formatted)] for r in chat.format_trees(df, 3).collect()}
    for key, nodes in trees.items():
        assert [got[key, k] for k in (1, 2, 3)] == brute_paths(nodes, 3)
    assert not [k for k in got if k[0] == "loop"]


# ------------------------------------------------------------------ quality
def test_quality_learns_and_scores_all(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), int(not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x y"), (902, "word " * 20000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where(~quality.held_out("doc_id", 3, 1)))
    out = quality.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    truth = {i: q for i, _, q in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.97
    again = quality.fit(docs.repartition(5), labels.where(~quality.held_out("doc_id", 3, 1)))
    assert np.allclose(model.weight, again.weight) and model.cut == again.cut


def test_quality_without_one_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for q, want in ((1, {1}), (0, {0})):
        model = quality.fit(docs, spark.createDataFrame([(1, q)], "doc_id long, quality int"))
        assert {r.predicted for r in quality.score(docs, model).collect()} == want
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.predicted for r in quality.score(docs, model).collect()} == {1}
    with pytest.raises(ValueError):
        quality.score(docs.withColumn("score", F.lit(1)), model)


def test_pairs_order_documents():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    m = quality.fit_pairs(x, y, pairs=5000)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.97
    assert 0.4 < m.quantile < 0.6


def brute_features(text):
    raw = text.encode()
    low = raw.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", low) if w]
    grams = [raw[i : i + 4] for i in range(len(raw) - 3)]
    one = lambda x: int(Words(np.frombuffer(x, np.uint8), np.array([0, len(x)]), np.ones(256, bool)).hashes(np.frombuffer(x, np.uint8))[0])
    out = np.zeros(quality.WIDTH)
    for w in words:
        out[one(w) >> 54] += 1 / len(words)
    for g in grams:
        out[1024 + (int(mix(np.array([int.from_bytes(g, "little")], np.uint64))[0]) >> 54)] += 1 / len(grams)
    out[:2048] = np.sqrt(out[:2048])
    mark = [33 <= x < 127 and not chr(x).isalnum() for x in raw]
    n, k = max(len(raw), 1), max(len(words), 1)
    out[2048:] = [
        sum(65 <= x < 91 for x in raw) / n, sum(48 <= x < 58 for x in raw) / n, sum(mark) / n, sum(m and raw[i] == raw[i - 1] for i, m in enumerate(mark) if i) / n, raw.count(10) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k, len(set(words)) / k, np.log1p(len(raw)) / 10, np.log1p(len(words)) / 10, float(not words),
    ]
    return out


def test_quality_features_against_plain_python():
    texts = ["", "a", "A b b  B!!\n11", "abc", "é Ä!! ñ", " \t ", "word " * 300, "xyzz, xyzz; XYZZ", "a\n\nb\n"]
    raw = [t.encode() for t in texts]
    got = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert np.allclose(got, [brute_features(t) for t in texts], atol=1e-6)


# ------------------------------------------------------------------ language
def test_language(spark):
    rng = random.Random(7)
    parts = {"aa": ["ka", "ro", "mi", "te"], "bb": ["sch", "ung", "ä", "cht"], "cc": ["ción", "ñ", "la", "el"]}
    text = lambda k, n: " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(n))
    rows = [(i, text(k, rng.randint(1, 200)), k) for i, k in enumerate(rng.choices(list(parts), k=600))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 -- 99", "bb"), (903, text("bb", 9000), None), (904, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(docs.where(~quality.held_out("doc_id", 5, 0)), sample=300)
    out = {r.doc_id: r for r in language.predict(docs, net).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert out[903].lang_pred == "bb" and out[904].lang_pred in parts
    held = [i for i, t, k in rows[:600] if len(t) > 30]
    assert np.mean([out[i].lang_pred == rows[i][2] for i in held]) > 0.97
    again = {r.doc_id: r.score for r in language.predict(docs.repartition(7), net).collect()}
    assert all(abs(again[i] - out[i].score) < 1e-5 for i in again)  # a text's score does not hang on its neighbours
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_folded_tables_against_the_trained_network():
    """Applying the network by tables of byte pairs gives what its training pass gives on the same windows."""
    rng = np.random.default_rng(3)
    net = language.train(rng.integers(97, 123, (40, language.WINDOW)).astype(np.uint8), rng.integers(0, 3, 40), ["a", "b", "c"], epochs=1)
    raw = [b"", b"x", b"hello world", bytes(rng.integers(0, 256, 256).astype(np.uint8)), bytes(rng.integers(97, 123, 1000).astype(np.uint8))]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    x, row, own = language.windows_of(data, offs)
    pieces = [r[k : k + language.WINDOW] for r in raw for k in range(0, max(1, len(r)), language.WINDOW)]
    assert [bytes(w) for w in x] == [p.ljust(language.WINDOW, b" ") for p in pieces] and own.tolist() == [len(p) for p in pieces]
    hidden, _ = language._forward(net, x)
    want = net.log_softmax(np.maximum(np.concatenate(hidden, 1), 0))
    assert np.allclose(net.log_softmax(net.pooled(x)), want, atol=1e-4)
    langs, score = language._chunk(net, data, offs)
    for i, r in enumerate(raw):
        mean = (want[row == i] * own[row == i][:, None]).sum(0) / max(len(r), 1)
        p = np.exp(mean) / np.exp(mean).sum()
        assert score[i] == pytest.approx(p.max(), abs=1e-4) and langs[i] == "abc"[p.argmax()]


# ------------------------------------------------------------------ mixing
def water_fill(sizes, weights, total, cap=2):
    """Targets one after the other: those above their caps stop there, the rest is shared again."""
    target, open_, left = [Fraction(0)] * len(sizes), [i for i, w in enumerate(weights) if w > 0], Fraction(total)
    while open_:
        all_w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / all_w > cap * sizes[i]]
        for i in over or open_:
            target[i] = Fraction(cap * sizes[i]) if over else left * weights[i] / all_w
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return target


def plain_targets(per_source, weights=(5, 2, 1), share=Fraction(3, 2)):
    ordered = sorted(per_source, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in ordered]
    return [(*r, t) for r, t in zip(ordered, water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes)), strict=True)]


def plain_quotas(sources, shards, block):
    """(source, shard) -> (blocks, quota) in exact fractions."""
    blocks = {(s, k): -(-w // block) for s, k, w in shards}
    each = [sum(b for (x, _), b in blocks.items() if x == s) for s, _, _ in sources]
    votes = [t * b / n if n else Fraction(0) for (_, n, t), b in zip(sources, each, strict=True)]
    seats = mixing.sainte_lague(votes, int(sum(votes) + Fraction(1, 2)))
    out = {}
    for (s, _, _), q in zip(sources, seats, strict=True):
        mine = sorted(k for x, k in blocks if x == s)
        out |= {(s, k): (blocks[s, k], g) for k, g in zip(mine, mixing.shard_quotas([blocks[s, k] for k in mine], q), strict=True)}
    return out


def test_taken_against_a_walk_over_blocks(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice("ab")) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kw = {"shard_words": 900, "block": 16, "seed": 3}
    out = {r.doc_id: r for r in mixing.mix(docs, **kw).collect()}
    salt = F.xxhash64("source")
    dealt = [F.pmod(F.xxhash64("doc_id", F.lit(3), salt), F.lit(-(-out_size(out, rows, s) // 900))) for s in "ab"]
    hashed = docs.select("doc_id", F.xxhash64("doc_id", F.lit(4)).alias("o"), *[d.alias(s) for d, s in zip(dealt, "ab", strict=True)])
    hashed = hashed.collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    shards = {}
    for r in sorted(hashed, key=lambda r: (r.o, r.doc_id)):
        shards.setdefault((source[r.doc_id], r[source[r.doc_id]]), []).append(r.doc_id)
    targets = plain_targets([(s, out_size(out, rows, s)) for s in "ab"])
    plan = plain_quotas(targets, [(s, k, sum(size[i] for i in ids)) for (s, k), ids in shards.items()], 16)
    for (s, k), (blocks, quota) in plan.items():
        words = sum(size[i] for i in shards[s, k])
        h = spark.sql(f"SELECT xxhash64(xxhash64('{s}'), {k}L, 3) h").first().h
        start = h % max(1, blocks)
        times = [quota // max(1, blocks)] * blocks
        for b in range(blocks):  # evenly spread from a seeded start
            times[b] += ((b + 1) * (quota % max(1, blocks)) + start) // max(1, blocks) - (b * (quota % max(1, blocks)) + start) // max(1, blocks)
        assert sum(times) == quota and max(times, default=0) <= 2
        line = [i for i in shards[s, k] for _ in range(size[i])]
        assert len(line) == words
        want = {i: 0 for i in shards[s, k]}
        for p, i in enumerate(line):
            want[i] += times[p // 16]
        assert {i: out[i].taken for i in want} == want
    for s, words, target in targets:
        assert abs(sum(r.taken for i, r in out.items() if source[i] == s) - target) <= 40


def out_size(out, rows, s):
    return sum(len(t.split()) for _, t, x in rows if x == s)


def given(spark, targets, shards):
    """Tables for `quotas` of (source, n, target) and (source, shard, words)."""
    place = {s: i for i, (s, _, _) in enumerate(targets)}
    sources = spark.createDataFrame([(place[s], n, float(t)) for s, n, t in targets], "place long, n long, target double")
    return sources, spark.createDataFrame([(place[s], k, w) for s, k, w in shards], "place long, shard long, words long")


def test_small_sources_reach_their_targets(spark):
    """A last block that covers little does not eat the quota of a small source."""
    sources = plain_targets([("a", 20), ("b", 40), ("c", 5000)], share=Fraction(2))
    got = {r.place: r for r in mixing.quotas(*given(spark, sources, [("a", 0, 20), ("b", 0, 40), ("c", 0, 5000)])).collect()}
    for i, (s, words, target) in enumerate(sources):
        assert abs(got[i].quota * words / got[i].blocks - target) <= words / got[i].blocks / 2 + 1, s


def test_quotas_of_very_many_sources_against_plain_code(spark):
    rng = random.Random(9)
    names = [None, *(f"s{i:04}" for i in range(699))]
    size = {s: rng.choice([0, 1, 7, 320, rng.randint(1, 4000), rng.randint(1, 200)]) for s in names} | {"s0003": 400_000}
    sources = plain_targets(list(size.items()))
    shards = [(s, k, w) for s, n in size.items() for k, w in enumerate([n] if n < 3000 else [n // 3, n - n // 3 - 7, 7])]
    table = spark.createDataFrame([(i, n, (5, 2, 1)[i % 3]) for i, (_, n, _) in enumerate(sources)], "place long, n long, w long")
    level = mixing.water_level(table, Fraction(3, 2) * sum(size.values()))
    assert [min((5, 2, 1)[i % 3] * level, Fraction(2 * n)) for i, (_, n, _) in enumerate(sources)] == [t for _, _, t in sources]
    got = {(sources[r.place][0], r.shard): (r.blocks, r.quota) for r in mixing.quotas(*given(spark, sources, shards)).collect()}
    assert got == plain_quotas(sources, shards, mixing.BLOCK)


def test_distributed_seats_are_by_highest_quotients(spark):
    rng = random.Random(2)
    for n, seats in ((1, 5), (9, 0), (9, 3), (60, 20), (60, 61), (300, 2000)):
        votes = [rng.choice([0, 1, 5, 5, rng.randint(0, 1000)]) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(votes)), "place long, v long").repartition(3)
        assert [r.seats for r in mixing.highest_quotients(df, seats).orderBy("place").collect()] == mixing.sainte_lague(votes, seats)
    assert mixing.highest_quotients(df.limit(0), 4).count() == 0


def test_sainte_lague_is_by_highest_quotients():
    rng = random.Random(1)
    for _ in range(60):
        votes, seats = [rng.choice([0, 1, 5, rng.randint(0, 1000)]) for _ in range(rng.randint(1, 9))], rng.randint(0, 60)
        got = mixing.sainte_lague(votes, seats)
        want = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            i = max(range(len(votes)), key=lambda k: (Fraction(votes[k], 2 * want[k] + 1), -k))
            want[i] += 1
        assert got == want


def test_water_fill_stops_at_caps(spark):
    for sizes, weights, total, want in (
        ([10, 100, 100], [5, 2, 1], 315, [20, 2 * Fraction(295, 3), Fraction(295, 3)]), ([0, 10], [5, 2], 15, [0, 15]), ([1, 2, 3], [5, 2, 1], 9, [2, 4, 3]),
    ):
        assert water_fill(sizes, weights, Fraction(total)) == want
        level = mixing.water_level(spark.createDataFrame(list(zip(sizes, weights, strict=True)), "n long, w long"), Fraction(total))
        assert [min(w * level, Fraction(2 * n)) for n, w in zip(sizes, weights, strict=True)] == want
    assert mixing.water_level(spark.createDataFrame([(1, 5), (2, 0)], "n long, w long"), Fraction(9)) is None


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "b", "B", None, "é"])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "z"), (5, "x y z", "b"), (5, "x y z", "b"), (None, "one two", "a"), (1002, "w " * 20000, "a")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, taken int")
    out = mixing.mix(docs, shard_words=4000).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    target = dict(zip(names, water_fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], Fraction(3, 2) * sum(size.values())), strict=True))
    by_id = {r.doc_id: r for r in out}
    for s in names:
        ids = [i for i, _, x in rows if x == s and i != 5]
        assert all(by_id[i].target == pytest.approx(float(target[s])) and by_id[i].source_size == size[s] for i in ids)
    total = {}
    for r in out:
        total[r.source_size, r.target] = total.get((r.source_size, r.target), 0) + r.taken
    assert all(abs(v - k[1]) <= max(64 * 8, 0.01 * k[1]) for k, v in total.items())
    assert sorted(map(repr, mixing.mix(docs.repartition(7), shard_words=4000).collect())) == sorted(map(repr, out))
    assert mixing.mix(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ urls
def test_host_path_and_given_rules(spark):
    cases = [
        (None, "", "", None), ("nothing", "", "", None), ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("https://x.www.example.com/en/a", "x.www.example.com", "/en/a", "www.example.com/en/"),
        ("ftp://com/", "com", "/", "com/"), ("http://a.com", "a.com", "", None), ("http://a.com?x=/", "a.com", "", None), ("http://notnet/es/", "notnet", "/es/", None),
        ("http://b.net/es/1", "b.net", "/es/1", "net/es/"), ("http://b.net/ES/1", "b.net", "/ES/1", None), ("x://y.net/fr/://z.com/", "y.net", "/fr/://z.com/", "net/fr/"), ("", "", "", None),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, (u, *_) in enumerate(cases)], "page_id long, url string, verdict string")
    out = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict in ("allow", "block")
        if rule:
            assert out[i].verdict == {f"{h}{p}": v for v, h, p in urls.RULES}[rule]
    assert urls.judge(df.limit(0)).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(4)
    sets = [(sorted(set(rng.choices("abcdef", k=3))), None) for _ in range(300)]
    sets = [(s, "a" in s and "b" in s or rng.random() < 0.1) for s, _ in sets]
    df = spark.createDataFrame(sets + [(None, True), (["a"], None)], "tokens array<string>, blocked boolean")
    found = {(tuple(r.needs), r.verdict): r for r in urls.mine(df, min_support=0.02, min_confidence=0.6).collect()}
    for (needs, verdict), r in found.items():
        have = [b for s, b in sets if set(needs) <= set(s)]
        hits = sum(b == (verdict == "block") for b in have)
        assert r.confidence == pytest.approx(hits / len(have)) and hits / len(sets) >= 0.02 and r.confidence >= 0.6 and r.rarest in needs
        assert not [k for k in found if k[1] == verdict and set(k[0]) < set(needs) and found[k].confidence >= r.confidence]
    matched = {tuple(r.tokens): r for r in urls.match(df.select("tokens").where("tokens is not null").distinct(), urls.mine(df, min_support=0.02, min_confidence=0.6), "allow").collect()}
    for tokens, r in matched.items():
        fits = [(x.confidence, len(k[0]), k[1] == "block") for k, x in found.items() if set(k[0]) <= set(tokens)]
        assert r.mined == (("block" if max(fits)[2] else "allow") if fits else "allow")


# ------------------------------------------------------------------ top-k
@pytest.mark.parametrize(("shard", "block", "scale"), [(1000, 1000, 64.0), (37, 5, 64.0), (64, 8, 4.0)])
def test_topk(spark, shard, block, scale):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 0.2, (300, 8))
    base[50:90] = base[3]  # copies: ties go to smaller ids
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(base)]
    bad = [(400, None, "x"), (401, [1.0, None] + [0.0] * 6, "x"), (402, [float("nan")] * 8, "x"), (403, [float("inf")] + [0.0] * 7, "x"), (None, [0.1] * 8, "x"), (420, [0.0] * 8, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank string")
    q = df.where("vec_id % 20 = 0")
    got = [tuple(r) for r in topk.topk(df, q, k=7, scale=scale, shard_rows=shard, block_rows=block).orderBy("query_id", "rank").collect()]
    ok = {i: np.floor(np.array(v, np.float32).astype(float) * scale).astype(int) for i, v, _ in [*rows, bad[-1]]}
    want = []
    for i in sorted(x for x in ok if x % 20 == 0):
        best = sorted((-int(ok[i] @ v), j) for j, v in ok.items() if j != i)[:7]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == want


def test_topk_of_few_and_of_nothing(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 0.5]), (1, [3.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in topk.topk(df, df.where("vec_id % 20 = 0")).orderBy("query_id").collect()] == [(0, 20), (20, 0)]
    assert topk.topk(df.limit(0), df).count() == 0
    assert topk.topk(df, df.limit(0)).count() == 0


def test_threshold_stops_early():
    rows = np.zeros((5000, 3), np.float32)
    rows[:, 0] = np.arange(5000)
    best = topk.Best(1, 5)
    ids, q = np.arange(5000), np.array([[1, 0, 0]], np.float32)
    scored = topk.threshold_topk(ids, topk.SortedLists(rows), rows, np.array([-1]), q, 5, best)
    _, found, score = best.rows(np.array([-1]))
    assert found.tolist() == [4999, 4998, 4997, 4996, 4995] and score.tolist() == found.tolist() and scored < 500
    # a later shard that is worse is left after its first depth; equal scores of smaller ids come in
    worse = topk.threshold_topk(ids + 5000, topk.SortedLists(rows / 2), rows / 2, np.array([-1]), q, 5, best)
    assert worse < 500 and best.rows(np.array([-1]))[1].tolist() == found.tolist()
    topk.threshold_topk(ids - 5000, topk.SortedLists(rows), rows, np.array([-1]), q, 5, best)
    assert best.rows(np.array([-1]))[1].tolist() == [4999, -2, 4998, -3, 4997]  # -1 is the query itself


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    passage, item = " ".join(rng.choices(vocab, k=70)), " ".join(rng.choices(vocab, k=30))
    rows = []
    for i in range(120):
        t = " ".join(rng.choices(vocab, k=200))
        if i % 20 == 1:
            t = f"{t} {passage}"
        if i % 30 == 2:
            t = f"{t} {item} end"
        if i % 6 == 3:
            t = " ".join(w.upper() + "!!" for w in t.split())
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(500, rows[0][1], "en", "s0", 1), (501, None, None, None, None), (502, rows[4][1] + " tail", "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 3), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    ids = {k: set(v) for k, v in seen.items()}
    assert not ids["quality"] & {i for i in range(120) if i % 6 == 3} and ids["quality"] >= {i for i in range(120) if i % 6 != 3}
    assert ids["near_dedup"] == ids["quality"] - {500, 502}
    with_passage = [i for i in range(120) if i % 20 == 1 and i % 6 != 3]
    assert [passage in seen["substring_dedup"][i].text for i in with_passage] == [True] + [False] * (len(with_passage) - 1)
    assert not any(item in (r.text or "") for r in seen["decontamination"].values())
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in seen["decontamination"].values())
    assert ids["mixing"] == ids["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids["mixing"]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    """Empty tables, nulls everywhere, repeated rows and columns whose names the stages use themselves."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, copy string, spans string, items string, doc_id_ string"
    rng = random.Random(4)
    text = " ".join(rng.choices([f"w{i}" for i in range(900)], k=120))
    odd = [(None, None), (None, ""), (1, None), (2, ""), (3, text), (3, text), (4, text), (5, text + " more"), (None, text), (6, " \n "), (7, "w " * 30_000)]
    more = ("en", None, 0, "a", "b", "c", "d", "e", "f")
    for name, rows in (("none", []), ("odd", [(*r, *more) for r in odd])):
        top = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
        spark.createDataFrame([(None, None), (1, "")] if rows else [], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
        docs = spark.read.parquet(f"{top}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, top)
            assert out.columns == docs.columns
            out.write.parquet(f"{top}/{stage}")
            docs = spark.read.parquet(f"{top}/{stage}")
        left = docs.collect()
        # one of the near copies stays; null ids, null and empty texts are no copies of anything
        assert sorted(repr((r.doc_id, len(r.text) if r.text is not None else None)) for r in left) == (
            sorted(repr((i, None if t is None else len(t))) for i, t in odd if i not in (4, 5)) if rows else []
        )
        assert all((r.score, r.predicted, r.copy, r.spans, r.items, r.doc_id_) == more[3:] for r in left)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, top).count() == len(left)
