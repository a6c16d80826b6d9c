"""Exact deduplication, tokenizer alignment and Merkle proofs against plain Python on small awkward tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.llm import align, exact, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------ exact
def brute_classes(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is not None, i or 0, i))
    return groups, norm


EXACT = [
    (5, "a b"), (3, "ab"), (9, "a  b"), (2, "a\tb\n"), (1, "ab c"), (4, None), (6, ""), (7, " \r\n\x0b\x0c"), (8, "é x"), (10, "éx"), (11, "éx"), (None, "ab"), (12, "a b"),
    (20, "x" * 300 + "1"), (21, "x" * 300 + "2"), (22, "x" * 150 + " " + "x" * 150 + "1"), (30, "long " * 50_000), (31, "long " * 50_000), (32, "long" * 50_000), (33, "once"),
]


@pytest.mark.parametrize("words", [1 << 19, 1])
def test_exact_classes(spark, words):
    """A filter of one word is full, which only costs work."""
    df = spark.createDataFrame(EXACT, "doc_id long, text string").repartition(3)
    groups, norm = brute_classes(EXACT)
    got = {r.doc_id: r for r in exact.classes(df, prefix=4, words=words).collect()}
    assert len(got) == len(EXACT)
    for i, t in EXACT:
        g = groups[norm(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(g)[3], len(g), min(g)[3] == i), (i, t)


def test_exact_repeats_clashes_and_empty(spark):
    rows = [(1, "same", 5, "p")] * 40 + [(1, "sa me", 6, "q"), (2, "same", 7, "r"), (3, "other", 8, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEPT int, _id string").repartition(5)
    out = exact.classes(df, carry=["KEPT", "_id"])
    assert out.columns == ["doc_id", "KEPT", "_id", "keep_id", "group_size", "kept_"]
    got = out.collect()
    assert len(got) == 43 and Counter(r["kept_"] for r in got) == {True: 2, False: 41}
    assert [r.KEPT for r in got if r["kept_"]] in ([6, 8], [8, 6]) and {r.group_size for r in got} == {42, 1}
    stays = exact.deduplicate(df)
    assert stays.columns == df.columns and sorted(map(tuple, stays.collect())) == [(1, "sa me", 6, "q"), (3, "other", 8, "s")]
    assert exact.classes(df.limit(0)).count() == 0


def test_exact_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc \n") for _ in range(rng.randrange(12))), "en", "s", 1) for i in range(300)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    groups, norm = brute_classes([(r[0], r[1]) for r in rows])
    for r in queries.op11_exact_dedup(spark, str(tmp_path)).collect():
        g = groups[norm(rows[r.doc_id][1])]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g)[3], len(g), min(g)[3] == r.doc_id, H(norm(rows[r.doc_id][1])))


# ------------------------------------------------------------------ alignment
PATHS = f"{align.TOKENIZERS}/byte_bpe_50k.json", f"{align.TOKENIZERS}/piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "\n\n\t x", "The quick brown fox", "The quick brown fox", "naïve café — 東京 🙂🙂", "a▁b", "<|endoftext|> and <s> </s> <unk> <0x0A>", "x\x00y", "word " * 20_000, "ﬁ ligature é", "1234567890" * 30,
    "   lead and trail   ", "tabs\tand\r\nlines", "  ", "ſtraße",
]


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    m = SentencePieceProcessor(model_file=PATHS[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain}
    for b in range(256):
        letter.setdefault(b, chr(256 + len([x for x in letter if letter[x] >= chr(256)])))
    back = {c: b for b, c in letter.items()}
    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + (text or ""), add_special_tokens=False).ids] if text else []
        b = []
        for i in m.encode(text) if text else []:
            p = m.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            out.append(None)
            continue
        ends = [list(zip(np.cumsum([len(x) for _, x in side]).tolist(), [i for i, _ in side], strict=True)) for side in (a, b)]
        common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups, links, at = [], [], [0, 0]
        for e in common:
            ids = []
            for s in (0, 1):
                got = []
                while at[s] < len(ends[s]) and ends[s][at[s]][0] <= e:
                    got.append(ends[s][at[s]])
                    at[s] += 1
                ids.append(got)
            groups.append(",".join(str(i) for _, i in ids[0]) + "|" + ",".join(str(i) for _, i in ids[1]))
            links += [(x, y) for ex, x in ids[0] for ey, y in ids[1] if ex == ey]
        out.append((len(a), len(b), len(common), links, ";".join(groups)))
    counts = Counter(p for o in out if o for p in o[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    zero = (0, 0, 0, 0, 0, 0, None)
    return [zero if o is None else (*o[:3], len(o[3]), sum(counts[p] == most[p[1]] for p in o[3]), sum(counts[p] for p in o[3]), o[4]) for o in out]


needs_files = pytest.mark.skipif(not all(map(os.path.exists, PATHS)), reason="no tokenizer files")


@needs_files
def test_alignment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK", 40)
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    want = brute_alignment(TEXTS)
    got = {r.doc_id: tuple(r)[1:] for r in align.align(df, keep=["doc_id"]).collect()}
    assert len(got) == len(rows)
    for k, w in enumerate(want):
        assert got[k] == w, (k, TEXTS[k][:50] if TEXTS[k] else TEXTS[k], got[k][:6], w[:6])
    assert sum(w[0] > 0 for w in want) >= 10 and want[7][0] == 0


@needs_files
def test_alignment_query_clashes_and_empty(spark, tmp_path):
    rows = [(i % 4, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(None, "x", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_alignment([r[1] for r in rows])
    got = queries.op12_token_alignment(spark, str(tmp_path)).collect()
    exp = [(r[0], *w[:6], "" if w[6] is None else H(w[6])) for r, w in zip(rows, want, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, exp))
    clash = align.align(df.withColumnRenamed("lang", "N_A").withColumnRenamed("source", "_chunk"), keep=["N_A", "_chunk"])
    assert clash.columns[:4] == ["N_A", "_chunk", "n_a_", "n_b"] and clash.count() == len(rows)
    assert align.align(df.limit(0), keep=["doc_id"]).count() == 0


@needs_files
def test_tokens_of_parts_are_those_of_the_whole():
    rng = random.Random(3)
    a, b = align.byte_level(PATHS[0]), align.piece_level(PATHS[1])
    assert a.cuts and b.cuts
    bits = ["a", "word", " ", " ", "  ", "\n", "\t", "é", "▁", "\x1c", "\x85", "\u3000", "1", "'s", ".", "東", "🙂", "<s>", "\u200b", "\xa0"]
    texts = ["".join(rng.choice(bits) for _ in range(1 + rng.randrange(12))) for _ in range(3000)]
    for x, y in zip(align.Parts(a, b).tokens(texts), align._whole(texts, a, b), strict=True):
        assert np.array_equal(x, y)


@needs_files
def test_overlap_links(spark):
    """All pairs that share a byte, against a double loop."""
    a, b = align.byte_level(PATHS[0]), align.piece_level(PATHS[1])
    for text in ("antidisestablishmentarianism", "東京 naïve"):
        counts, _, _, ia, ib = align.aligned([text], a, b, "overlap")
        spans = []
        for side in (a, b):
            end = np.cumsum(side.length[side.encode([text])[0]])
            spans.append(list(zip(np.r_[0, end[:-1]], end, side.encode([text])[0], strict=True)))
        want = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        assert list(zip(ia.tolist(), ib.tolist(), strict=True)) == want and counts[3][0] == len(want)


# ------------------------------------------------------------------ merkle
def brute_merkle(rows):
    """rows: (doc_id, source, leaf). {(position in rows): (subroot, root, siblings as a list of (left, right))}"""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    ways, subroots = {}, []

    def climb(nodes):
        """nodes: (digest, members). Adds the siblings of each level to the members' ways."""
        while len(nodes) > 1:
            up = []
            for k in range(0, len(nodes), 16):
                run = nodes[k : k + 16]
                for j, (_, members) in enumerate(run):
                    for x in members:
                        ways[x].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
                up.append((H(*[d for d, _ in run]), [x for _, m in run for x in m]))
            nodes = up
        return nodes[0]

    for s in sources:
        mine = sorted((k for k, r in enumerate(rows) if r[1] == s), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][2]))
        ways.update({k: [] for k in mine})
        subroots.append(climb([(rows[k][2], [k]) for k in mine]))
    sub = {x: d for d, members in subroots for x in members}
    root = climb(subroots)[0]
    return {k: (sub[k], root, ways[k]) for k in range(len(rows))}


def make_docs(sizes):
    rng, rows = random.Random(5), []
    for s, n in sizes.items():
        for _ in range(n):
            i = len(rows) * 7 % 1009
            rows.append((i, rng.choice(["Text A", "low", None, "", "É Ü x", "Zz " * 50]), rng.choice(["en", None]), s, rng.choice([1, None, -5])))
    return rows


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {"a": 16}, {"a": 17}, {None: 2, "b": 1, "a": 290, "é": 33}, {f"s{k}": 1 + k % 3 for k in range(40)}, {"one": 1, "two": 1}],
    ids=["lone", "full", "one more", "deep", "wide", "two lone"],
)
def test_merkle_query_equals_brute_force(spark, tmp_path, sizes):
    rows = make_docs(sizes)
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_merkle([(r[0], r[3], leaf(r, r[1])) for r in rows])
    exp = []
    for k, r in enumerate(rows):
        sub, root, way = want[k]
        tampered = zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if tampered else r[1]
        at = leaf(r, text)
        for left, right in way:
            at = H(left, at, right)
        exp.append((r[0], leaf(r, r[1]), sub, root, H(*[x + y for x, y in way]), at, at == root))
    got = [tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got) == sorted(exp)


def test_merkle_repeats_nulls_clashes_and_empty(spark):
    rows = [(1, "a", "L1", 3)] * 20 + [(None, "a", "L0", 4), (2, None, "L2", 5), (1, "a", "L0", 6)]
    df = spark.createDataFrame(rows, "id long, tree string, leaf string, ROOT int").repartition(3)
    out = merkle.proofs(df, "tree", "id", "leaf", ["ROOT"])
    assert out.columns == ["id", "tree", "leaf", "ROOT", "subroot", "root_", "path"]
    want = brute_merkle([(r[0], r[1], r[2]) for r in rows])
    exp = Counter((r[0], r[1], r[2], r[3], want[k][0], want[k][1], tuple(want[k][2])) for k, r in enumerate(rows))
    assert Counter((*tuple(r)[:6], tuple(map(tuple, r.path))) for r in out.collect()) == exp
    folded = out.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root_")).alias("ok")).distinct().collect()
    assert [r.ok for r in folded] == [True]
    assert merkle.proofs(df.limit(0), "tree", "id", "leaf").count() == 0
