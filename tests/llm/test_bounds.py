"""What must not hang on neighbours, repetition, size or number: features, samples, scores of large vectors, near copies of one template."""

import random
import resource

import numpy as np
from pyspark.sql import functions as F

from lithic.llm import language, neardup, quality, topk


# ------------------------------------------------------------------ quality, language
def test_features_alone_and_in_company():
    rng = random.Random(2)
    texts = ["hello there.", ". tail words", "!!", "!", "", "!x", "a!!", "a", " ", "\n", "\nx", *("".join(rng.choice("ab.! \n") for _ in range(rng.randrange(8))) for _ in range(200))]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    together = quality.features(np.frombuffer(b"".join(raw), np.uint8), offs)
    for k, r in enumerate(raw):
        alone = quality.features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.array_equal(alone[0], together[k]), texts[k]


def test_scores_do_not_hang_on_partitions(spark):
    rows = [(i, ("good calm words. " if i % 2 else "!!! BAD *** ") * (1 + i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = []
    for n in (1, 7):
        model = quality.fit(docs.repartition(n), labels.repartition(n), pairs=2000)
        got.append(sorted(map(tuple, quality.score(docs.repartition(n), model).select("doc_id", "score", "predicted").collect())))
    assert got[0] == got[1]


def test_samples_of_repeated_ids_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the one text", "en")] * 6000 + [(2, "another", "fr"), (None, "no id", "de")] + [(None, f"null {i}", "en") for i in range(50)], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_pairs", lambda x, label, *a: seen.append(len(x)))
    quality.fit(docs, labels)
    assert seen == [2]
    monkeypatch.setattr(language, "train", lambda x, y, langs, seed: seen.append((len(x), langs)))
    language.fit(docs)
    n, langs = seen[-1]
    assert langs == ["de", "en", "fr"] and 2 <= n <= 53  # each distinct text once at most


# ------------------------------------------------------------------ top-k
def test_vectors_of_any_finite_size(spark):
    rng = random.Random(6)
    kinds = [lambda: rng.uniform(-2, 2), lambda: rng.uniform(-1e9, 1e9), lambda: rng.choice([1e300, -1e300, 2.0**57, -(2.0**57)]), lambda: rng.choice([0.0, 1e17])]
    rows = [(i, [kinds[i % 4]() if rng.random() < 0.7 else 0.0 for _ in range(3)]) for i in range(160)] + [(900, [1e9, 1e9, 1e9]), (901, [1e9, 1e9, 1e9]), (902, None), (903, [float("inf"), 0.0, 0.0]), (904, [1e18])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    lo, hi = -(2**63), 2**63 - 1
    clip = lambda v: max(lo, min(hi, v))
    import math

    whole = {i: [clip(math.floor(64 * x)) if abs(x) < 1e290 else (hi if x > 0 else lo) for x in v] for i, v in rows if v and all(map(math.isfinite, v))}
    want = set()
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:20])}
    got = topk.topk(df, df.where("vec_id % 20 = 0"), shard_rows=50)
    assert {tuple(r) for r in got.collect()} == want


# ------------------------------------------------------------------ near copies
def template(n, seed=1, common=16, last=4, choices=60):
    rng = random.Random(seed)
    head = " ".join(f"w{k}" for k in range(common))
    return [head + " " + " ".join(f"v{k}x{rng.randrange(choices)}" for k in range(last)) for _ in range(n)]


def brute(texts, percent=75):
    sets = [set(neardup.set_of(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_an_index_of_rare_tokens_joins_what_all_pairs_join():
    for seed in range(6):
        texts = template(150, seed, common=seed * 4, last=5, choices=3 + seed)
        sets = [neardup.set_of(t) for t in texts]
        n = np.array([len(s) for s in sets])
        side = np.array([(k % 2) + 1 if seed % 2 else 0 for k in range(len(sets))])
        component = np.arange(len(sets)) // (1 + seed % 3)
        x = neardup._Rows([np.zeros(len(sets), np.int64), side, np.arange(len(sets)), component, n, n, *[np.zeros(len(sets), np.int64)] * 3])
        off = np.concatenate([[0], np.cumsum(n)])
        links = list(neardup._joined(x, 0, len(sets), np.concatenate(sets), off, 75))
        label = {int(c): int(c) for c in component}

        def find(c, label=label):
            while label[c] != c:
                c = label[c]
            return c

        ok = lambda i, j: side[i] != side[j] or side[i] == 0
        every = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if ok(i, j) and (c := len(np.intersect1d(sets[i], sets[j]))) and 100 * c >= 75 * (n[i] + n[j] - c)]
        assert set(links) <= set(every)
        roots = []
        for some in (links, every):
            label.update({c: c for c in label})
            for i, j in some:
                a, b = sorted((find(int(component[i])), find(int(component[j]))))
                label[b] = a
            roots.append([find(int(c)) for c in component])
        assert roots[0] == roots[1]
        joins = len(set(component.tolist())) - len(set(roots[1]))
        assert len(links) == joins


def test_many_short_copies_of_a_template(spark):
    texts = template(1200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.find(df, small=16).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 4_000_000


def test_the_pipeline_gives_python_small_batches(spark):
    import pyarrow as pa

    import corpus_pipeline

    before = spark.conf.get(corpus_pipeline._ROWS)
    try:
        docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
        corpus_pipeline.STAGES[2][1](spark, docs, "")
        sizes = spark.range(0, 9000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) <= corpus_pipeline.ARROW_ROWS
    finally:
        spark.conf.set(corpus_pipeline._ROWS, before)


def test_a_lean_task_gives_its_memory_back():
    import os

    from lithic.llm.common import lean

    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    left = []

    def run(batches):
        for n in batches:
            held = [bytes(50_000) + b"x" for _ in range(n)]
            left.append(held.pop())  # the last piece stands above all others, so the heap does not shrink by itself
            yield len(held)

    before = resident()
    assert list(lean(run)([4000])) == [3999]
    assert resident() - before < 60
