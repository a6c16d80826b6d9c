"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt once into shards of bounded size by a hash of their id and
written.  Queries go in blocks of bounded size, each broadcast to one scan of
the shards.  A shard has one list per dimension, sorted by value; a query reads
each list from its high end where its own component is positive and from its
low end where it is negative.  Depth by depth all rows that any list shows are
scored in full, and a query stops when the best score that an unseen row could
have - the sum of its components times the values at that depth - is below its
k-th score.  A task carries the k best of each query from shard to shard, so
later shards begin with a bound; the k best of the tasks are merged per query.

Scores are exact: components are integers, and their products are summed as
float64 below 2**53 (float32 where 2**24 suffices).  Vectors too large for that
are kept apart, as candidates and as queries: their scores are bracketed in
float64 and settled in Python's integers where a bracket reaches the k-th score.
A component, and a score, beyond the range of a long is the end of that range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop, together

K = 20
SHARD_ROWS = 8192
BLOCK_ROWS = 65536
#: Queries that are scored at once against the rows of a shard.
STEP = 512
FIRST_DEPTH = 32
LONGEST = (1 << 63) - 1


def quantized(vectors: DataFrame, vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Rows whose vector has no null and no non-finite component, as array<long> `v` of floor(scale * x)."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    ok = F.col(vec_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    y = lambda c: c * F.lit(scale)
    # the largest double below 2**63 fits a long
    whole = lambda c: F.when(y(c) >= F.lit(2.0**63), F.lit(LONGEST)).when(y(c) < F.lit(-(2.0**63)), F.lit(-LONGEST - 1)).otherwise(F.floor(F.least(F.greatest(y(c), F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))).cast("long"))
    return vectors.where(F.coalesce(ok, F.lit(False))).withColumn("v", F.transform(x, whole))


class SortedLists:
    """One list per dimension over the rows of a shard: values ascending, and the row of each."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, axis=0)


class Best:
    """The k best of each query so far: scores, and ids that break ties."""

    def __init__(self, queries: int, k: int):
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def rows(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.score > -np.inf)
        return query_ids[at], self.id[at, place], self.score[at, place].astype(np.int64)


def threshold_topk(ids: np.ndarray, lists: SortedLists, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, best: Best, first: int = 0) -> int:
    """Bring the rows of a shard other than a query's own into `best`, where these queries begin at `first`; gives how many scores were computed."""
    n = len(rows)
    high, low = np.maximum(queries, 0), np.minimum(queries, 0)
    best_score, best_id = best.score[first : first + len(queries)], best.id[first : first + len(queries)]
    seen = np.zeros(n, bool)
    live, depth, done, scored = np.arange(len(queries)), min(FIRST_DEPTH, n), 0, 0
    while len(live) and n:
        shown = np.unique(np.concatenate([lists.order[done:depth].ravel(), lists.order[n - depth : n - done].ravel()]))
        new = shown[~seen[shown]]
        seen[new] = True
        if len(new):
            score = (queries[live] @ rows[new].T).astype(np.float64)
            scored += score.size
            score[query_ids[live][:, None] == ids[new][None, :]] = -np.inf
            kth = best_score[live, k - 1]
            if len(new) > 4 * k:  # all that reach the k-th score, ties included, then only those
                kth = np.maximum(np.partition(score, len(new) - k, axis=1)[:, len(new) - k], kth)
            at, col = np.nonzero((score >= kth[:, None]) & (score > -np.inf))
            if len(at):
                some, at = np.unique(at, return_inverse=True)  # queries with something new
                old_at, old_col = np.nonzero(best_score[live[some]] > -np.inf)
                score_at = np.concatenate([best_score[live[some]][old_at, old_col], score[some[at], col]])
                id_at = np.concatenate([best_id[live[some]][old_at, old_col], ids[new[col]]])
                at = np.concatenate([old_at, at])
                order = np.lexsort((id_at, -score_at, at))
                at, id_at, score_at = at[order], id_at[order], score_at[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                keep = place < k
                best_score[live[some[at[keep]]], place[keep]] = score_at[keep]
                best_id[live[some[at[keep]]], place[keep]] = id_at[keep]
        if depth >= n or seen.all():
            break
        bound = high[live] @ lists.values[n - depth] + low[live] @ lists.values[depth - 1]
        live = live[bound >= best_score[live, k - 1]]  # an unseen row at the bound could still win a tie
        done, depth = depth, min(n, depth * 2)
    return scored


def _largest(rows: np.ndarray) -> np.ndarray:
    return np.abs(rows.astype(float)).max(axis=1, initial=0)


def _ordinary(rows: np.ndarray) -> np.ndarray:
    """Which vectors are so small that the product of any two of them is exact in float64."""
    return _largest(rows) ** 2 * max(1, rows.shape[1]) < 2**52


def _exact_type(rows: np.ndarray, queries: np.ndarray):
    return np.float32 if _largest(rows).max(initial=0) * _largest(queries).max(initial=0) * max(1, rows.shape[1]) < 2**24 else np.float64


def large_topk(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a query among rows of any size, scores as longs: those whose brackets reach the k-th score are settled in integers."""
    other = np.flatnonzero(ids != query_id)
    x, q = rows[other].astype(float), query.astype(float)
    rough, slack = x @ q, (np.abs(x) @ np.abs(q)) * (len(q) + 4) * 2.0**-52
    end = lambda v: np.clip(v, -(2.0**63), 2.0**63)
    low, high = end(rough - slack), end(rough + slack)
    kth = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
    whole = [int(c) for c in query]
    exact = []
    for i in np.flatnonzero(high >= kth).tolist():
        score = sum(a * b for a, b in zip((int(c) for c in rows[other[i]]), whole, strict=True))
        exact.append((-max(-LONGEST - 1, min(LONGEST, score)), int(ids[other[i]])))
    return [(-score, i) for score, i in sorted(exact)[:k]]


def _answers(given, k: int):
    """The k best of the task's shards for each query of the block: given has (ids, vectors) by dimension."""

    def run(batches):
        small = {dim: np.flatnonzero(_ordinary(queries)) for dim, (_, queries) in given.value.items()}
        best = {dim: Best(len(at), k) for dim, at in small.items()}
        rest: list[tuple[int, int, int]] = []  # of vectors that are too large for float64

        def settled(ids, rows, query_ids, queries, which):
            for q in which.tolist():
                rest.extend((int(query_ids[q]), i, score) for score, i in large_topk(ids, rows, int(query_ids[q]), queries[q], k))

        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column(1)[r].as_py()
                if dim not in best:
                    continue
                ids = batch.column(2)[r].values.to_numpy()
                rows = np.frombuffer(batch.column(3)[r].as_buffer(), "<i8").reshape(len(ids), dim)
                query_ids, queries = given.value[dim]
                fits = _ordinary(rows)
                if not fits.all():
                    settled(ids[~fits], rows[~fits], query_ids, queries, small[dim])
                if len(small[dim]) < len(queries):
                    settled(ids, rows, query_ids, queries, np.setdiff1d(np.arange(len(queries)), small[dim]))
                ids, rows, query_ids, queries = ids[fits], rows[fits], query_ids[small[dim]], queries[small[dim]]
                kind = _exact_type(rows, queries)
                rows = rows.astype(kind)
                lists = SortedLists(rows)
                for a in range(0, len(queries), STEP):
                    threshold_topk(ids, lists, rows, query_ids[a : a + STEP], queries[a : a + STEP].astype(kind), k, best[dim], a)
        for dim, found in best.items():
            query_id, ids, score = found.rows(given.value[dim][0][small[dim]])
            for a in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (query_id, ids, score)], ["query_id", "vec_id", "score"])
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rest], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def _packed(batches):
    """The rows of a shard into one row with its ids and its vectors as bytes."""
    names, held = None, {}
    for batch in batches:
        names = batch.schema.names
        flat = batch.column(3)
        off = flat.offsets.to_numpy()
        values = flat.values.to_numpy(zero_copy_only=False).astype("<i8")
        part, dim, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for key in sorted(set(zip(part.tolist(), dim.tolist(), strict=True))):
            rows = np.flatnonzero((part == key[0]) & (dim == key[1]))
            got = held.setdefault(key, ([], []))
            got[0].append(ids[rows])
            got[1].append(b"".join(values[off[i] : off[i + 1]].tobytes() for i in rows))
    if names:
        for (part, dim), (ids, vecs) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([b"".join(vecs)], pa.binary())],
                ["part", "dim", "ids", "vecs"],
            )


def _block(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a block of queries, by dimension, in id order."""
    found = rows.select("id", F.size("v").alias("dim"), "v").toArrow().sort_by("id").combine_chunks()
    ids, dims = found.column("id").to_numpy(), found.column("dim").to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        flat = found.column("v").take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        out[dim] = ids[at], flat.reshape(len(at), dim)
    return out


def topk(
    vectors: DataFrame, queries: DataFrame, *, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products over all vectors but its own id.

    Vectors that are null or hold a null or non-finite component take no part,
    as query or as candidate; nor do rows with a null id.  A query is compared
    with candidates of its own dimension only.  Ties go to the smaller id; of
    repeated candidate rows each counts, and repeated query rows are answered
    once (the smallest vector, where they differ).  Components and scores beyond
    the range of a long are the end of that range, and such scores are ties.
    Empty inputs give no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    cand = quantized(vectors.where(F.col(id_col).isNotNull()), vec_col, scale).select(F.col(id_col).cast("long").alias("id"), "v")
    asked = quantized(queries.where(F.col(id_col).isNotNull()), vec_col, scale).select(F.col(id_col).cast("long").alias("id"), "v")
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    parts = max(1, -(-vectors.count() // shard_rows))
    dealt = cand.select(F.pmod(F.xxhash64("id", "v", F.lit(17)), F.lit(parts)).alias("part"), F.size("v").alias("dim"), "id", "v")
    shards = cut(dealt.repartition(parts, "part").mapInArrow(_packed, "part long, dim int, ids array<long>, vecs binary"), "shards")
    blocks = max(1, -(-queries.count() // block_rows))
    if blocks > 1:
        asked = cut(asked, "asked")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    answers = []
    for b in range(blocks):  # a stated query set in blocks against all shards
        block = _block(asked.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(blocks)) == b) if blocks > 1 else asked)
        found = shards.mapInArrow(_answers(spark.sparkContext.broadcast(block), k), "query_id long, vec_id long, score long")
        best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return best
        answers.append(cut(best, "answers"))
    drop(asked, shards)
    return together(answers)
