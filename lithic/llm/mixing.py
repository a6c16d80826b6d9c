"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Per source: its words, its weight, and so its target (water filling under a cap).
Each source is dealt into shards by a hash of the document id; the documents of
a shard stand in a seeded order on a line of words, cut into blocks of
``block`` words.  The blocks to take are apportioned twice by the highest
quotients target / (2a + 1): first all blocks among the sources, then a source's
blocks among its shards.  A shard with q blocks to take of its n takes every
block q // n times and q mod n seeded ones once more.  A document's share is
what the taken blocks cover of it, so it never exceeds twice its size as long as
targets stop at twice the source.

Sources are rows of a table throughout, as there may be as many as web hosts: the
level of the targets is found by a few sums over that table, seats by a bound on
the quotients and a distributed sort of the few that the bound leaves open (about
two a source), and a source's shards are apportioned in a task of their own.
Beside one shard a source there are at most ``2 * max_shards``, whatever the
input; beyond that shards get larger, and one holds ids and sizes only, never
texts.  The driver sees sums and the sizes of sort ranges.  What is broadcast
has at most `BROADCAST_ROWS` rows; larger tables are joined by a shuffle.
"""

from __future__ import annotations

from fractions import Fraction
from heapq import heapify, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_SQL, cut

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
CAP = 2
BLOCK = 32
SHARD_WORDS = 250_000
SHARD_ROWS = 200_000
BROADCAST_ROWS = 100_000
MAX_SHARDS = 20_000
SEED = 23
#: Votes are counted in parts of a block, so that their sums are exact.
PARTS = 1 << 20


def n_words(text):
    """Number of runs of non-space bytes: space starts are counted without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def in_order(df: DataFrame, order: list[Column], column: str) -> DataFrame:
    """df with each row's number from 0 in an order that leaves no ties; only the sizes of the sort's ranges reach the driver."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), column)
    before, at = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("_range").count().collect())):
        before.append((part, at))
        at += n
    first = F.broadcast(df.sparkSession.createDataFrame(before, "_range int, _before long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return ranged.join(first, "_range").withColumn(column, place).drop("_range", "_before")


def _over(level: Fraction, cap: int) -> Column:
    """Whether weight * level is above cap * n, in whole numbers."""
    return F.expr(f"w > 0 AND CAST(w AS DECIMAL(10,0)) * {level.numerator}BD > CAST(n AS DECIMAL(20,0)) * {cap * level.denominator}BD")


def water_level(sources: DataFrame, total: Fraction, cap: int = CAP) -> Fraction | None:
    """The level at which targets least(w * level, cap * n) of sources (n, w) add up to total; None where all stop at their caps.

    Sources above their caps at one level stay so at higher ones, so each round
    adds some and shares what is left; a round is one row of sums.
    """
    level, known = Fraction(0), -1
    while True:
        over = _over(level, cap)
        count, held, open_w = sources.agg(F.count_if(over), F.sum(F.when(over, F.col("n"))), F.sum(F.when(~over, F.col("w")))).first()
        if count == known:
            return level
        if not open_w:
            return None
        level, known = (total - cap * (held or 0)) / open_w, count


def highest_quotients(votes: DataFrame, seats: int) -> DataFrame:
    """votes (place, v, ...) with `seats`: what each entry gets of all seats by highest quotients v / (2a + 1), ties to the smaller place.

    Of V votes and k entries with votes, all quotients from V / (2 * seats - k) up
    win at most `seats` seats, and those from V / (2 * seats + k) up at least as
    many; only the quotients between, about k, are sorted.
    """
    total, k = votes.agg(F.sum(F.col("v").cast("decimal(38,0)")), F.count_if(F.col("v") > 0)).first()
    total = int(total or 0)
    if not total or seats <= 0:
        return votes.withColumn("seats", F.lit(0).cast("long"))

    def from_up(x: int) -> Column:
        """How many quotients are total / x or more."""
        return F.expr(f"(CAST(v AS DECIMAL(19,0)) * {x}BD + {total}BD) div {2 * total}BD")

    counted = votes.withColumn("_sure", from_up(max(0, 2 * seats - k))).withColumn("_most", from_up(2 * seats + k))
    left = seats - (counted.agg(F.sum("_sure")).first()[0] or 0)
    open_ = counted.where("_most > _sure").select("place", "v", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("a"))
    open_ = open_.select("place", "a", (F.col("v") / (2 * F.col("a") + 1)).alias("q"))
    won = in_order(open_, [F.col("q").desc(), F.col("place"), F.col("a")], "turn").where(F.col("turn") < left)
    more = won.groupBy("place").agg(F.count(F.lit(1)).alias("_more"))
    return counted.join(more, "place", "left").withColumn("seats", F.col("_sure") + F.coalesce("_more", F.lit(0))).drop("_sure", "_most", "_more")


def sainte_lague(votes: list, seats: int) -> list[int]:
    """Seats by highest quotients votes / (2a + 1); ties to the earlier entry.

    Seat a + 1 of an entry has the quotient votes / (2a + 1).  All quotients from
    total / (2 * seats - entries) up win at most `seats` seats and are given at
    once; the rest, one for each entry at most, come one by one from a heap.
    """
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    spare = 2 * seats - len(votes)
    got = [int((Fraction(v) * spare / total + 1) / 2) if spare > 0 else 0 for v in votes]
    heap = [(-Fraction(v) / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0]
    heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapreplace(heap, (-Fraction(votes[i]) / (2 * got[i] + 1), i))
    return got


def shard_quotas(blocks: list[int], seats: int, cap: int = CAP) -> list[int]:
    """A source's blocks to take, dealt to its shards by their blocks; no shard above cap times its blocks."""
    got = sainte_lague(blocks, min(seats, cap * sum(blocks)))
    over = sum(max(0, g - cap * b) for g, b in zip(got, blocks, strict=True))
    got = [min(g, cap * b) for g, b in zip(got, blocks, strict=True)]
    for i, b in enumerate(blocks):
        more = min(over, cap * b - got[i])
        got[i], over = got[i] + more, over - more
    return got


def quotas(sources: DataFrame, shards: DataFrame, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """(place, shard, blocks, quota): blocks of each source by its target, then of each of its shards.

    sources: (place, n, target); shards: (place, shard, words).  A shard's last
    block covers less than the others, so a source's votes are the blocks that
    its target takes: target * blocks / n.
    """
    shards = shards.withColumn("blocks", F.expr(f"(words + {block - 1}) div {block}"))
    each = sources.join(shards.groupBy("place").agg(F.sum("blocks").alias("blocks")), "place")
    v = F.coalesce(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("n")) * PARTS).cast("long"), F.lit(0).cast("long"))
    votes = cut(each.select("place", v.alias("v")), "votes")
    total = int(votes.agg(F.sum(F.col("v").cast("decimal(38,0)"))).first()[0] or 0)
    seats = highest_quotients(votes, (total + PARTS // 2) // PARTS).select("place", "seats")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:  # at most about max_shards rows
        pdf = pdf.sort_values("shard")
        return pdf.assign(quota=shard_quotas(pdf["blocks"].tolist(), int(pdf["seats"].iloc[0]), cap))[["place", "shard", "blocks", "quota"]]

    return shards.join(seats, "place").groupBy("place").applyInPandas(deal, "place long, shard long, blocks long, quota long")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: Fraction = SHARE,
    cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document row.

    A null text has size 0; a null source is a source of its own, the last one.
    Repeated rows are mixed each by itself; rows with equal ids stand in a fixed
    order by size.  Sources without words have target 0.  An empty table gives
    an empty result.  Reruns agree: order and blocks hang on ids and the seed.
    """
    sized = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = cut(sized, "sizes")  # ids and sizes: the texts are read once
    sources = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    sources = in_order(sources, [F.col("source").isNull(), F.col("source")], "place")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(sources.select(F.col("source").alias("k"), "n", "rows", F.col("place").cast("long").alias("place"), weight.alias("w")), "sources")
    words, rows, count = sources.agg(F.sum("n"), F.sum("rows"), F.count(F.lit(1))).first()
    if not count:
        return sized.select("doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
    level = water_level(sources, share * words, cap)
    full = F.when(F.col("w") > 0, (cap * F.col("n")).cast("double")).otherwise(0.0)
    if level is not None:
        shared = F.coalesce(*[F.when(F.col("w") == w, float(level * w)) for w in sorted(set(weights))])
        full = F.when(_over(level, cap), full).otherwise(shared)
    words_each, rows_each = max(shard_words, -(-words // max_shards)), max(shard_rows, -(-rows // max_shards))
    n_shards = F.greatest(F.lit(1), F.expr(f"(n + {words_each - 1}) div {words_each}"), F.expr(f"(rows + {rows_each - 1}) div {rows_each}"))
    sources = sources.withColumns({"target": full, "n_shards": n_shards, "salt": F.xxhash64("k")})
    info = _few(sources.select("k", "place", F.col("n").alias("source_size"), "target", "n_shards", "salt"), count)
    dealt = sized.join(info, sized["source"].eqNullSafe(info["k"])).drop("k", "source")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed), "salt"), F.col("n_shards"))).drop("n_shards")
    shards = cut(dealt.groupBy("place", "shard").agg(F.sum("size").alias("words")), "shards")
    placed = dealt.join(_few(quotas(sources, shards, block, cap), shards.count()), ["place", "shard"])
    placed = placed.withColumn("start", F.pmod(F.xxhash64("salt", "shard", F.lit(seed)), F.greatest(F.col("blocks"), F.lit(1))))
    line = Window.partitionBy("place", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))

    n, extra = F.greatest(F.col("blocks"), F.lit(1)), F.expr("quota % greatest(blocks, 1)")

    def before(block_no):
        """How many of the extra blocks stand before this one: evenly spread from a seeded start."""
        return F.floor((block_no * extra + F.col("start")) / n).cast("long")

    def covered(x):
        k = F.floor(x / F.lit(block)).cast("long")
        return before(k) * block + (x - k * block) * (before(k + 1) - before(k))

    taken = F.floor(F.col("quota") / n).cast("long") * F.col("size") + covered(F.col("end")) - covered(F.col("begin"))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
