"""Text search by a table of trigrams: few rows are read, and the answer is that of a scan.

The index has, for each piece of a few megabytes of the texts, one row for each
trigram of the texts in lower case, with the ids of the texts that have it.  Each
piece is sorted by trigram and written in small pages, so a search reads the
pages of its own trigrams alone; no posting moves between tasks.  Texts that
have all of a phrase's trigrams are candidates; these are then searched for the
whole phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 3
#: Characters whose postings are sorted at once.
PIECE = 1 << 21


def _postings(batches):
    """Sorted trigrams of each piece of a batch of (id, text in lower case), with the ids that have each."""
    names = ["gram", "ids"]
    for batch in batches:
        ids, size = batch.column(0), pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + PIECE, "right")))
            char = np.frombuffer("".join(t or "" for t in batch.column(1)[a:b].to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
            row = np.repeat(np.arange(b - a), size[a:b])
            # three characters of 21 bits are one number, in the order of the trigrams
            gram = char[:-2] << np.uint64(42) | char[1:-1] << np.uint64(21) | char[2:] if len(char) >= N else char[:0]
            inside = row[: len(gram)] == row[N - 1 :]
            own, which = np.unique(gram[inside], return_inverse=True)
            pairs = np.unique(which * (b - a) + row[: len(gram)][inside])
            first = np.searchsorted(pairs, np.arange(len(own) + 1) * (b - a))
            three = np.stack([own >> np.uint64(42), own >> np.uint64(21), own], axis=1) & np.uint64((1 << 21) - 1)
            text = three.astype("<u4").tobytes().decode("utf-32-le")
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), ids.take(pa.array(pairs % (b - a) + a)))
            yield pa.RecordBatch.from_arrays([pa.array([text[k : k + N] for k in range(0, len(text), N)], pa.string()), lists], names)
            a = b


def posted(rows: DataFrame, id_col: str = "id", text_col: str = "full_text") -> DataFrame:
    """(gram, ids): the postings of texts, to be written with `write_index`; a trigram has one row for each piece of the texts."""
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, F.lower(text_col).alias("_low")).mapInArrow(_postings, f"gram string, ids array<{kind}>")


def write_index(rows: DataFrame, path: str, id_col: str = "id", text_col: str = "full_text") -> None:
    """Postings in pages of few trigrams."""
    posted(rows, id_col, text_col).write.mode("overwrite").option("parquet.block.size", 8 << 20).option("parquet.page.row.count.limit", 500).parquet(path)


def _wanted(low: str) -> list[str]:
    return sorted({low[k : k + N] for k in range(len(low) - N + 1)})


def _having(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(id, grams): which of the wanted trigrams each text has; texts without any are left out."""
    found = index.where(F.col("gram").isin(wanted)).select("gram", F.explode_outer("ids").alias("id"))
    return found.groupBy("id").agg(F.collect_set("gram").alias("grams"))


def candidates(index: DataFrame, needle: str) -> DataFrame | None:
    """(id) of the texts that have all trigrams of a phrase; None if the phrase has none, so every text is one."""
    wanted = _wanted(needle.lower())
    return _having(index, wanted).where(F.size("grams") == len(wanted)).select("id") if wanted else None


def search(rows: DataFrame, index: DataFrame, text: str | None, id_col: str = "id", text_col: str = "full_text") -> DataFrame:
    """rows whose text contains the phrase, without regard to case; all rows for an empty phrase. A repeated or null id is a row like others."""
    needle = (text or "").strip().lower()
    if not needle:
        return rows
    some = candidates(index, needle)
    if some is not None:
        rows = rows.join(some.withColumnRenamed("id", "_found"), F.col(id_col).eqNullSafe(F.col("_found")), "left_semi")
    return rows.where(F.contains(F.lower(text_col), F.lit(needle)))


def search_all(rows: DataFrame, index: DataFrame, phrases: list[str], id_col: str = "id", text_col: str = "full_text") -> DataFrame:
    """(id, phrase) of each phrase that a text contains, by one pass over the index and one over the texts."""
    low = [(p or "").strip().lower() for p in phrases]
    wanted = {t: _wanted(t) for t in low}
    all_ = sorted({g for grams in wanted.values() for g in grams})
    rows = rows.select(F.col(id_col), F.col(text_col).alias("_text"))
    if all_:
        some = _having(index, all_).withColumnRenamed("id", "_found")
        rows = rows.join(some, F.col(id_col).eqNullSafe(F.col("_found")), "left").drop("_found")

    def has(t: str) -> Column:
        if not t:
            return F.lit(True)
        found = F.contains(F.lower("_text"), F.lit(t))
        return F.forall(F.array(*map(F.lit, wanted[t])), lambda g: F.array_contains("grams", g)) & found if wanted[t] else found

    hits = F.array(*[F.when(has(t), F.lit(p)) for p, t in zip(phrases, low, strict=True)])
    return rows.select(F.col(id_col), F.explode(F.filter(hits, lambda p: p.isNotNull())).alias("phrase"))
