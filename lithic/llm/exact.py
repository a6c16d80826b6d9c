"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after all white space (see
``SPACES``) is deleted.  Groups of one length are refined by the hash of a
prefix; both come from the first scan, as the length without white space has to
be counted in the text, and partial sums leave a narrow row a group.  Only
groups of at least two rows go on.  They become a filter of bits of fixed size,
so the second scan knows without a shuffle which texts to read in full, and
hashes only these.  No text is ever shuffled.

A filter that is too full only lets more rows through, and the full hash then
tells them apart, so the result does not hang on its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, unused

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Code points of the normalised text that the prefix hash reads.
PREFIX = 128
#: Words of 64 bits of the filter, the bound of what is broadcast: 2**19 rows, some 20 MB.
WORDS = 1 << 19


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _filter(keys: DataFrame, words: int) -> DataFrame:
    """(word, bits) of the key hashes, at most `words` rows."""
    bit = F.expr("shiftleft(1L, cast(key & 63 AS int))")
    return keys.select(F.expr(f"pmod(shiftright(key, 6), {words}L)").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, prefix: int = PREFIX, words: int = WORDS) -> DataFrame:
    """One row a row of docs: id, the columns of `carry`, keep_id, group_size, kept.

    Of equal texts the row with the most code points in its original text stays,
    then the one with the smallest id (null is smallest); of rows alike in both
    exactly one.  Null, empty and blank texts are equal.  A repeated id is a row
    like others.  An empty table gives no rows.  Where docs has columns named
    like the results, the results' names get underscores.
    """
    carry = list(carry or [])
    names = {c: unused(docs.select(id_col, *carry), c) for c in ("keep_id", "group_size", "kept")}
    base = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], normalised(F.col(text_col)).alias("_norm"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("_cp"))
    length, head = F.octet_length("_norm").cast("long"), F.substring("_norm", 1, prefix)
    keyed = base.select("*", length.alias("_len"), F.xxhash64(length, head).alias("_key"))
    several = cut(keyed.groupBy("_len", F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several")
    bits = F.broadcast(_filter(several, words))  # at most `words` rows
    probed = keyed.join(bits, F.expr(f"pmod(shiftright(_key, 6), {words}L)") == bits["word"], "left")
    open_ = F.coalesce(F.expr("(shiftright(bits, cast(_key & 63 AS int)) & 1) = 1"), F.lit(False))
    full = F.when(open_, F.sha2("_norm", 256))
    rows = cut(probed.select(*[c for c in base.columns if c != "_norm"], "_len", full.alias("_full"), F.monotonically_increasing_id().alias("_row")), "hashed")
    maybe = rows.where("_full IS NOT NULL")
    first = F.min(F.struct((-F.col("_cp")).alias("o"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_first")
    groups = cut(maybe.groupBy("_len", "_full").agg(first, F.count(F.lit(1)).alias("_n")).where("_n > 1"), "groups")
    found = maybe.join(groups, ["_len", "_full"], "left")
    alone = rows.where("_full IS NULL").select("*", F.lit(None).cast(groups.schema["_first"].dataType).alias("_first"), F.lit(None).cast("long").alias("_n"))
    out = found.unionByName(alone)
    drop(several)
    grouped = F.col("_n").isNotNull()
    return out.select(
        F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.when(grouped, F.col("_first.id")).otherwise(F.col("_id")).alias(names["keep_id"]),
        F.coalesce("_n", F.lit(1)).cast("long").alias(names["group_size"]), F.coalesce(F.col("_first.row") == F.col("_row"), F.lit(True)).alias(names["kept"]),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are."""
    rest = [c for c in docs.columns if c != id_col]
    out = classes(docs, id_col, text_col, rest)
    return out.where(out.columns[-1]).select(*docs.columns)
