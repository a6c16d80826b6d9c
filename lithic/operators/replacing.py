"""A stored bank whose papers are replaced in place: only the folders of these papers change, tags go in the same step.

Layout below a path: `questions` and `tags`, partitioned by a hash bucket of the
paper, and `pending`, where a replacement is written whole before it counts.

1. The new contents of the buckets concerned are written to `pending`; a mark
   beside them names the buckets and makes the replacement count.
2. The buckets are overwritten from there, dynamically, so no other folder is
   touched; a bucket that is left without rows is deleted.
3. `pending` goes.

A failure before the mark leaves the bank as it was, and the next call clears
what it left.  A failure after the mark is made good by `recover`, which every
call begins with: the steps give the same folders however often they run.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators import tables

BUCKETS = 64
PARTS = ("questions", "tags")


def bucket(paper: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(paper.cast("long")), F.lit(buckets)).cast("int")


def create(path: str, questions: DataFrame, tags: DataFrame, buckets: int = BUCKETS) -> None:
    """A new bank. questions: (id, paper_id, ..); tags: (question_id, paper_id, ..), the paper being that of the question."""
    for name, df in zip(PARTS, (questions, tags), strict=True):
        _partitioned(df.withColumn("bucket", bucket(F.col("paper_id"), buckets))).mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def _partitioned(df: DataFrame):
    """A writer with few files a bucket; adaptive execution splits a bucket that is large, and joins those that are small."""
    return df.hint("rebalance", "bucket").write


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """`questions` or `tags` of a bank, after a replacement that failed half way has been finished."""
    recover(spark, path)
    return spark.read.parquet(f"{path}/{name}").drop("bucket")


def replace_papers(path: str, papers: DataFrame, questions: DataFrame, buckets: int = BUCKETS) -> None:
    """Put `questions` in place of all questions of `papers` (paper_id); tags of questions that are gone go as well.

    A paper without new questions ends up empty; new questions of papers that
    are not in `papers` are left out.  Both tables keep the columns they have.
    """
    spark = papers.sparkSession
    recover(spark, path)
    gone = tables.written(papers.select(F.col("paper_id").cast("long").alias("paper_id")).distinct(), "papers")
    hit = gone.select(bucket(F.col("paper_id"), buckets).alias("bucket")).distinct()
    touched = sorted(r.bucket for r in hit.collect())  # at most as many as there are buckets
    if not touched:
        return
    old = {n: spark.read.parquet(f"{path}/{n}").where(F.col("bucket").isin(touched)) for n in PARTS}
    fresh = questions.join(gone, "paper_id", "left_semi").withColumn("bucket", bucket(F.col("paper_id"), buckets))
    kept = old["questions"].join(gone, "paper_id", "left_anti").unionByName(fresh.select(*old["questions"].columns))
    _partitioned(kept).mode("overwrite").partitionBy("bucket").parquet(f"{path}/pending/questions")
    there = spark.read.schema(kept.schema).parquet(f"{path}/pending/questions").select(F.col("id").alias("question_id"))
    _partitioned(old["tags"].join(there, "question_id", "left_semi").select(*old["tags"].columns)).mode("overwrite").partitionBy("bucket").parquet(f"{path}/pending/tags")
    mark(spark, path, touched)
    recover(spark, path)
    tables.drop(gone)


def mark(spark: SparkSession, path: str, touched: list[int]) -> None:
    """The replacement in `pending` counts from here on: a file that is there, or not."""
    spark.createDataFrame([(json.dumps(touched),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/pending/mark")


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that counts, clear one that does not."""
    if not tables.exists(spark, f"{path}/pending"):
        return
    if tables.exists(spark, f"{path}/pending/mark/_SUCCESS"):
        touched = json.loads(spark.read.text(f"{path}/pending/mark").first()[0])
        for name in PARTS:
            schema = spark.read.parquet(f"{path}/{name}").schema
            staged = spark.read.schema(schema).parquet(f"{path}/pending/{name}")
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")
            filled = {r.bucket for r in staged.select("bucket").distinct().collect()}
            tables.delete(spark, *[f"{path}/{name}/bucket={b}" for b in touched if b not in filled])
    tables.delete(spark, f"{path}/pending")
