"""Tables of the store: schemas, checks that Parquet does not enforce, sidecar files, stored bytes and pluggable extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import text as T

#: Tables, columns and allowed values.
TABLES: dict[str, str] = {
    "papers": "id LONG, source STRING, source_url STRING, school STRING, school_code STRING, year INT, exam_type STRING, paper_no INT, doc_type STRING, file_sha256 STRING, rel_path STRING, "
    "pages INT, size_bytes LONG, downloaded_at TIMESTAMP, parse_status STRING, parse_notes STRING",
    "questions": "id LONG, paper_id LONG, q_number INT, part_labels ARRAY<STRING>, page_start INT, page_end INT, y_top DOUBLE, y_bottom DOUBLE, marks_total INT, full_text STRING, needs_ocr BOOLEAN, "
    "extract_confidence DOUBLE, text_sha256 STRING",
    "topics": "code STRING, name STRING, strand STRING",
    "question_topics": "question_id LONG, topic_code STRING, confidence DOUBLE, method STRING",
    "crawl_log": "id LONG, run_at TIMESTAMP, source STRING, urls_seen INT, new_papers INT, errors ARRAY<STRING>",
    "llm_cache": "text_sha256 STRING, model STRING, response STRUCT<topic_codes:ARRAY<STRING>,confidence:DOUBLE>, input_tokens LONG, output_tokens LONG, created_at TIMESTAMP",
}
ALLOWED: dict[tuple[str, str], tuple[str, ...]] = {
    ("papers", "doc_type"): ("qp", "ms", "combined"),
    ("papers", "parse_status"): ("pending", "ok", "partial", "failed", "skipped"),
    ("topics", "strand"): ("pure", "stats"),
    ("question_topics", "method"): ("rule", "llm"),
}
UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "papers": (("file_sha256",), ("source", "source_url"), ("rel_path",)),
    "questions": (("paper_id", "q_number"),),
    "topics": (("code",),),
    "question_topics": (("question_id", "topic_code"),),
    "llm_cache": (("text_sha256", "model"),),
}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Make the missing tables as Parquet tables; those that are there are left alone. Names of all."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return sorted(TABLES)


def migrated(old: DataFrame, name: str) -> DataFrame:
    """An older version of a table with the columns it lacks added as nulls, in the table's order."""
    spark = old.sparkSession
    wanted = spark.createDataFrame([], TABLES[name])
    return wanted.unionByName(old, allowMissingColumns=True).select(*wanted.columns)


def violations(df: DataFrame, name: str) -> DataFrame:
    """(rule, value, n) of values outside their list and of repeated unique keys; empty if the table is sound."""
    parts = []
    for (t, column), allowed in ALLOWED.items():
        if t == name:
            bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
            parts.append(bad.groupBy(F.lit(f"{column} is not allowed").alias("rule"), F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    for key in UNIQUE.get(name, ()):
        again = df.where(F.concat(*[F.col(k).cast("string") for k in key]).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(again.select(F.lit(f"{','.join(key)} is not unique").alias("rule"), F.concat_ws("|", *key).alias("value"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def status_changes(papers: DataFrame, results: DataFrame) -> DataFrame:
    """(id, parse_status, parse_notes) of papers whose status or notes a result (id, parse_status, notes) changes; unchanged ones are skipped."""
    r = results.select("id", F.col("parse_status").alias("_s"), F.nullif(F.array_join("notes", "; "), F.lit("")).alias("_n"))
    both = papers.select("id", "parse_status", "parse_notes").join(r, "id")
    return both.where(~F.col("_s").eqNullSafe(F.col("parse_status")) | ~F.col("_n").eqNullSafe(F.col("parse_notes"))).select("id", F.col("_s").alias("parse_status"), F.col("_n").alias("parse_notes"))


def next_status(papers: DataFrame, results: DataFrame) -> DataFrame:
    """papers with parse_status and parse_notes from results (id, parse_status, notes); those without a result or a change stay."""
    r = status_changes(papers, results).select("id", F.struct(F.col("parse_status").alias("s"), F.col("parse_notes").alias("n")).alias("_new"))
    new = lambda field, old: F.when(F.col("_new").isNotNull(), F.col(f"_new.{field}")).otherwise(F.col(old))
    return papers.join(r, "id", "left").withColumn("parse_status", new("s", "parse_status")).withColumn("parse_notes", new("n", "parse_notes")).select(*papers.columns)


def seeded(topics: DataFrame, seed: DataFrame) -> DataFrame:
    """topics with the seed (code, name, strand) upserted: known codes get its name and strand, new ones are added, others stay."""
    s = seed.dropDuplicates(["code"]).select("code", F.struct("name", "strand").alias("_s"))
    return topics.join(s, "code", "full").select("code", F.coalesce("_s.name", "name").alias("name"), F.coalesce("_s.strand", "strand").alias("strand"))


def mean_confidence(papers: DataFrame) -> DataFrame:
    return papers.where("n > 0").agg(F.count(F.lit(1)).alias("papers"), F.avg("confidence").alias("mean_confidence"))


def sidecars(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """One row a paper with its questions nested, and the path of its sidecar file."""
    q = questions.select("paper_id", F.struct("q_number", "page_start", "page_end", "marks_total", "part_labels", F.char_length("full_text").alias("chars"), T.first_line(F.col("full_text")).alias("first_line")).alias("q"))
    nested = q.groupBy("paper_id").agg(F.array_sort(F.collect_list("q")).alias("questions"))
    return papers.join(nested, "paper_id", "left").withColumn("sidecar", T.sidecar_path(F.col("rel_path")))


def write_sidecars(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("paper_id").json(path)


def stored_bytes(downloads: DataFrame) -> DataFrame:
    """(rel_path, file_sha256, size_bytes, content) of downloads (rel_path, content): bytes stay a column, not files of their own."""
    return downloads.select("rel_path", F.sha2("content", 256).alias("file_sha256"), F.octet_length("content").cast("long").alias("size_bytes"), "content")


Extractor = Callable[[bytes], list[tuple[int, float, float, str, float, float]]]
LINES = "paper_id long, seq int, page int, top double, x0 double, text string, bottom double, page_height double"


def extract_lines(files: DataFrame, extractor: Extractor) -> DataFrame:
    """Lines of documents (paper_id, content) by a callable that gives (page, top, x0, text, bottom, height); a failing document gives none.

    Non-breaking spaces become spaces, lines are right-trimmed and blank ones dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, raw in zip(pdf["paper_id"], pdf["content"], strict=True):
                try:
                    found = extractor(bytes(raw))
                except Exception:  # a broken document has no lines
                    found = []
                rows = [(page, top, x0, text.replace("\xa0", " ").rstrip(), bottom, height) for page, top, x0, text, bottom, height in found]
                out += [(i, k, *r) for k, r in enumerate(r for r in rows if r[3].strip())]
            yield pd.DataFrame(out, columns=["paper_id", "seq", "page", "top", "x0", "text", "bottom", "page_height"])

    return files.select("paper_id", "content").mapInPandas(run, LINES)


def low_text_pages(lines: DataFrame, pages: DataFrame, min_chars: int = 50) -> DataFrame:
    """(paper_id, low_pages) of papers (paper_id, pages): pages whose lines have fewer than min_chars characters."""
    return low_pages(lines.groupBy("paper_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("n")), pages, min_chars)


def low_pages(chars: DataFrame, pages: DataFrame, min_chars: int = 50) -> DataFrame:
    """`low_text_pages` where the characters (paper_id, page, n) are known."""
    full = chars.where(F.col("n") >= min_chars).groupBy("paper_id").agg(F.collect_set("page").alias("full"))
    low = F.array_except(F.sequence(F.lit(1), "pages"), F.coalesce("full", F.array().cast("array<int>")))
    return pages.where("pages > 0").join(full, "paper_id", "left").select("paper_id", F.array_sort(low).alias("low_pages"))
