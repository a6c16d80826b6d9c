"""The joined question view, its filters, facets and reports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAPER_KEY = ("school_code", "year", "exam_type", "paper_no")


def mark_schemes(papers: DataFrame, key: tuple[str, ...] = PAPER_KEY) -> DataFrame:
    """One mark scheme a paper key: combined before ms, then by path; aggregated before any join."""
    ms = papers.where(F.col("doc_type").isin("ms", "combined"))
    return ms.groupBy(*key).agg(F.min_by("rel_path", F.struct("doc_type", "rel_path")).alias("ms_path"))


def first_related(left: DataFrame, right: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Null-safe left join on all key columns, as a null paper number equals a null one."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in key], *[c for c in right.columns if c not in key])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return left.join(r, cond, "left").drop(*[f"_{k}" for k in key])


def tag_text(items: Column) -> Column:
    """`CODE:method` of an array of (topic_code, method), in code order, joined by |."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat(x["topic_code"], F.lit(":"), x["method"])), "|")


def tag_lists(tags: DataFrame) -> DataFrame:
    """(question_id, tags): `CODE:method` in code order, joined by |."""
    return tags.groupBy("question_id").agg(tag_text(F.collect_list(F.struct("topic_code", "method"))).alias("tags"))


def bank_view(questions: DataFrame, papers: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Questions with their paper, its mark scheme and their tags; order it with `in_order` where order matters. Without tags, the questions bring that column themselves."""
    # schemes go to the papers and tags to the bare questions, so that the wide rows move by the paper alone
    shown = first_related(papers.where(F.col("doc_type").isin("qp", "combined")).withColumnRenamed("id", "paper_id"), mark_schemes(papers), PAPER_KEY)
    q = questions if tags is None else questions.join(tag_lists(tags).withColumnRenamed("question_id", "id"), "id", "left")
    own = [c for c in questions.columns if c not in ("id", "paper_id", "tags")]
    return q.join(shown, "paper_id").select("id", "paper_id", *own, *[c for c in shown.columns if c != "paper_id"], "tags")


def in_order(bank: DataFrame) -> DataFrame:
    return bank.orderBy(F.col("year").desc(), "school_code", F.col("paper_no").asc_nulls_first(), "q_number")


def filtered(bank: DataFrame, *, text: str | None = None, topic: str | None = None, school: str | None = None, year: int | None = None,
             has_scheme: bool = False, marks_min: int | None = None, marks_max: int | None = None) -> DataFrame:
    """All given filters at once; a question without marks counts as -1 from below and 999 from above."""
    needle = (text or "").strip().lower()
    preds = []
    if needle:
        preds.append(F.contains(F.lower("full_text"), F.lit(needle)))
    if topic:
        preds.append(F.coalesce(F.col("tags").rlike(rf"(^|\|){re.escape(topic)}(:|$)"), F.lit(False)))
    if school:
        preds.append(F.col("school_code") == school)
    if year is not None:
        preds.append(F.col("year") == year)
    if has_scheme:
        preds.append(F.col("ms_path").isNotNull())
    if marks_min is not None:
        preds.append(F.coalesce("marks_total", F.lit(-1)) >= marks_min)
    if marks_max is not None:
        preds.append(F.coalesce("marks_total", F.lit(999)) <= marks_max)
    return bank.where(reduce(lambda a, b: a & b, preds)) if preds else bank


def footer(shown: DataFrame, bank: DataFrame) -> DataFrame:
    """One row: questions shown, of how many, and the marks shown."""
    a = shown.agg(F.count(F.lit(1)).alias("shown"), F.coalesce(F.sum("marks_total"), F.lit(0)).alias("marks"))
    return a.crossJoin(bank.agg(F.count(F.lit(1)).alias("total")))  # one row each


def facet_topics(topics: DataFrame, tags: DataFrame) -> DataFrame:
    """Topics that some question has."""
    return topics.join(tags.select(F.col("topic_code").alias("code")).distinct(), "code", "left_semi").orderBy("strand", "name")


def facet_values(bank: DataFrame, *cols: str, descending: bool = False) -> DataFrame:
    out = bank.select(*cols).distinct()
    return out.orderBy(*[F.col(c).desc() if descending else F.col(c) for c in cols])


def topic_report(topics: DataFrame, tags: DataFrame) -> DataFrame:
    """Questions of every topic, zero included."""
    counts = tags.groupBy(F.col("topic_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return topics.join(counts, "code", "left").select("strand", "code", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy("strand", F.col("n").desc(), "code")


def untagged(questions: DataFrame, tags: DataFrame) -> DataFrame:
    return questions.join(tags.select(F.col("question_id").alias("id")), "id", "left_anti")


def token_totals(cache: DataFrame, per_m_in: float = 1.0, per_m_out: float = 5.0) -> DataFrame:
    """Per model: calls, tokens in and out (0 where unknown) and cost."""
    out = cache.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("tokens_out"))
    return out.withColumn("cost", F.col("tokens_in") / 1e6 * per_m_in + F.col("tokens_out") / 1e6 * per_m_out)
