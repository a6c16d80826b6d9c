"""All registered queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithic.plans import bank_queries, corpus_queries, rule_queries, store_queries, web_queries, work_queries

QUERIES = {**bank_queries.QUERIES, **corpus_queries.QUERIES, **rule_queries.QUERIES, **store_queries.QUERIES, **web_queries.QUERIES, **work_queries.QUERIES}
ORACLE_SQL = {**bank_queries.ORACLE_SQL, **corpus_queries.ORACLE_SQL, **rule_queries.ORACLE_SQL, **store_queries.ORACLE_SQL, **web_queries.ORACLE_SQL, **work_queries.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question bank: questions, papers, mark schemes and tags in one view."""
    return bank_queries.bank_view(spark, sf_dir)
