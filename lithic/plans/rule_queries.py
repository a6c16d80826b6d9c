"""Queries with rule tables that are data: phrases, aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.functions import automaton
from lithic.operators import tagging
from lithic.plans.bank_queries import read
from lithic.plans.corpus_queries import _REASON, WORD_RULES, _hits
from lithic.sources import host

EDGE, BEHIND = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def rule_table_tags(spark, sf_dir):
    """The tags of `rule_tags`, by a table that also has ten thousand rules which say nothing of these texts."""
    rules = spark.createDataFrame([(c, p) for c, ps in WORD_RULES.items() for p in ps], "code string, pattern string")
    idle = spark.range(10_000).select(F.concat(F.lit("IDLE"), (F.col("id") % 700).cast("string")).alias("code"), F.concat(F.lit(EDGE + "zz"), F.col("id").cast("string"), F.lit(r"q\d+|qq"), F.col("id").cast("string"), F.lit("x+z")).alias("pattern"))
    d = tagging.rule_decisions(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", rules.unionByName(idle))
    return d.select("doc_id", "reason", F.array_join(F.transform("tags", lambda t: F.concat(t["code"], F.lit(":"), t["confidence"].cast("string"))), "|").alias("tags"))


def phrase_rules(spark, sf_dir):
    """Items of the benchmark as codes, their first four words and their fifth to eighth as phrases: which texts have them."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("code"), words.alias("w")).where(F.size("w") >= 8)
    phrases = items.select("code", F.explode(F.array(*[F.array_join(F.slice("w", k, 4), " ") for k in (1, 5)])).alias("phrase"))
    return automaton.phrase_hits(read(spark, sf_dir, "documents"), phrases, "doc_id", "text")


def host_aliases(spark, sf_dir):
    """First labels of the pages' hosts as aliases; of those in a page's texts and links the longest."""
    label = F.regexp_extract(host(F.col("url")), r"([a-z]+)\.example", 1)
    pages = read(spark, sf_dir, "pages")
    table = [(r.alias, r.code, r.alias) for r in pages.groupBy(label.alias("alias")).agg(F.min(host(F.col("url"))).alias("code")).where("alias <> ''").orderBy("code").collect()]
    short = [a for a, _, _ in table if len(a) < 6]
    found = automaton.longest_alias(F.lower(F.substring("html", 1, 1 << 30)), table, short)
    return pages.withColumn("a", found).select("page_id", "a.code", F.col("a.name").alias("alias"))


QUERIES = {f.__name__: f for f in (rule_table_tags, phrase_rules, host_aliases)}

ORACLE_SQL = {
    "rule_table_tags": "WITH " + _hits(WORD_RULES) + " SELECT doc_id, " + _REASON.format(3) + " AS reason, CASE WHEN len(codes) BETWEEN 1 AND 3 THEN array_to_string(tags, '|') ELSE '' END AS tags FROM r",
    # both sides as words: a phrase is found where its words stand next to one another
    "phrase_rules": r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT 'B' || item_id AS code, unnest([w[1:4], w[5:8]]) AS g FROM w WHERE len(w) >= 8),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[k : k + 3] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 4))
SELECT doc_id, code, count(*)::INTEGER AS n FROM g JOIN (SELECT code, list_transform(g, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS g FROM p) USING (g) GROUP BY doc_id, code""",
    "host_aliases": r"""WITH h AS (SELECT page_id, lower(html) AS t, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages),
a AS (SELECT regexp_extract(host, '([a-z]+)\.example', 1) AS alias, min(host) AS code FROM h GROUP BY 1 HAVING alias <> ''),
m AS (SELECT page_id, arg_min(alias, (-length(alias), code)) AS alias, arg_min(code, (-length(alias), code)) AS code FROM h JOIN a ON CASE WHEN length(alias) < 6 THEN regexp_matches(t, '(^|[^a-z])' || alias || '([^a-z]|$)') ELSE contains(t, alias) END GROUP BY page_id)
SELECT h.page_id, code, alias FROM h LEFT JOIN m USING (page_id)""",
}
