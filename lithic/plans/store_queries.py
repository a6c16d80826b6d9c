"""Queries over stored tables: papers in order of arrival, replaced papers, text search, archives in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lithic.operators import ingest, replacing, search, tables
from lithic.plans.bank_queries import _CTE, numbered_once, questions, read, tags
from lithic.plans.corpus_queries import zip_archives
from lithic.sources import safe_member, zip_table


def upsert_papers(spark, sf_dir):
    """Documents as papers in the order of their ids, with links that many of them share; one document in five is in the table before, where it is the first of its link and its text."""
    d = read(spark, sf_dir, "documents")
    rows = d.select(
        F.col("doc_id").alias("id"), "source", F.concat(F.lit("u/"), (F.col("doc_id") % 41).cast("string")).alias("source_url"), F.sha2("text", 256).alias("file_sha256"),
        F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("rel_path"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit("pending").alias("parse_status"),
    )
    old = rows.where(F.col("id") % 5 == 0)
    for key in (("file_sha256",), ("source", "source_url")):
        rest = [c for c in old.columns if c not in key]
        old = old.groupBy(*key).agg(F.min_by(F.struct(*rest), "id").alias("r")).select(*key, "r.*")
    new = rows.where(F.col("id") % 5 > 0).withColumn("ord", F.col("id")).drop("id")
    return ingest.upsert_papers(tables.written(old.select(*rows.columns), "old"), new)


def replaced_in_place(spark, sf_dir):
    """The stored bank after every tenth paper got its first question alone, with number 99, and every twentieth none: how many questions and tags each bucket has, and of which sum."""
    path = f"{tables.shared_dir(spark)}/lithic-bank-{uuid.uuid4().hex}"
    rows = numbered_once(spark, sf_dir)  # both tables and the replacement are made from them
    q, t = questions(spark, sf_dir, rows), tags(spark, sf_dir, rows)
    q = q.select("id", "paper_id", "q_number")
    replacing.create(path, q, t.join(q.select(F.col("id").alias("question_id"), "paper_id"), "question_id"))
    papers = q.where(F.col("paper_id") % 10 == 0).select("paper_id").distinct()
    new = q.where((F.col("paper_id") % 10 == 0) & (F.col("paper_id") % 20 > 0) & (F.col("q_number") == 1)).withColumn("q_number", F.lit(99))
    replacing.replace_papers(path, papers, new)
    kept = replacing.read(spark, path, "questions").groupBy("paper_id").agg(F.count(F.lit(1)).alias("questions"), F.sum("q_number").alias("numbers"))
    tagged = replacing.read(spark, path, "tags").groupBy("paper_id").agg(F.count(F.lit(1)).alias("tags"))
    return kept.join(tagged, "paper_id", "left").select("paper_id", "questions", "numbers", F.coalesce("tags", F.lit(0)).alias("tags"))


def text_search(spark, sf_dir):
    """Documents that contain one of some phrases, by an index of trigrams."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{tables.shared_dir(spark)}/lithic-index-{uuid.uuid4().hex}"
    search.write_index(d, path, "doc_id", "text")
    return search.search_all(d, spark.read.parquet(path), ["Licensed under", "the of", " und DER ", "@", "zzz none", "été"], "doc_id", "text")


def zip_members_sql(spark, sf_dir):
    """The archives of `zip_members`, asked in SQL."""
    zip_archives(spark, sf_dir).createOrReplaceTempView("lithic_archives")
    found = spark.sql(f"SELECT a.page_id, m.* FROM lithic_archives a, LATERAL {zip_table.register(spark)}(a.content) m")
    return found.select("page_id", "name", "size", "is_pdf").withColumn("safe", safe_member(F.col("name")))


QUERIES = {f.__name__: f for f in (upsert_papers, replaced_in_place, text_search, zip_members_sql)}

ORACLE_SQL = {
    # one row after the other, with the papers so far
    "upsert_papers": """WITH RECURSIVE d AS (SELECT doc_id AS id, source, 'u/' || (doc_id % 41) AS url, sha256(text) AS sha, 'p/' || doc_id AS rel, strlen(text)::BIGINT AS size FROM documents),
o1 AS (SELECT sha, min(id) AS id FROM d WHERE id % 5 = 0 GROUP BY sha), o2 AS (SELECT min(id) AS id FROM d JOIN o1 USING (id) GROUP BY source, url), old AS (SELECT d.* FROM d JOIN o2 USING (id)),
n AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM d WHERE id % 5 > 0),
w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS id, 0::BIGINT AS hit, (SELECT list(sha ORDER BY id) FROM old) AS shas, (SELECT list(source || '|' || url ORDER BY id) FROM old) AS urls, (SELECT list(id ORDER BY id) FROM old) AS ids
  UNION ALL SELECT k, id, hit, CASE WHEN hit IS NULL THEN list_append(shas, sha) ELSE shas END, CASE WHEN hit IS NULL THEN list_append(urls, link) ELSE urls END, CASE WHEN hit IS NULL THEN list_append(ids, id) ELSE ids END
  FROM (SELECT n.k, n.id, n.sha, n.source || '|' || n.url AS link, w.shas, w.urls, w.ids, w.ids[coalesce(nullif(list_position(w.shas, n.sha), 0), nullif(list_position(w.urls, n.source || '|' || n.url), 0))] AS hit FROM w JOIN n ON n.k = w.k + 1)),
s AS (SELECT coalesce(hit, id) AS paper, id, hit IS NULL AS fresh FROM w WHERE k > 0 UNION ALL SELECT id, id, false FROM old),
f AS (SELECT paper, max(id) FILTER (WHERE id <> paper) AS last, bool_or(fresh) AS fresh FROM s GROUP BY paper)
SELECT CASE WHEN NOT f.fresh THEN b.id END AS id, b.source, b.url AS source_url, b.sha AS file_sha256, coalesce(l.rel, b.rel) AS rel_path, coalesce(l.size, b.size) AS size_bytes, 'pending' AS parse_status FROM f JOIN d b ON b.id = f.paper LEFT JOIN d l ON l.id = f.last""",
    "replaced_in_place": _CTE + """, q AS (SELECT id, paper_id, q_number FROM questions WHERE paper_id % 10 <> 0 UNION ALL SELECT id, paper_id, 99 FROM questions WHERE paper_id % 10 = 0 AND paper_id % 20 <> 0 AND q_number = 1),
t AS (SELECT paper_id, count(*) AS tags FROM tags JOIN q ON q.id = question_id GROUP BY paper_id)
SELECT paper_id, count(*) AS questions, sum(q_number)::BIGINT AS numbers, coalesce(any_value(tags), 0) AS tags FROM q LEFT JOIN t USING (paper_id) GROUP BY paper_id""",
    "text_search": "SELECT doc_id, phrase FROM documents, (VALUES ('Licensed under'), ('the of'), (' und DER '), ('@'), ('zzz none'), ('été')) p(phrase) WHERE contains(lower(text), lower(trim(phrase)))",
    "zip_members_sql": r"""WITH m AS (SELECT page_id, length(html)::BIGINT AS size, 'p' || page_id || ['.PDF', '.txt', '/../x.pdf', '/', ':y.pdf', '/in/z.pdf'][page_id % 6 + 1] AS name FROM pages)
SELECT page_id, name, size, ends_with(lower(name), '.pdf') AS is_pdf,
  ends_with(lower(name), '.pdf') AND NOT list_contains(string_split(replace(name, '\', '/'), '/'), '..') AND name[1] NOT IN ('/', '\') AND NOT contains(name, ':') AS safe FROM m""",
}
