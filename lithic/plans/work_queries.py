"""Queries over the pluggable steps: fetching, classifying, extracting and storing, each with a small callable whose answers SQL can say."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lithic import sources
from lithic.functions import text as T
from lithic.operators import ingest, store, tables, tagging
from lithic.plans.bank_queries import read
from lithic.plans.corpus_queries import _LINES
from lithic.sources.fetch import fetch


# ------------------------------------------------------------------ fetching
def _server(url: str, form=None):
    """A web server by the length of the address: missing, busy, unreachable or too large pages, else the address itself."""
    n = len(url)
    if n % 7 == 0:
        return 404, {}, b"gone"
    if n % 11 == 0:
        return 429, {}, b""
    if n % 5 == 0:
        raise OSError("no route")
    if n % 3 == 0:
        return 200, {"content-length": "5000"}, b"x"
    return 200, {}, url.encode()


def fetched_pages(spark, sf_dir):
    """Every page's address asked for, twice where that may help; bodies of 1,000 bytes and more are refused."""
    got = fetch(read(spark, sf_dir, "pages").select("url"), _server, max_bytes=1000, max_retries=2, sleep=lambda _: None)
    return got.select("url", "status", "attempts", "error", F.sha2("content", 256).alias("sha"))


def matching_anchors(spark, sf_dir):
    """Anchors whose text begins with a certain letter and whose target with another."""
    found = sources.anchors(read(spark, sf_dir, "pages"))
    return sources.matching_links(found, r"^[a-m]", r"^/[A-F]", "text", "href").select("page_id", "href", "text")


@sources.register("page-anchors")
def _page_anchors(spark, config):
    return sources.anchors(read(spark, config["dir"], "pages")).select("page_id", "href", F.lit("page-anchors").alias("source"))


def registered_source(spark, sf_dir):
    """Links of a source that is found by its name."""
    return sources.source("page-anchors")(spark, {"dir": sf_dir}).groupBy("source", "href").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ documents
def _files(spark, sf_dir, id_col="paper_id"):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias(id_col), F.encode("text", "UTF-8").alias("content"))


def _extract(raw: bytes):
    return [(k // 40 + 1, k % 40 * 20.0, 56.5, line, k % 40 * 20.0 + 12, 842.0) for k, line in enumerate(raw.decode().split("\n"))]


def extracted_lines(spark, sf_dir):
    """Lines of documents by an extractor that sets forty on a page."""
    return store.extract_lines(_files(spark, sf_dir), _extract).select("paper_id", "seq", "page", "top", F.sha2("text", 256).alias("sha"))


def _count(raw: bytes) -> int:
    if len(raw) % 9 == 0:
        raise ValueError("broken")
    return raw.count(b"\n") + 1


def page_counts(spark, sf_dir):
    """Pages of documents by a counter that fails on some of them."""
    return sources.page_count(_files(spark, sf_dir), _count)


def _fail(raw: bytes) -> bytes:
    raise ValueError("broken")


def compressed_files(spark, sf_dir):
    """Documents through three compressors, one of which always fails and one makes files larger; those of up to 2,000 bytes stay."""
    out = sources.compressed(_files(spark, sf_dir), [_fail, lambda b: b.replace(b" ", b""), lambda b: b + b"!"], 2000)
    return out.select("paper_id", F.sha2("stored", 256).alias("sha"), "note")


def stored_files(spark, sf_dir):
    """Downloads as rows with their hash and size."""
    files = _files(spark, sf_dir).select(F.concat(F.lit("p/"), F.col("paper_id").cast("string"), F.lit(".pdf")).alias("rel_path"), "content")
    return store.stored_bytes(files).select("rel_path", "file_sha256", "size_bytes")


# ------------------------------------------------------------------ tagging, candidates
def _classifier(prompt: str):
    if "que" in prompt:
        return '{"topic_codes": ["vec"], "confidence": 0.7}', len(prompt), 3
    if "the" in prompt.removesuffix(tagging.AGAIN):
        raise OSError("busy")
    return ('{"topic_codes": ["FUNC"]}' if prompt.endswith(tagging.AGAIN) else "I think so"), len(prompt), 2


def classified_texts(spark, sf_dir):
    """Distinct beginnings of documents through a classifier that fails on some and needs a second prompt for others."""
    head = F.substring("text", 1, 60)
    asked = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2(head, 256).alias("text_sha256"), head.alias("prompt")).distinct()
    return tagging.classify(asked, _classifier, sleep=lambda _: None)


def candidates_file(spark, sf_dir):
    """Exams of the orders as the candidates file holds them, read back from it."""
    o = read(spark, sf_dir, "orders")
    groups = o.groupBy(F.concat(F.lit("S"), (F.col("o_custkey") % 25).cast("string")).alias("school_code"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("complete_papers"))
    path = f"{tables.shared_dir(spark)}/lithic-candidates-{uuid.uuid4().hex}"
    ingest.candidates_json(groups, path)
    ingest.candidates_json(groups.limit(0), path)  # an empty result replaces nothing
    return spark.read.schema(groups.schema).json(path)


def clamped_values(spark, sf_dir):
    """Values of orders within bounds, one of which is a column."""
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", T.clamp(F.col("l_quantity").cast("double"), 5.0, F.col("l_linenumber") * 10.0).alias("v"))


QUERIES = {
    f.__name__: f
    for f in (fetched_pages, matching_anchors, registered_source, extracted_lines, page_counts, compressed_files, stored_files, classified_texts, candidates_file, clamped_values)
}

_PAGE_LINKS = """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS t FROM pages),
l AS (SELECT page_id, replace(regexp_extract(t, '"([^"]*)"', 1), '&amp;', '&') AS href, trim(replace(regexp_extract(t, '>([^<]*)<', 1), '&amp;', '&')) AS text FROM a)
"""

ORACLE_SQL = {
    "fetched_pages": """WITH p AS (SELECT url, length(url) AS n FROM pages),
k AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'gone' WHEN n % 11 = 0 THEN 'busy' WHEN n % 5 = 0 THEN 'off' WHEN n % 3 = 0 THEN 'big' ELSE 'ok' END AS kind FROM p)
SELECT url, CASE kind WHEN 'gone' THEN 404 WHEN 'busy' THEN 429 WHEN 'off' THEN NULL ELSE 200 END AS status, CASE WHEN kind IN ('busy', 'off') THEN 2 ELSE 1 END AS attempts,
  CASE kind WHEN 'gone' THEN 'HTTPError: 404' WHEN 'busy' THEN 'HTTPError: 429' WHEN 'off' THEN 'OSError: no route' WHEN 'big' THEN 'TooLarge: 1000 bytes or more' END AS error,
  CASE kind WHEN 'gone' THEN sha256('gone') WHEN 'busy' THEN sha256('') WHEN 'ok' THEN sha256(url) END AS sha FROM k""",
    "matching_anchors": _PAGE_LINKS + "SELECT page_id, href, text FROM l WHERE regexp_matches(text, '(?i)^[a-m]') AND regexp_matches(href, '(?i)^/[A-F]')",
    "registered_source": _PAGE_LINKS + "SELECT 'page-anchors' AS source, href, count(*) AS n FROM l GROUP BY href",
    "extracted_lines": _LINES + """ SELECT paper_id, (row_number() OVER (PARTITION BY paper_id ORDER BY seq) - 1)::INTEGER AS seq, (seq // 40 + 1)::INTEGER AS page, (seq % 40 * 20.0)::DOUBLE AS top, sha256(text) AS sha FROM lines""",
    "page_counts": "SELECT doc_id AS paper_id, CASE WHEN text IS NULL OR strlen(text) % 9 = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END::INTEGER AS pages FROM documents",
    "compressed_files": """WITH f AS (SELECT doc_id, text, replace(text, ' ', '') AS packed, strlen(text) AS n FROM documents), s AS (SELECT *, CASE WHEN n > 2000 THEN packed ELSE text END AS stored FROM f)
SELECT doc_id AS paper_id, sha256(stored) AS sha, CASE WHEN n <= 2000 THEN 'small enough as it is' ELSE 'compressed ' || n || ' -> ' || strlen(stored) || ' bytes (' || round((n - strlen(stored)) * 100.0::DOUBLE / n, 1)::DOUBLE || '% saved)' ||
  CASE WHEN strlen(stored) > 2000 THEN ', above target' ELSE '' END END AS note FROM s""",
    "stored_files": "SELECT 'p/' || doc_id || '.pdf' AS rel_path, sha256(text) AS file_sha256, strlen(text)::BIGINT AS size_bytes FROM documents",
    "classified_texts": f"""WITH h AS (SELECT DISTINCT substring(text, 1, 60) AS p FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN contains(p, 'que') THEN 0 WHEN contains(p, 'the') THEN 1 ELSE 2 END AS kind, length(p)::BIGINT AS n FROM h)
SELECT sha256(p) AS text_sha256, CASE kind WHEN 0 THEN '{{"topic_codes": ["vec"], "confidence": 0.7}}' WHEN 2 THEN '{{"topic_codes": ["FUNC"]}}' END AS body,
  CASE kind WHEN 0 THEN n WHEN 2 THEN 2 * n + {len(tagging.AGAIN)} ELSE 0 END AS input_tokens, CASE kind WHEN 0 THEN 3 WHEN 2 THEN 4 ELSE 0 END::BIGINT AS output_tokens, CASE kind WHEN 1 THEN 'OSError: busy' END AS error FROM k""",
    "candidates_file": "SELECT 'S' || (o_custkey % 25) AS school_code, year(o_orderdate)::INTEGER AS year, count(*) AS complete_papers FROM orders GROUP BY ALL",
    "clamped_values": "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity::DOUBLE, 5.0::DOUBLE), l_linenumber * 10.0::DOUBLE) AS v FROM lineitem",
}
