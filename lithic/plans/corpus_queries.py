"""Ingest, line, page and tagging queries over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic import sources
from lithic.functions import text as T
from lithic.operators import ingest, segment, store, tagging
from lithic.plans.bank_queries import read


# ------------------------------------------------------------------ ingest
def _links(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("u/"), F.col("source"), F.lit("/"), (F.col("doc_id") % 97).cast("string")).alias("url"), F.sha2("text", 256).alias("sha"),
        F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 13 == 0).alias("failed"),
    )


def dedupe_by_sha(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), F.col("doc_id").alias("ord"), "source")
    return ingest.unique_by_sha(rows)


def ingest_status(spark, sf_dir):
    links = _links(spark, sf_dir)
    old = links.where(F.col("ord") % 11 == 0)
    return ingest.ingest_states(links, old.select("url"), old.select("sha"), 6000).select("ord", "url", "size", "state")


def ingest_summary(spark, sf_dir):
    return ingest.summary(ingest_status(spark, sf_dir))


def upsert_merge(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.col("n_chars").alias("size"))
    old, new = d.where(F.col("id") % 3 > 0), d.where(F.col("id") % 2 == 0).select("id", F.upper("lang").alias("lang"), F.lit("new").alias("source"), (F.col("size") * 2).alias("size"), F.col("id").alias("ord"))
    return ingest.upsert(old, new, ["id"], ["lang", "size"])


def filename_suffix(spark, sf_dir):
    """Names by source, language and size; the first labelled document of a name holds it already or, with an odd id, the name with _b."""
    name = F.concat("source", F.lit("_"), "lang", F.lit("_"), (F.col("n_chars") / 400).cast("int").cast("string"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), name.alias("stem"), F.sha2("text", 256).alias("sha"))
    labelled = d.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord")), "ord", "left_semi")
    first = labelled.groupBy("stem").agg(F.min(F.struct("ord", "sha")).alias("f"))
    taken = first.select(F.concat("stem", F.when(F.col("f.ord") % 2 == 1, "_b").otherwise(""), F.lit(".pdf")).alias("name"), "f.sha")
    return ingest.free_names(d.select("ord", F.concat("stem", F.lit(".pdf")).alias("name"), "sha"), taken).select("ord", "name", "rel_path")


def crawl_log_summary(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    h = sources.host(F.col("url"))
    links = p.select(
        F.regexp_extract(h, r"([a-z]+)$", 1).alias("source"), F.concat(h, F.lit("|"), (F.col("page_id") % 7).cast("string")).alias("exam_key"),
        F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("Error: page "), F.col("page_id").cast("string"))).alias("error"),
    )
    return ingest.crawl_log(links, F.lit("2025-01-01T00:00:00+00:00"), 5)


# ------------------------------------------------------------------ lines
def line_explode_order(spark, sf_dir):
    lines = segment.lines_of_text(read(spark, sf_dir, "documents"))
    placed = lines.withColumn("page", (F.col("seq") / 20).cast("int") + 1).withColumn("top", (F.col("seq") % 20) * 12.04).withColumn("x0", F.lit(56.6))
    return segment.reading_order(placed).select("paper_id", "line_index", "page", F.sha2("text", 256).alias("sha"))


def repeated_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    lines = d.select("source", F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text")).where(F.length(F.trim("text")) > 0)
    return segment.repeated_lines(lines, "source", "page", 0.02).select("source", "text", "n_pages")


def strip_furniture(spark, sf_dir):
    """Each source is a paper and each document a page; the first and last lines of a document stand in its margins."""
    lines = segment.lines_of_text(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("paper_id", "page")
    last = F.max("seq").over(Window.partitionBy("page"))
    placed = lines.withColumn("_l", last).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("source").alias("paper_id")), "page")
    top = F.when(F.col("seq") == 0, 20.0).when(F.col("seq") == F.col("_l"), 800.0).otherwise(300.0)
    placed = placed.withColumn("top", top).withColumn("bottom", top + 12).withColumn("page_height", F.lit(842.0)).withColumn("x0", F.lit(56.6)).drop("_l")
    kept = segment.strip_furniture(placed, share=0.02)
    return kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("seq").alias("seqs"), F.sum("page").alias("pages"))


def candidate_lines(spark, sf_dir):
    """Every third line of a document gets a number in one of four forms, some right of the gutter."""
    lines = segment.lines_of_text(read(spark, sf_dir, "documents"))
    n = F.col("seq") + 1
    body = F.when(n % 3 > 0, F.col("text")).when(n % 4 == 0, F.concat((n % 60).cast("string"), F.lit(". "), F.col("text"))).when(n % 4 == 1, (n % 60).cast("string")).when(n % 4 == 2, F.concat((n % 60).cast("string"), F.lit(" ,"))).otherwise(F.concat(F.lit("  "), (n % 60).cast("string"), F.lit(") "), F.col("text")))
    placed = lines.select("paper_id", F.col("seq").alias("line_index"), F.lit(1).alias("page"), F.when(F.col("seq") % 5 == 4, 294.6).otherwise(56.6).alias("x0"), body.alias("text"))
    return segment.candidates(placed).select("paper_id", "line_index", "q_number", "x0")


def _exam_lines(spark, sf_dir):
    """Documents as papers of 20 lines a page: of three lines the first gets a question number in the gutter (one in seven is left out), the second a part label, the third marks."""
    lines = segment.lines_of_text(read(spark, sf_dir, "documents"))
    k, place = (F.col("seq") / 3).cast("int") + 1, F.col("seq") % 20
    numbered = (F.col("seq") % 3 == 0) & ((F.col("paper_id") + k) % 7 > 0) & (k <= 99)
    text = (
        F.when(numbered, F.concat(k.cast("string"), F.lit(". "), "text")).when(F.col("seq") % 3 == 1, F.concat(F.when(F.col("paper_id") % 2 == 0, "(a) ").otherwise("(II) "), F.col("text")))
        .when(F.col("seq") % 3 == 2, F.concat("text", F.lit(" ["), (F.col("seq") % 9 + 1).cast("string"), F.lit("]"))).otherwise(F.col("text"))
    )
    return lines.select(
        "paper_id", "seq", ((F.col("seq") / 20).cast("int") + 1).alias("page"), (place * 39.0 + 40).alias("top"), F.when(numbered, 56.6).otherwise(150.0).alias("x0"),
        text.alias("text"), (place * 39.0 + 52).alias("bottom"), F.lit(842.0).alias("page_height"),
    )


def segment_questions(spark, sf_dir):
    """The questions of all papers, with their crop boxes."""
    found, _ = segment.split_papers(_exam_lines(spark, sf_dir), low_text=300)
    return found.select("paper_id", "q_number", F.array_join("part_labels", ",").alias("parts"), "page_start", "page_end", "y_top", "y_bottom", "marks_total", "text_sha256", "needs_ocr", "extract_confidence")


def split_papers(spark, sf_dir):
    """One row a paper: signals, status and notes."""
    _, papers = segment.split_papers(_exam_lines(spark, sf_dir), low_text=300)
    return papers.select("paper_id", "n", "n_candidates", "n_gaps", "with_marks", "total_marks", "confidence", "parse_status", "n_stripped", F.array_join("low_pages", ",").alias("low_pages"), F.array_join("notes", "; ").alias("notes"))


def crop_slices(spark, sf_dir):
    """The pages of each question's crop."""
    q = segment_questions(spark, sf_dir).where("page_end >= page_start").withColumn("page_height", F.lit(842.0))
    return segment.page_slices(q).select("paper_id", "q_number", F.col("page").cast("int").alias("page"), "y0", "y1")


# ------------------------------------------------------------------ pages
def anchors(spark, sf_dir):
    return sources.anchors(read(spark, sf_dir, "pages")).select("page_id", "pos", "href", "link")


def host_policy(spark, sf_dir):
    """Hosts of odd length have no rules, those whose length four divides forbid all to all, the others have rules for `bot` and for `*`."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    rule = lambda pos, agent, prefix, allow: F.struct(F.lit(pos).alias("pos"), F.lit(agent).alias("agent"), F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow"))
    some = F.array(rule(0, "*", "/en/1", True), rule(1, "*", "/en/", False), rule(2, "*", "/en/2", True), rule(3, "Bot", "/", False))
    rules = F.when(F.length("host") % 4 == 0, F.array(rule(0, "*", "/", False))).otherwise(some)
    robots = p.select(sources.host(F.col("url")).alias("host")).distinct().where(F.length("host") % 2 == 0).select("host", F.explode(rules).alias("r")).select("host", "r.*")
    out = sources.allowed(p, robots, ("bot/1.0", "*"))
    out = out.withColumn("delay", sources.crawl_delay(F.when(F.length("host") % 3 == 0, (F.length("host") % 7).cast("double")), 2.0)).withColumn("ord", F.col("page_id"))
    return sources.schedule(out).select("page_id", "host", "allowed", "delay", "start_at")


def retry_schedule(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 9).alias("attempt"), (400 + F.col("event_id") % 130).cast("int").alias("status"))
    return e.where(sources.retryable(F.col("status"))).select("event_id", "status", sources.backoff(F.lit(2.0), F.col("attempt")).alias("wait"))


def link_metadata(spark, sf_dir):
    """Titles built from page ids and customer-like codes; all detectors at once."""
    p = read(spark, sf_dir, "pages").select("page_id")
    codes = F.array(*map(F.lit, ["RI", "Hwa Chong", "st andrew's", "NYJC", "victoria junior college", "xri", "MI (promo)", "Temasek mid year", "Anglo-Chinese ct", "mi%ri", "Raffles Institution vjc", "É. Ñuñez rí"]))
    kinds = F.array(*map(F.lit, ["P1 QP", "Paper 2 Solutions", "Paper 1 question with answers", "P2 ms", "worked paper", "2 qp"]))
    i = F.col("page_id").cast("int")
    title = F.concat_ws("_", (F.lit(2005) + i % 30).cast("string"), F.get(codes, i % 12), F.get(kinds, i % 6))
    return T.with_metadata(p.select("page_id", title.alias("title")), "title")


def detect_year(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    t = F.concat_ws(" ", F.lit("exam"), F.concat(F.lit("20"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")), F.concat(F.lit("x2019_"), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", T.year(t).alias("year"))


def absolute_urls(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    href = F.get(F.array(*map(F.lit, ["/a/b.zip", "c.pdf?x=1", "//other.example.org/z", "https://a.example.com/q", "d/e", "?page=2", "#t", "../x", "./y/../z", ""])), (F.col("page_id") % 10).cast("int"))
    return p.select("page_id", T.absolute_url(F.col("url"), href).alias("link"))


def zip_archives(spark, sf_dir):
    """Each page as an archive whose members' names follow its id."""
    le = lambda x, n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(255)), 2, "0") for k in range(n)]))
    zero = lambda n: F.unhex(F.lit("00" * n))
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.get(F.array(*map(F.lit, [".PDF", ".txt", "/../x.pdf", "/", ":y.pdf", "/in/z.pdf"])), (F.col("page_id") % 6).cast("int"))).alias("name"), F.length("html").alias("n"))
    n = F.length("name")
    entry = F.concat(F.unhex(F.lit("504B0102")), zero(20), le(F.col("n"), 4), le(n, 2), zero(16), F.col("name").cast("binary"))
    end = F.concat(F.unhex(F.lit("504B0506")), zero(4), le(F.lit(1), 2), le(F.lit(1), 2), le(F.lit(46) + n, 4), zero(6))
    return p.select("page_id", F.concat(entry, end).alias("content"))


def zip_members(spark, sf_dir):
    """Members of archives, listed from the central directory of their bytes."""
    return sources.zip_listing(zip_archives(spark, sf_dir), "page_id").select(F.col("id").alias("page_id"), "name", "size", "is_pdf").withColumn("safe", sources.safe_member(F.col("name")))


def decode_bom(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    out = sources.decoded(d.select("doc_id", raw.alias("content"), F.lit(None).cast("string").alias("charset")))
    return out.select("doc_id", "encoding", F.sha2("text", 256).alias("sha"))


def fold_accents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(T.fold_accents(F.col("text"))), 256).alias("sha"))


def smallest_version(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("original"), F.encode("text", "UTF-16LE").alias("wide"), F.encode(F.trim(F.regexp_replace("text", " +", " ")), "UTF-8").alias("packed"))
    return sources.smallest_version(d, "doc_id", ["original", "wide", "packed"])


# ------------------------------------------------------------------ tags
#: Rules over the words of `documents`; boundaries are spelled out, as \b differs beside accents between engines.
WORD_RULES = {
    "ART": (r"(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)", r"(^|[^\p{L}\p{N}_])la([^\p{L}\p{N}_]|$)", r"(^|[^\p{L}\p{N}_])der([^\p{L}\p{N}_]|$)"),
    "CONJ": (r"(^|[^\p{L}\p{N}_])and([^\p{L}\p{N}_]|$)", r"(^|[^\p{L}\p{N}_])und([^\p{L}\p{N}_]|$)"),
    "LIC": (r"licensed under", r"public license"),
    "BAD": (r"[*&%$]{3}", r"!!"),
    "TAB": (r" \| ",),
}


def rule_tags(spark, sf_dir):
    d = tagging.rule_decisions(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", WORD_RULES)
    return d.select("doc_id", "reason", F.array_join(F.transform("tags", lambda t: F.concat(t["code"], F.lit(":"), t["confidence"].cast("string"))), "|").alias("tags"))


def rule_reasons(spark, sf_dir):
    return ingest.summary(rule_tags(spark, sf_dir), "reason")


def topic_rules(spark, sf_dir):
    """The topic table on texts made of part names and topic phrases."""
    phrases = F.array(*map(F.lit, ["Find the binomial distribution B(12, 0.3)", "Sketch the curve and state its asymptotes", "solve the inequality", "position vector of the plane", "Solve", "sum to infinity of a geometric progression"]))
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.get(phrases, (F.col("p_partkey") % 6).cast("int"))).alias("full_text"))
    d = tagging.rule_decisions(p)
    return d.select("p_partkey", "reason", F.array_join(F.transform("tags", lambda t: t["code"]), ",").alias("codes"))


def tag_routing(spark, sf_dir):
    d = tagging.rule_decisions(read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256")), "text", WORD_RULES, 2)
    seen = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    answer = F.struct(F.array(F.when(F.col("quality") == 1, "GOOD").otherwise("POOR")).alias("topic_codes"), F.lit(0.5).alias("confidence"))
    cache = seen.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.max(F.struct(F.lit("m").alias("model"), answer.alias("response"))).alias("x")).select("text_sha256", "x.*")
    out = tagging.route(d, cache, "m")
    return out.select("doc_id", "outcome", F.array_join(F.transform("tags", lambda t: t["code"]), ",").alias("codes"))


def routing_summary(spark, sf_dir):
    return ingest.summary(tag_routing(spark, sf_dir), "outcome")


def reply_validate(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    codes = F.array(*map(F.lit, ['["vec","FUNC","vec"]', '["NOPE"]', '["DIFF",3,"macl","PROB","NORM"]', '"VEC"', "[]", '[" hypo "]']))
    i = F.col("event_id")
    body = F.concat(F.when(i % 4 == 0, "```json\n").otherwise(""), F.lit('{"topic_codes": '), F.get(codes, (i % 6).cast("int")), F.lit(', "confidence": '), ((i % 30) / 10.0 - 1).cast("string"), F.when(i % 7 > 0, "}").otherwise(""), F.when(i % 4 == 0, "\n```").otherwise(""))
    r = tagging.reply(body, [c for c, _, _ in tagging.TOPICS])
    return e.select("event_id", r.alias("r")).select("event_id", F.array_join("r.topic_codes", ",").alias("codes"), "r.confidence")


def text_cuts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.char_length("text").cast("long").alias("chars"), T.first_line(F.col("text")).alias("first_line"), F.sha2(T.clip(F.col("text")), 256).alias("clip_sha"))


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_by_sha, ingest_status, ingest_summary, upsert_merge, filename_suffix, crawl_log_summary, line_explode_order, repeated_lines, strip_furniture, candidate_lines, segment_questions, split_papers, crop_slices, anchors, host_policy,
        retry_schedule, link_metadata, detect_year, absolute_urls, zip_members, decode_bom, fold_accents, smallest_version, rule_tags, rule_reasons, topic_rules, tag_routing, routing_summary,
        reply_validate, text_cuts,
    )
}

_LINES = r"""
WITH raw AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq, unnest(string_split(text, chr(10))) AS t FROM documents),
lines AS (SELECT doc_id AS paper_id, seq, regexp_replace(t, '\s+$', '') AS text FROM raw WHERE regexp_replace(t, '\s+$', '') <> '')"""
# numbers stand once each and ascend, so the longest chain is all of them up to the first step of more than two, if it begins at one or two
_EXAM = _LINES + r""",
e AS (SELECT paper_id, seq, seq // 3 + 1 AS k, seq % 3 = 0 AND (paper_id + seq // 3 + 1) % 7 > 0 AND seq // 3 + 1 <= 99 AS num, text AS raw, (seq // 20 + 1)::INTEGER AS page, (seq % 20 * 39.0 + 40)::DOUBLE AS top FROM lines),
f AS (SELECT *, CASE WHEN num THEN k || '. ' || raw WHEN seq % 3 = 1 THEN CASE WHEN paper_id % 2 = 0 THEN '(a) ' ELSE '(II) ' END || raw WHEN seq % 3 = 2 THEN raw || ' [' || (seq % 9 + 1) || ']' ELSE raw END AS t,
  top + 12 AS bottom, CASE WHEN num THEN 56.6 ELSE 150.0 END AS x0, max(page) OVER (PARTITION BY paper_id) AS total FROM e),
g AS (SELECT *, top < 842 * 0.08 OR bottom > 842 * 0.90 AS edge, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+', ' ', 'g') AS flat FROM f),
again AS (SELECT paper_id, flat, true AS yes FROM g WHERE edge AND length(flat) >= 8 AND NOT regexp_matches(flat, '^\s*\d{1,3}\s*$') GROUP BY paper_id, flat, total HAVING count(DISTINCT page) >= greatest(2, floor(total * 0.4))),
h AS (SELECT g.*, row_number() OVER (PARTITION BY g.paper_id ORDER BY seq) - 1 AS idx FROM g LEFT JOIN again USING (paper_id, flat)
  WHERE total < 2 OR NOT (edge AND (yes IS NOT NULL OR (regexp_matches(flat, '^\s*\d{1,3}\s*$') AND x0 > 120) OR regexp_matches(flat, '(?i)(?:\bturn over\b|^\s*©|\b\d{4}/\d{2}(?:/[A-Z0-9]+)*\b|\bblank page\b|\bend of paper\b)')))),
low AS (SELECT paper_id, p, total FROM (SELECT DISTINCT paper_id, total, unnest(generate_series(1, total)) AS p FROM f) LEFT JOIN (SELECT paper_id, page AS p, sum(length(trim(t))) AS n FROM f GROUP BY ALL) USING (paper_id, p) WHERE coalesce(n, 0) < 300),
cand AS (SELECT paper_id, idx, k, k - lag(k) OVER w AS step, first_value(k) OVER w AS k1 FROM h WHERE num AND length(regexp_replace(raw, '^\s+', '')) >= 3 WINDOW w AS (PARTITION BY paper_id ORDER BY idx)),
chain AS (SELECT * FROM (SELECT *, sum(CASE WHEN step > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY idx) AS broken FROM cand) WHERE k1 <= 2 AND broken = 0),
seg AS (SELECT * FROM (SELECT h.*, chain.k AS start, last_value(chain.k IGNORE NULLS) OVER (PARTITION BY h.paper_id ORDER BY h.idx) AS q FROM h LEFT JOIN chain USING (paper_id, idx)) WHERE q IS NOT NULL),
s2 AS (SELECT *, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS st, length(st) >= 3 AND NOT regexp_matches(st, '^\s*\d{1,3}\s*$') AS solid, regexp_extract(t, '[\[(](\d{1,2})[\])]\s*$', 1) AS mark,
  lower(regexp_extract(CASE WHEN start IS NOT NULL THEN regexp_replace(raw, '^\s+', '') ELSE t END, '(?i)^\s*\(([ivx]{1,4}|[a-h])\)\s', 1)) AS part FROM seg),
parts AS (SELECT paper_id, q, string_agg('(' || part || ')', ',' ORDER BY i) AS parts FROM (SELECT paper_id, q, part, min(idx) AS i FROM s2 WHERE part <> '' GROUP BY ALL) GROUP BY paper_id, q),
a1 AS (SELECT paper_id, q, min(idx) AS i0, arg_min(page, idx) AS p0, arg_min(top, idx) AS t0, arg_min(bottom, idx) AS b0, arg_max(page, idx) FILTER (WHERE solid) AS tail, sum(CASE WHEN mark <> '' THEN mark::INTEGER END)::INTEGER AS marks_total,
  sha256(regexp_replace(regexp_replace(string_agg(t, chr(10) ORDER BY idx), '^\s+', ''), '\s+$', '')) AS text_sha256 FROM s2 GROUP BY paper_id, q),
a2 AS (SELECT *, greatest(coalesce(tail, p0), p0) AS pe, lead(p0) OVER w AS np, lead(t0) OVER w AS nt FROM a1 WINDOW w AS (PARTITION BY paper_id ORDER BY i0)),
a3 AS (SELECT a2.*, coalesce((SELECT max(bottom) FROM s2 WHERE s2.paper_id = a2.paper_id AND s2.q = a2.q AND solid AND page = pe), b0) + 8 AS lowest FROM a2),
a4 AS (SELECT *, CASE WHEN np < pe THEN np ELSE pe END AS page_end, greatest(0, t0 - 8) AS yt, CASE WHEN np < pe THEN nt - 4 WHEN np = pe THEN least(lowest, nt - 4) ELSE lowest END AS yb FROM a3),
box AS (SELECT paper_id, q::INTEGER AS q_number, coalesce(parts, '') AS parts, p0 AS page_start, page_end, round(yt, 2) AS y_top, round(CASE WHEN p0 = page_end THEN greatest(yb, yt + 12) ELSE yb END, 2) AS y_bottom, marks_total, text_sha256,
  EXISTS (SELECT 1 FROM low WHERE low.paper_id = a4.paper_id AND p BETWEEN p0 AND page_end) AS needs_ocr FROM a4 LEFT JOIN parts USING (paper_id, q)),
n1 AS (SELECT paper_id, count(*) AS n, count(*) FILTER (WHERE marks_total > 0) AS with_marks, coalesce(sum(marks_total), 0)::BIGINT AS total_marks, list_sort(list(q_number)) AS numbers FROM box GROUP BY paper_id),
n2 AS (SELECT paper_id, count(*) AS nc FROM cand GROUP BY paper_id), n3 AS (SELECT paper_id, count(*) FILTER (WHERE step = 2 OR (step IS NULL AND k = 2)) AS ng FROM chain GROUP BY paper_id),
n4 AS (SELECT paper_id, count(*) AS lines_ FROM f GROUP BY paper_id), n5 AS (SELECT paper_id, count(*) AS kept FROM h GROUP BY paper_id), n6 AS (SELECT paper_id, string_agg(p::VARCHAR, ',' ORDER BY p) AS lp, string_agg(p::VARCHAR, ', ' ORDER BY p) AS lpn FROM low GROUP BY paper_id),
n7 AS (SELECT n4.paper_id, coalesce(n, 0) AS n, coalesce(with_marks, 0) AS with_marks, coalesce(total_marks, 0) AS total_marks, coalesce(numbers, []) AS numbers, coalesce(nc, 0) AS n_candidates, coalesce(ng, 0)::INTEGER AS n_gaps,
  lines_ - coalesce(kept, 0) AS n_stripped, coalesce(lp, '') AS low_pages, lpn FROM n4 LEFT JOIN n1 USING (paper_id) LEFT JOIN n2 USING (paper_id) LEFT JOIN n3 USING (paper_id) LEFT JOIN n5 USING (paper_id) LEFT JOIN n6 USING (paper_id)),
n8 AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round(0.20::DOUBLE * (1.0::DOUBLE - least(0.5::DOUBLE, greatest(0, n_candidates - n)::DOUBLE / n_candidates)) + 0.15::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.15::DOUBLE * n_gaps) + 0.25::DOUBLE * (with_marks::DOUBLE / n)
  + 0.20::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN n < 10 THEN 10 - n WHEN n > 13 THEN n - 13 ELSE 0 END)::DOUBLE / 5.0::DOUBLE) + 0.20::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(total_marks - 100)::DOUBLE / 20.0::DOUBLE), 3) END AS confidence FROM n7),
paper AS (SELECT *, CASE WHEN n > 0 AND confidence >= 0.6 THEN 'ok' WHEN n > 0 THEN 'partial' ELSE 'failed' END AS parse_status, concat_ws('; ', CASE WHEN n = 0 THEN 'no incrementing question numbers found in the gutter' END,
  CASE WHEN n > 0 AND (n < 10 OR n > 13) THEN n || ' questions detected, outside the expected 10-13' END,
  CASE WHEN n > 0 AND n_gaps > 0 THEN 'question number(s) not detected: [' || array_to_string(list_filter(range(1, list_max(numbers) + 1), lambda x: NOT list_contains(numbers, x)), ', ') || ']' END,
  CASE WHEN n > 0 AND total_marks <> 100 THEN 'marks total ' || total_marks || ', expected 100' END, CASE WHEN n_stripped > 0 THEN n_stripped || ' running lines left out' END, CASE WHEN lpn IS NOT NULL THEN 'little text on page(s) ' || lpn END) AS notes FROM n8)
"""
# one link after the other, with what is stored so far
_STATES = """
WITH RECURSIVE l AS (SELECT doc_id AS ord, 'u/' || source || '/' || (doc_id % 97) AS url, sha256(text) AS sha, strlen(text)::BIGINT AS size, doc_id % 13 = 0 AS failed FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM l),
w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS ord, '' AS url, 0::BIGINT AS size, '' AS state, (SELECT list(url) FROM l WHERE ord % 11 = 0) AS urls, (SELECT list(sha) FROM l WHERE ord % 11 = 0) AS shas
  UNION ALL SELECT k, ord, url, size, state, CASE WHEN state = 'new' THEN list_append(urls, url) ELSE urls END, CASE WHEN state = 'new' THEN list_append(shas, sha) ELSE shas END
  FROM (SELECT n.k, n.ord, n.url, n.size, n.sha, w.urls, w.shas, CASE WHEN list_contains(w.urls, n.url) THEN 'skipped' WHEN n.failed THEN 'failed' WHEN n.size >= 6000 THEN 'refused' WHEN list_contains(w.shas, n.sha) THEN 'duplicate' ELSE 'new' END AS state
    FROM w JOIN n ON n.k = w.k + 1)),
s AS (SELECT ord, url, size, state FROM w WHERE k > 0)
"""
_W = r"(^|[^\p{L}\p{N}_])%s([^\p{L}\p{N}_]|$)"


def _hits(rules: dict) -> str:
    cols = ", ".join("(" + " + ".join("regexp_matches(text, '(?i){}')::INT".format(p.replace("'", "''")) for p in ps) + f") AS {c}" for c, ps in rules.items())
    codes = "list_filter([" + ", ".join(f"CASE WHEN {c} > 0 THEN '{c}' END" for c in sorted(rules)) + "], lambda x: x IS NOT NULL)"
    conf = "list_filter([" + ", ".join(f"CASE WHEN {c} > 0 THEN '{c}:' || round(least(0.95, 0.55 + 0.15 * {c})::DOUBLE, 2) END" for c in sorted(rules)) + "], lambda x: x IS NOT NULL)"
    return f"h AS (SELECT doc_id, text, {cols} FROM documents), r AS (SELECT doc_id, text, {codes} AS codes, {conf} AS tags FROM h)"


_REASON = "CASE WHEN len(codes) = 0 THEN 'no rule hits' WHEN len(codes) > {0} THEN 'conflicting rule hits (' || len(codes) || ' topics: ' || array_to_string(codes, ',') || ')' ELSE '' END"
_BASE_SQL = r"""regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)//', 1) AS scheme, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS root,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS folder"""
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_ROUTE = "WITH " + _hits(WORD_RULES) + """,
cache AS (SELECT sha256(text) AS sha, max(CASE WHEN quality = 1 THEN 'GOOD' ELSE 'POOR' END) AS code FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
t AS (SELECT doc_id, CASE WHEN len(codes) BETWEEN 1 AND 2 THEN 'rule' WHEN code IS NOT NULL THEN 'llm_cached' ELSE 'skipped_no_llm' END AS outcome,
  CASE WHEN len(codes) BETWEEN 1 AND 2 THEN array_to_string(codes, ',') ELSE coalesce(code, '') END AS codes FROM r LEFT JOIN cache ON sha = sha256(text))
"""

_ALIASES = ", ".join(f"({i}, '{a}', '{c}', '{n.replace(chr(39), chr(39) * 2)}', {a in T.BOUNDED})" for i, (a, c, n) in enumerate(T.aliases()))
_SAYS = lambda words: " OR ".join(f"contains(flat, '{w}')" for w in words)
_METADATA = rf"""WITH p AS (SELECT page_id, concat_ws('_', (2005 + page_id % 30)::VARCHAR, ['RI', 'Hwa Chong', 'st andrew''s', 'NYJC', 'victoria junior college', 'xri', 'MI (promo)', 'Temasek mid year', 'Anglo-Chinese ct', 'mi%ri', 'Raffles Institution vjc', 'É. Ñuñez rí'][page_id % 12 + 1],
  ['P1 QP', 'Paper 2 Solutions', 'Paper 1 question with answers', 'P2 ms', 'worked paper', '2 qp'][page_id % 6 + 1]) AS title FROM pages),
b AS (SELECT page_id, title, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[_\-+%]+', ' ', 'g'), '\s+', ' ', 'g')) AS blob FROM p),
f AS (SELECT *, ' ' || trim(regexp_replace(blob, '[^a-z0-9]+', ' ', 'g')) || ' ' AS flat FROM b),
a(i, alias, code, name, bounded) AS (VALUES {_ALIASES}),
m AS (SELECT page_id, arg_min(code, length(alias) * -1000 + i) AS code, arg_min(name, length(alias) * -1000 + i) AS name FROM f JOIN a ON CASE WHEN bounded THEN regexp_matches(blob, '(^|[^a-z])' || alias || '([^a-z]|$)') ELSE contains(blob, alias) END GROUP BY page_id)
SELECT f.page_id, title, coalesce(code, 'UNK') AS school_code, coalesce(name, 'Unknown') AS school,
  list_max(list_filter(list_transform(regexp_extract_all(regexp_replace(title, '(\d+)', ' \1 ', 'g'), '(^|\D)(20\d\d)\D', 2), lambda x: x::INTEGER), lambda y: y BETWEEN 2010 AND 2030)) AS year,
  try_cast(coalesce(nullif(regexp_extract(blob, '\b(?:paper|p)\s*([12])\b', 1), ''), nullif(regexp_extract(blob, '\b([12])\s*(?:qp|ms)\b', 1), '')) AS INTEGER) AS paper_no,
  CASE WHEN ({_SAYS(T.SCHEME_WORDS)}) AND ({_SAYS(T.QUESTION_WORDS)}) THEN 'combined' WHEN {_SAYS(T.SCHEME_WORDS)} THEN 'ms' ELSE 'qp' END AS doc_type,
  CASE WHEN contains(blob, 'prelim') THEN 'prelim' WHEN contains(blob, 'promo') THEN 'promo' WHEN contains(blob, 'mid year') OR contains(blob, 'midyear') OR contains(blob, 'mye') THEN 'mye' WHEN contains(blob, 'common test') OR blob = 'ct' THEN 'ct' ELSE 'prelim' END AS exam_type
FROM f LEFT JOIN m USING (page_id)"""

ORACLE_SQL = {
    "dedupe_by_sha": "SELECT sha256(text) AS sha, min(doc_id) AS ord, arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY sha256(text)",
    "ingest_status": _STATES + "SELECT ord, url, size, state FROM s",
    "ingest_summary": _STATES + "SELECT state, count(*) AS n FROM s GROUP BY state",
    "upsert_merge": """WITH d AS (SELECT doc_id AS id, lang, source, n_chars AS size FROM documents), o AS (SELECT * FROM d WHERE id % 3 > 0), n AS (SELECT id, upper(lang) AS lang, 'new' AS source, size * 2 AS size FROM d WHERE id % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.lang, o.lang) AS lang, coalesce(o.source, n.source) AS source, coalesce(n.size, o.size)::BIGINT AS size FROM o FULL JOIN n ON o.id = n.id""",
    # of a name's hashes, in the order of their first rows, the one of the file at _b goes there unless the name itself is free; others take what is free
    "filename_suffix": """WITH d AS (SELECT doc_id AS ord, source || '_' || lang || '_' || (n_chars // 400) AS stem, sha256(text) AS sha FROM documents),
t AS (SELECT stem, min(ord) % 2 = 1 AS b, arg_min(sha, ord) AS tsha FROM d WHERE ord IN (SELECT doc_id FROM labels) GROUP BY stem),
f AS (SELECT stem, sha, min(ord) AS o FROM d GROUP BY stem, sha),
g AS (SELECT f.*, b, tsha, row_number() OVER (PARTITION BY f.stem ORDER BY o) AS k FROM f LEFT JOIN t USING (stem)),
h AS (SELECT *, CASE WHEN NOT b AND sha = tsha THEN 1 WHEN b AND k > 1 AND sha = tsha THEN 2 END AS own FROM g),
p AS (SELECT *, count(*) FILTER (WHERE own IS NULL) OVER (PARTITION BY stem ORDER BY o) AS m FROM h),
q AS (SELECT *, coalesce(own, CASE WHEN b IS NULL THEN m WHEN NOT b THEN m + 1 WHEN m = 1 THEN 1 ELSE m + 1 END) AS slot FROM p)
SELECT d.ord, d.stem || '.pdf' AS name, CASE WHEN slot <= 5 THEN d.stem || ['', '_b', '_c', '_d', '_e'][slot] || '.pdf' END AS rel_path FROM d JOIN q USING (stem, sha)""",
    "crawl_log_summary": f"""WITH l AS (SELECT regexp_extract({_HOST}, '([a-z]+)$', 1) AS source, {_HOST} || '|' || (page_id % 7) AS exam_key, CASE WHEN page_id % 9 = 0 THEN 'Error: page ' || page_id END AS error FROM pages)
SELECT source, count(*) FILTER (WHERE error IS NULL) AS urls_seen, count(DISTINCT exam_key) AS new_papers, count(error) AS n_errors,
  '[' || coalesce(array_to_string(list_transform((list_sort(list(DISTINCT error) FILTER (WHERE error IS NOT NULL)))[1:5], lambda x: '"' || x || '"'), ','), '') || ']' AS errors, '2025-01-01T00:00:00+00:00' AS run_at FROM l GROUP BY source""",
    "line_explode_order": _LINES + "SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY seq)::INTEGER - 1 AS line_index, (seq // 20 + 1)::INTEGER AS page, sha256(text) AS sha FROM lines",
    "repeated_lines": r"""WITH l AS (SELECT source, doc_id AS page, regexp_replace(trim(t), '\s+', ' ', 'g') AS text FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE length(trim(t)) > 0),
n AS (SELECT source, count(DISTINCT page) AS total FROM l GROUP BY source)
SELECT source, text, count(DISTINCT page) AS n_pages FROM l JOIN n USING (source) GROUP BY source, text, total HAVING count(DISTINCT page) >= greatest(2, floor(total * 0.02))""",
    "strip_furniture": _LINES + r""", p AS (SELECT source AS paper_id, doc_id AS page, seq, regexp_replace(regexp_replace(lines.text, '^\s+', ''), '\s+', ' ', 'g') AS flat, seq = 0 OR seq = max(seq) OVER (PARTITION BY doc_id) AS edge FROM lines JOIN documents ON doc_id = lines.paper_id),
t AS (SELECT paper_id, max(page) AS total FROM p GROUP BY paper_id),
n AS (SELECT paper_id, flat FROM p JOIN t USING (paper_id) WHERE edge AND length(flat) >= 8 AND NOT regexp_matches(flat, '^\s*\d{1,3}\s*$') GROUP BY paper_id, flat, total HAVING count(DISTINCT page) >= greatest(2, floor(total * 0.02)))
SELECT paper_id, count(*) AS n_lines, sum(seq)::BIGINT AS seqs, sum(page)::BIGINT AS pages FROM p JOIN t USING (paper_id) LEFT JOIN (SELECT *, true AS again FROM n) USING (paper_id, flat)
WHERE total < 2 OR NOT (edge AND (again IS NOT NULL OR regexp_matches(flat, '(?i)(?:\bturn over\b|^\s*©|\b\d{4}/\d{2}(?:/[A-Z0-9]+)*\b|\bblank page\b|\bend of paper\b)'))) GROUP BY paper_id""",
    "candidate_lines": _LINES + r""", b AS (SELECT paper_id, seq, CASE WHEN seq % 5 = 4 THEN 294.6 ELSE 56.6 END::DOUBLE AS x0, CASE WHEN (seq + 1) % 3 > 0 THEN text WHEN (seq + 1) % 4 = 0 THEN (seq + 1) % 60 || '. ' || text
  WHEN (seq + 1) % 4 = 1 THEN ((seq + 1) % 60)::VARCHAR WHEN (seq + 1) % 4 = 2 THEN (seq + 1) % 60 || ' ,' ELSE '  ' || (seq + 1) % 60 || ') ' || text END AS t FROM lines),
c AS (SELECT *, regexp_extract(t, '^\s*(\d{1,2})\s*[.)]?\s+(\S.*)$', 1) AS q1, regexp_extract(t, '^\s*(\d{1,2})\s*[.)]?\s+(\S.*)$', 2) AS body, regexp_extract(t, '^\s*(\d{1,2})\s*[.)]?\s*$', 1) AS q2 FROM b WHERE x0 <= 120)
SELECT paper_id, seq::INTEGER AS line_index, try_cast(CASE WHEN q1 <> '' THEN CASE WHEN length(trim(body)) >= 3 THEN q1 END WHEN q2 <> '' THEN q2 END AS INTEGER) AS q_number, x0 FROM c
WHERE CASE WHEN q1 <> '' THEN length(trim(body)) >= 3 ELSE q2 <> '' END""",
    "segment_questions": _EXAM + "SELECT paper_id, q_number, parts, page_start, page_end, y_top, y_bottom, marks_total, text_sha256, needs_ocr, confidence AS extract_confidence FROM box JOIN paper USING (paper_id)",
    "split_papers": _EXAM + "SELECT paper_id, n, n_candidates, n_gaps, with_marks, total_marks, confidence, parse_status, n_stripped, low_pages, notes FROM paper",
    "crop_slices": _EXAM + """SELECT paper_id, q_number, page::INTEGER AS page, CASE WHEN page = page_start THEN y_top ELSE 0.0::DOUBLE END AS y0, CASE WHEN page = page_end THEN y_bottom ELSE 842.0::DOUBLE END AS y1
FROM (SELECT *, unnest(generate_series(page_start, page_end)) AS page FROM box WHERE page_end >= page_start)""",
    "link_metadata": _METADATA,
    "anchors": r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS h FROM pages),
b AS (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(unnest(h), '^["'']|["'']$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&#x27;', ''''), '&#38;', '&'), '&amp;', '&') AS href FROM a),
c AS (SELECT *, """ + _BASE_SQL + r""" FROM b)
SELECT page_id, pos::INTEGER AS pos, href, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN href = '' OR starts_with(href, '#') THEN root || path || query || href
  WHEN starts_with(href, '?') THEN root || path || href WHEN starts_with(href, '/') THEN root || href ELSE root || folder || href END AS link FROM c""",
    "host_policy": rf"""WITH p AS (SELECT page_id, url, {_HOST} AS host, CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) END AS path FROM pages),
d AS (SELECT page_id, host, length(host) % 2 <> 0 OR (length(host) % 4 <> 0 AND (starts_with(path, '/en/1') OR NOT starts_with(path, '/en/'))) AS allowed, greatest(2.0::DOUBLE, CASE WHEN length(host) % 3 = 0 THEN (length(host) % 7)::DOUBLE ELSE 0.0::DOUBLE END) AS delay FROM p)
SELECT *, coalesce(sum(delay) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS start_at FROM d""",
    "retry_schedule": """SELECT event_id, (400 + event_id % 130)::INTEGER AS status, least(120.0::DOUBLE, 2.0::DOUBLE * pow(2.0::DOUBLE, user_id % 9)) AS wait FROM events
WHERE 400 + event_id % 130 = 429 OR 400 + event_id % 130 BETWEEN 500 AND 599""",
    "detect_year": r"""WITH t AS (SELECT o_orderkey, 'exam 20' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ' x2019_' || o_custkey || ' ' || o_orderkey AS t FROM orders)
SELECT o_orderkey, list_max(list_filter(list_transform(regexp_extract_all(regexp_replace(t, '(\d+)', ' \1 ', 'g'), '(^|\D)(20\d\d)\D', 2), lambda x: x::INTEGER), lambda y: y BETWEEN 2010 AND 2030)) AS year FROM t""",
    "absolute_urls": r"""WITH c AS (SELECT page_id, page_id % 10 AS k, """ + _BASE_SQL + r""" FROM pages),
d AS (SELECT *, CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END AS parent FROM c)
SELECT page_id, CASE k WHEN 0 THEN root || '/a/b.zip' WHEN 1 THEN root || folder || 'c.pdf?x=1' WHEN 2 THEN scheme || '//other.example.org/z' WHEN 3 THEN 'https://a.example.com/q' WHEN 4 THEN root || folder || 'd/e'
  WHEN 5 THEN root || path || '?page=2' WHEN 6 THEN root || path || query || '#t' WHEN 7 THEN root || parent || 'x' WHEN 8 THEN root || folder || 'z' ELSE root || path || query END AS link FROM d""",
    "zip_members": r"""WITH m AS (SELECT page_id, length(html)::BIGINT AS size, 'p' || page_id || ['.PDF', '.txt', '/../x.pdf', '/', ':y.pdf', '/in/z.pdf'][page_id % 6 + 1] AS name FROM pages)
SELECT page_id, name, size, ends_with(lower(name), '.pdf') AS is_pdf,
  ends_with(lower(name), '.pdf') AND NOT list_contains(string_split(replace(name, '\', '/'), '/'), '..') AND name[1] NOT IN ('/', '\') AND NOT contains(name, ':') AS safe FROM m""",
    "decode_bom": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-16-le' ELSE 'utf-8' END AS encoding, sha256(text) AS sha FROM documents",
    "fold_accents": "SELECT doc_id, sha256(lower(strip_accents(text))) AS sha FROM documents",
    "smallest_version": """WITH s AS (SELECT doc_id, strlen(text) AS a, length(text) * 2 AS b, strlen(trim(regexp_replace(text, ' +', ' ', 'g'), ' ')) AS c FROM documents)
SELECT doc_id, CASE WHEN a <= b AND a <= c THEN 'original' WHEN b <= c THEN 'wide' ELSE 'packed' END AS chosen, least(a, b, c)::INTEGER AS size FROM s""",
    "rule_tags": "WITH " + _hits(WORD_RULES) + " SELECT doc_id, " + _REASON.format(3) + " AS reason, CASE WHEN len(codes) BETWEEN 1 AND 3 THEN array_to_string(tags, '|') ELSE '' END AS tags FROM r",
    "rule_reasons": "WITH " + _hits(WORD_RULES) + ", x AS (SELECT " + _REASON.format(3) + " AS reason FROM r) SELECT reason, count(*) AS n FROM x GROUP BY reason",
    "topic_rules": "SELECT p_partkey, CASE WHEN p_partkey % 6 = 4 THEN 'no rule hits' ELSE '' END AS reason, ['BINOM', 'GRAPH', 'EQIN', 'VEC', '', 'SEQS'][p_partkey % 6 + 1] AS codes FROM part",
    "tag_routing": _ROUTE + "SELECT * FROM t",
    "routing_summary": _ROUTE + "SELECT outcome, count(*) AS n FROM t GROUP BY outcome",
    "reply_validate": """WITH b AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '```json' || chr(10) ELSE '' END || '{"topic_codes": ' ||
  ['["vec","FUNC","vec"]', '["NOPE"]', '["DIFF",3,"macl","PROB","NORM"]', '"VEC"', '[]', '[" hypo "]'][event_id % 6 + 1] || ', "confidence": ' || ((event_id % 30) / 10.0::DOUBLE - 1)::VARCHAR ||
  CASE WHEN event_id % 7 > 0 THEN '}' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN chr(10) || '```' ELSE '' END AS body FROM events),
j AS (SELECT event_id, regexp_extract(body, '(?s)[{].*[}]') AS t FROM b),
v AS (SELECT event_id, CASE WHEN t <> '' AND json_valid(t) THEN t::JSON END AS t FROM j),
c AS (SELECT event_id, t, CASE WHEN json_type(t, '$.topic_codes') = 'ARRAY' THEN json_extract(t, '$.topic_codes[*]') ELSE [] END AS raw FROM v),
u AS (SELECT event_id, t, list_filter(list_transform(list_filter(raw, lambda x: json_type(x) = 'VARCHAR'), lambda x: upper(x ->> '$')), lambda x: list_contains([""" + ", ".join(f"'{c}'" for c, _, _ in tagging.TOPICS) + """], x)) AS codes FROM c),
d AS (SELECT event_id, t, list_filter(codes, lambda x, i: list_position(codes, x) = i)[1:3] AS codes FROM u)
SELECT event_id, CASE WHEN len(codes) > 0 THEN array_to_string(codes, ',') END AS codes, CASE WHEN len(codes) > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (t ->> '$.confidence')::DOUBLE)) END AS confidence FROM d""",
    "text_cuts": "SELECT doc_id, length(text)::BIGINT AS chars, substring(split_part(text, chr(10), 1), 1, 120) AS first_line, sha256(substring(text, 1, 4000)) AS clip_sha FROM documents",
}
