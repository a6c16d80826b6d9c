"""Queries over the markup and the hosts of pages: live anchors, rules of robots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic import sources
from lithic.plans.bank_queries import read
from lithic.plans.corpus_queries import _BASE_SQL, _HOST
from lithic.sources import robots


def live_anchors(spark, sf_dir):
    """Every page between dead links in comments, scripts and styles, with a base for some, attributes in any order and form, and a tag that never ends."""
    p = read(spark, sf_dir, "pages")
    i = F.col("page_id").cast("string")
    head = F.concat(
        F.when(F.col("page_id") % 3 == 0, "<BASE target=x href='/b/c/'><base href=/late/>").otherwise(""),
        F.lit("""<!-- <a href='/dead1'>no</a> --><script type="t">w("<a href='/dead2'>")</script ><style>a{} /*<a href=/dead3>*/</style>"""),
    )
    tail = F.concat(
        F.lit("""<A CLASS="x > y" data-href='/dead4' HREF = '/live/"""), i, F.lit("""?a=1&amp;b=2#f'>One <b>bold</b>\n text</A><a name=only>none</a><a href=rel/"""), i,
        F.lit(""" title="it's">two<!-- <a href=/dead5> --></a><a href=''>self<a id=1 href="/x" href="/last">three</a><textarea><a href=/dead6></textarea><abbr href=/dead7>"""),
        F.when(F.col("page_id") % 2 == 0, "<a href='/open'>open <i>end").otherwise("<!-- <a href=/dead8> "),
    )
    return sources.anchors(p.select("page_id", "url", F.concat(head, "html", tail).alias("html")))


def _robots_bodies(spark, sf_dir):
    """A robots.txt of every host of the pages: names and paths are those of its own pages; some have none, or an error's status."""
    url, h = F.col("url"), sources.host(F.col("url"))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    hosts = read(spark, sf_dir, "pages").groupBy(h.alias("host")).agg(F.min(path).alias("first"), F.max(path).alias("last"), F.count(F.lit(1)).alias("n"))
    k = F.length("host") + F.col("n")
    name = F.regexp_extract("host", r"([a-z]+)$", 1)
    mine = F.concat(
        F.lit("USER-AGENT : "), F.upper(name), F.lit("bot/2 # name\r\nUser-agent: spare\nAllow: "), "first", F.lit("\nDisallow: /%65n\n  \nDisallow: "), "last", F.lit("\nCrawl-Delay: "), (k % 6).cast("string"),
        F.lit("\nUser-agent: late\nDisallow:\n"),
    )
    everyone = F.concat(F.lit("\nUser-agent: *\nCrawl-delay: x\nCrawl-delay: "), (k % 4 * 3).cast("string"), F.lit("\nAllow: /fr/1\nDisallow: /fr/\nDisallow: "), "last", F.lit("\n\nUser-agent: *\nDisallow: /\n"))
    body = F.concat(
        F.lit("# rules of "), "host", F.lit("\nDisallow: /stray\nUser-agent: other\n\nDisallow: /ended\n"), F.when(k % 2 == 0, mine).otherwise("Sitemap: /s.xml\n"),
        F.when(k % 3 > 0, everyone).otherwise("User-agent: quiet\nCrawl-delay: 9\n"),
    )
    return hosts.select("host", F.when(k % 5 == 1, 404).when(k % 5 > 1, 200).cast("int").alias("status"), F.when(k % 5 != 2, body).alias("body"))


def robots_rules(spark, sf_dir):
    """The rule table of the texts."""
    return robots.table(robots.policies(_robots_bodies(spark, sf_dir)))


def robots_policy(spark, sf_dir):
    """What the texts allow of the pages, and the delay of each page's host."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return robots.applied(pages, robots.policies(_robots_bodies(spark, sf_dir)), ("orgBot/1.0", "*"), 2.0).select("page_id", "host", "allowed", "delay")


QUERIES = {f.__name__: f for f in (live_anchors, robots_rules, robots_policy)}

# a text line by line, with the state that the lines so far leave: 0 outside, 1 after an agent, 2 after a rule
_ROBOTS = rf"""WITH RECURSIVE p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hs AS (SELECT host, min(path) AS first, max(path) AS last, count(*) AS n, length(host) + count(*) AS k, upper(regexp_extract(host, '([a-z]+)$', 1)) AS name FROM p GROUP BY host),
bodies AS (SELECT host, CASE WHEN k % 5 = 1 THEN 404 WHEN k % 5 > 1 THEN 200 END AS status, CASE WHEN k % 5 <> 2 THEN replace('# rules of ' || host || '@Disallow: /stray@User-agent: other@@Disallow: /ended@' ||
  CASE WHEN k % 2 = 0 THEN 'USER-AGENT : ' || name || 'bot/2 # name' || chr(13) || '@User-agent: spare@Allow: ' || first || '@Disallow: /%65n@  @Disallow: ' || last || '@Crawl-Delay: ' || (k % 6) || '@User-agent: late@Disallow:@' ELSE 'Sitemap: /s.xml@' END ||
  CASE WHEN k % 3 > 0 THEN '@User-agent: *@Crawl-delay: x@Crawl-delay: ' || (k % 4 * 3) || '@Allow: /fr/1@Disallow: /fr/@Disallow: ' || last || '@@User-agent: *@Disallow: /@' ELSE 'User-agent: quiet@Crawl-delay: 9@' END, '@', chr(10)) END AS body FROM hs),
ls AS (SELECT host, i - 1 AS pos, raw, trim(regexp_replace(raw, '#.*', ''), ' ' || chr(9)) AS line FROM (SELECT host, generate_subscripts(a, 1) AS i, unnest(a) AS raw
  FROM (SELECT host, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM bodies WHERE body IS NOT NULL AND coalesce(status, 200) < 400))),
f AS (SELECT host, pos, raw, CASE WHEN contains(line, ':') THEN trim(lower(split_part(line, ':', 1)), ' ' || chr(9)) ELSE '' END AS field, trim(substring(line, instr(line, ':') + 1), ' ' || chr(9)) AS value FROM ls),
e AS (SELECT *, CASE WHEN raw = '' THEN 'B' WHEN field = 'user-agent' THEN 'U' WHEN field IN ('allow', 'disallow', 'crawl-delay', 'request-rate') THEN 'R' ELSE '-' END AS kind FROM f),
st AS (SELECT host, 0::BIGINT AS pos, CASE kind WHEN 'U' THEN 1 ELSE 0 END AS state, CASE kind WHEN 'U' THEN 1 ELSE 0 END AS grp, kind = 'U' AS inside FROM e WHERE pos = 0
  UNION ALL SELECT e.host, e.pos::BIGINT, CASE e.kind WHEN 'B' THEN 0 WHEN 'U' THEN 1 WHEN 'R' THEN CASE WHEN st.state > 0 THEN 2 ELSE 0 END ELSE st.state END, st.grp + CASE WHEN e.kind = 'U' AND st.state <> 1 THEN 1 ELSE 0 END,
    e.kind = 'U' OR (e.kind = 'R' AND st.state > 0) FROM st JOIN e ON e.host = st.host AND e.pos = st.pos + 1),
l AS (SELECT e.*, st.grp FROM e JOIN st ON st.host = e.host AND st.pos = e.pos WHERE inside AND kind IN ('U', 'R')),
g AS (SELECT host, grp, list(lower(value) ORDER BY pos) FILTER (WHERE kind = 'U') AS agents, arg_max(try_cast(value AS DOUBLE), pos) FILTER (WHERE field = 'crawl-delay' AND regexp_matches(value, '^\d+$')) AS delay,
  list({{'pos': pos::INTEGER, 'prefix': replace(value, '%65', 'e'), 'allow': field = 'allow'}} ORDER BY pos) FILTER (WHERE field IN ('allow', 'disallow')) AS rules FROM l GROUP BY host, grp HAVING count(*) FILTER (WHERE kind = 'R') > 0),
d AS (SELECT * REPLACE (CASE WHEN list_contains(agents, '*') THEN ['*'] ELSE agents END AS agents), list_contains(agents, '*') AS is_default, row_number() OVER (PARTITION BY host, list_contains(agents, '*') ORDER BY grp) AS k FROM g),
c AS (SELECT * FROM d WHERE NOT is_default OR k = 1)
"""

ORACLE_SQL = {
    # what is dead is cut out first, then the anchors that are left are read
    "live_anchors": rf"""WITH t AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '/b/c/' END AS base, html || '<A HREF = ''/live/' || page_id || '?a=1&amp;b=2#f''>One <b>bold</b>' || chr(10) || ' text</A><a href=rel/' || page_id ||
  '>two</a><a href=''''>self<a href="/last">three</a><abbr href=/dead7>' || CASE WHEN page_id % 2 = 0 THEN '<a href=''/open''>open <i>end' ELSE '' END AS html FROM pages),
a AS (SELECT page_id, url, base, string_split(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(?:script|style|title)\b.*?</(?:script|style|title)>', '', 'g'), '<') AS s FROM t),
b AS (SELECT page_id, url, base, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM a),
c AS (SELECT *, sum(CASE WHEN regexp_matches(s, '(?i)^/?a[\s/>]') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS k FROM b),
d AS (SELECT page_id, url, base, k, first(s ORDER BY i) AS tag, string_agg(CASE WHEN contains(s, '>') THEN substring(s, instr(s, '>') + 1) ELSE '' END, ' ' ORDER BY i) AS text FROM c WHERE k > 0 GROUP BY ALL),
v AS (SELECT *, regexp_extract(tag, '(?i)^a\s+href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]*)', 1) AS q FROM d WHERE regexp_matches(tag, '(?i)^a\s+href')),
r AS (SELECT page_id, url, base, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INTEGER AS pos, replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '&amp;', '&') AS text, replace(regexp_replace(q, '^["'']|["'']$', '', 'g'), '&amp;', '&') AS href FROM v),
x AS (SELECT *, {_BASE_SQL} FROM r)
SELECT page_id, pos, href, text, CASE WHEN starts_with(href, '/') THEN root || href WHEN base IS NOT NULL THEN root || base || href WHEN href = '' THEN root || path || query ELSE root || folder || href END AS link FROM x""",
    "robots_rules": _ROBOTS + """, o AS (SELECT host, grp, unnest(agents) AS agent, CASE WHEN rules IS NULL THEN [NULL] ELSE rules END AS rules FROM c), u AS (SELECT host, grp, agent, unnest(rules) AS r FROM o)
SELECT host, grp::BIGINT AS grp, r.pos AS pos, agent, r.prefix AS prefix, r.allow AS allow FROM u""",
    "robots_policy": _ROBOTS + """, u AS (SELECT page_id, host, CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS path FROM p),
ag(agent, ord) AS (VALUES ('orgbot', 1), ('*', 2)),
pick AS (SELECT page_id, path, u.host, agent, ord, coalesce(min(grp) FILTER (WHERE NOT is_default AND len(list_filter(agents, lambda a: contains(agent, a))) > 0), min(grp) FILTER (WHERE is_default)) AS grp FROM u CROSS JOIN ag LEFT JOIN c ON c.host = u.host GROUP BY ALL),
said AS (SELECT page_id, pick.host, ord, delay, list_filter(coalesce(rules, []), lambda r: starts_with(path, r.prefix)) AS fits FROM pick LEFT JOIN c ON c.host = pick.host AND c.grp = pick.grp)
SELECT page_id, host, bool_or(CASE WHEN len(fits) = 0 OR fits[1].prefix = '' THEN true ELSE fits[1].allow END) AS allowed, greatest(2.0::DOUBLE, coalesce(arg_min(delay, ord) FILTER (WHERE delay > 0), 0.0::DOUBLE)) AS delay FROM said GROUP BY page_id, host""",
}
