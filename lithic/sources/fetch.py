"""Fetching on the executors, and link sources over fetched pages.

The network is a callable given by the caller (`url, form -> (status, headers,
bytes)`, with a third argument, further headers, where a range is asked for), so that everything here runs and is tested without one.  Requests are
dealt by host: one task holds a host's requests and so its spacing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions import text as T
from lithic.operators import ingest, tables
from lithic.sources import allowed, anchors, decoded, directory_members, directory_place, host, matching_links, zip_listing
from lithic.sources.robots import robots_url

Getter = Callable[..., tuple[int, dict[str, str], bytes]]
RESPONSE = "url string, status int, content binary, headers map<string,string>, attempts int, error string"


def fetch(requests: DataFrame, getter: Getter, *, robots: DataFrame | None = None, agents: tuple[str, ...] = ("*",), max_bytes: int = 52_428_800, max_retries: int = 4,
          base_delay: float = 2.0, most_delay: float = 120.0, parts: int = 32, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Responses of requests (url, form, delay, first, last).

    429, 5xx and transport errors are tried again with doubling waits from
    base_delay on, bodies of max_bytes and more are refused.  With robots (see
    `sources.allowed`) URLs that the rules forbid are not asked.  first and last
    are a byte range, sent as a Range header where given; a negative first asks
    for so many bytes of the end.  A failing request is
    a row with its error, never a failed task; every response is handed on
    before the next request is made.
    """

    def one(url, form, delay, ok, first, last):
        status, headers, body, error, n = None, {}, None, None, 0
        if not ok:
            return url, None, None, headers, n, "RobotsDisallowed"
        given = [None if x is None or x != x else int(x) for x in (first, last)]
        extra = {} if given[0] is None else {"Range": f"bytes={given[0]}" + ("" if given[0] < 0 else "-" if given[1] is None else f"-{given[1]}")}
        if delay:
            sleep(float(delay))
        while n < max_retries:
            if n:
                sleep(min(most_delay, base_delay * 2 ** (n - 1)))
            n += 1
            try:
                status, headers, body = getter(url, form, extra) if extra else getter(url, form)
                error = None
            except Exception as x:  # any transport error is tried again and then a row
                status, body, error = None, None, f"{type(x).__name__}: {x}"
                continue
            if status != 429 and not 500 <= status <= 599:
                break
        if error is None and status is not None and status >= 400:
            error = f"HTTPError: {status}"
        if body is not None and max(len(body), int(headers.get("content-length", 0) or 0)) >= max_bytes:
            body, error = None, f"TooLarge: {max_bytes} bytes or more"
        return url, status, body, headers, n, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame([one(*row)], columns=["url", "status", "content", "headers", "attempts", "error"]).astype({"status": "Int32"})

    asked = allowed(requests, robots, agents) if robots is not None else requests.withColumn("allowed", F.lit(True))
    kinds = {"form": "string", "delay": "double", "first": "long", "last": "long"}
    given = {c: F.col(c).cast(k) if c in requests.columns else F.lit(0.0 if c == "delay" else None).cast(k) for c, k in kinds.items()}
    dealt = asked.select("url", given["form"].alias("form"), given["delay"].alias("delay"), "allowed", given["first"].alias("first"), given["last"].alias("last"))
    return dealt.repartition(parts, host(F.col("url"))).mapInPandas(run, RESPONSE)


def robots_bodies(urls: DataFrame, getter: Getter, known: DataFrame | None = None, **kw) -> DataFrame:
    """(host, status, body) of the robots.txt of every host of urls, each asked for once; hosts of `known` (such a table) are not asked again.

    Write the result and hand it on as `known`: it is the cache of a crawl.  A
    host that cannot be reached has a null body, which allows all.
    """
    asked = urls.select(host(F.col("url")).alias("host"), robots_url(F.col("url")).alias("url")).where("host <> ''")
    once = asked.groupBy("host").agg(F.min("url").alias("url"))
    if known is not None:
        once = once.join(known.select("host"), "host", "left_anti")
    got = fetch(once.select("url"), getter, **kw)
    text = decoded(got.withColumn("charset", F.lit(None).cast("string"))).select(host(F.col("url")).alias("host"), "status", F.when(F.col("content").isNotNull(), F.col("text")).alias("body"))
    return text if known is None else known.select("host", "status", "body").unionByName(text)


def remote_members(urls: DataFrame, getter: Getter, tail: int = 66_000, **kw) -> DataFrame:
    """(url, name, size, error) of the members of remote zip archives, by two range reads: the end, and the central directory it points to.

    Each archive (url) is asked for once, however often it is listed.  A server
    that does not answer with the part asked for (status 206) gives an error.
    """
    once = urls.select("url").distinct()
    ends = tables.written(fetch(once.withColumn("first", F.lit(-tail)), getter, **kw), "ends")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                try:
                    if r.error is not None:
                        raise ValueError(r.error)
                    if r.status != 206:
                        raise ValueError(f"no range: status {r.status}")
                    count, size, offset = directory_place(bytes(r.content))
                    row = (r.url, count, offset, offset + size - 1, None)
                except ValueError as x:
                    row = (r.url, None, None, None, str(x))
                yield pd.DataFrame([row], columns=["url", "count", "first", "last", "bad"]).astype({"count": "Int32", "first": "Int64", "last": "Int64"})

    placed = tables.written(ends.select("url", "status", "content", "error").mapInPandas(places, "url string, count int, first long, last long, bad string"), "places")
    found = fetch(placed.where("bad IS NULL AND count > 0").select("url", "first", "last"), getter, **kw)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    if r.error is not None or r.status != 206:
                        raise ValueError(r.error or f"no range: status {r.status}")
                    out += [(r.url, n, s, None) for n, s in directory_members(bytes(r.content), int(r.count))]
                except ValueError as x:
                    out.append((r.url, None, None, str(x)))
            yield pd.DataFrame(out, columns=["url", "name", "size", "error"]).astype({"size": "Int64"})

    kinds = "url string, name string, size long, error string"
    good = found.join(placed.select("url", "count"), "url").select("url", "status", "content", "error", "count").mapInPandas(members, kinds)
    return good.unionByName(placed.where("bad IS NOT NULL").select("url", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("size"), F.col("bad").alias("error")))


def html_of(responses: DataFrame) -> DataFrame:
    """(url, html) of the responses without error, decoded by mark, declared charset, utf-8 or cp1252."""
    charset = F.regexp_extract(F.coalesce(F.col("headers")["content-type"], F.lit("")), r"(?i)charset=([\w-]+)", 1)
    ok = responses.where(F.col("error").isNull() & F.col("content").isNotNull())
    return decoded(ok.withColumn("charset", F.nullif(charset, F.lit("")))).select("url", F.col("text").alias("html"))


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first by order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


# ------------------------------------------------------------------ link sources
def _links(rows: DataFrame, name: str, title: Column) -> DataFrame:
    found = T.with_metadata(rows.withColumn("title", title).withColumn("source", F.lit(name)), "title")
    return ingest.links_with_keys(found)


def archive_walk(pages: DataFrame, archives: DataFrame, index_url: str, *, name: str, max_years: int = 2, target: int = 8) -> DataFrame:
    """Links by a three-level walk over fetched pages (url, html): year indexes, newest first, to school pages to the first zip of each, to its PDF members.

    archives: (url, content), an archive or its tail.  Whole schools are taken in
    walking order until `target` distinct exams are reached.
    """
    a = anchors(pages.withColumn("page_id", F.col("url")))
    years = a.where(F.col("page_id") == index_url).withColumn("year", T.year(F.col("link"))).where(F.col("year").isNotNull())
    years = first_seen(years.select("year", "link", "pos"), "year", "pos").orderBy(F.col("year").desc()).limit(max_years)
    schools = a.join(years.select(F.col("link").alias("page_id"), "year"), "page_id").select(F.col("link").alias("school_url"), (-F.col("year")).alias("yo"), F.col("pos").alias("so"))
    schools = first_seen(schools, "school_url", "yo", "so")
    zips = a.where(F.lower("link").endswith(".zip")).select(F.col("page_id").alias("school_url"), "link", "pos")
    zips = first_seen(zips, "school_url", "pos").join(schools, "school_url")
    members = zip_listing(archives.join(zips.select(F.col("link").alias("url")).distinct(), "url", "left_semi")).where("is_pdf")
    rows = members.join(zips, members["id"] == zips["link"]).select(
        F.col("school_url").alias("page_url"), F.col("link").alias("file_url"), F.col("name").alias("member"), F.col("size").alias("member_bytes"), F.struct("yo", "so", "name").alias("ord")
    )
    links = _links(rows, name, F.concat_ws(" ", "page_url", "member"))
    return ingest.first_groups(links, "page_url", "exam_key", "ord", target)


def gated_board(pages: DataFrame, topics: list[str], *, name: str, phrases: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(links, errors) of a board's topic pages: attachments, all combined papers without a number; nothing if the first page is gated."""
    order = F.array_position(F.array(*map(F.lit, topics)), F.col("url"))
    mine = pages.withColumn("ord", order).where(F.col("ord") > 0)
    a = matching_links(anchors(mine.withColumn("page_id", F.col("url"))), href_pattern="dlattach").where(~F.lower("href").contains("type=avatar"))
    rows = a.select(F.col("page_id").alias("page_url"), F.col("link").alias("file_url"), F.lit(None).cast("string").alias("member"), F.lit(None).cast("long").alias("member_bytes"), "pos")
    links = _links(rows, name, F.col("page_url")).withColumn("doc_type", F.lit("combined")).withColumn("paper_no", F.lit(None).cast("int"))
    return ingest.gated(links, mine, list(phrases), text_col="html")


def paged_listing(pages: DataFrame, listing: list[str], *, name: str, id_pattern: str, title_pattern: str, target: int = 8) -> DataFrame:
    """Links of listing pages in order: anchors whose target holds an id and whose text fits; stops with the page that brings `target` distinct exams."""
    order = F.array_position(F.array(*map(F.lit, listing)), F.col("url"))
    mine = pages.withColumn("page_no", order).where(F.col("page_no") > 0)
    found = anchors(mine.withColumn("page_id", F.struct("url", "page_no")))
    a = found.select("page_id.*", "pos", "href", "link", F.col("text").alias("t"))
    a = matching_links(a.withColumn("item", F.regexp_extract("href", id_pattern, 1)).where("item <> ''"), title_pattern=title_pattern, title_col="t")
    rows = a.select(F.col("url").alias("page_url"), F.col("link").alias("file_url"), "item", "t", F.struct("page_no", "pos").alias("ord"))
    return ingest.first_groups(_links(rows, name, F.col("t")), "page_url", "exam_key", "ord", target)
