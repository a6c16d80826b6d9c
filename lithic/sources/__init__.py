"""Sources: tables, anchors of HTML pages, encoded bytes, zip listings, candidate files, fetch policies and configuration."""

from __future__ import annotations

import os
import struct
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType
from pyspark.sql.window import Window

from lithic.functions import text as T
from lithic.operators import tables
from lithic.sources.html import anchors  # noqa: F401
from lithic.sources.robots import applied, from_table, host  # noqa: F401

# ------------------------------------------------------------------ registry
Source = Callable[[SparkSession, dict], DataFrame]
_SOURCES: dict[str, Source] = {}


def register(name: str) -> Callable[[Source], Source]:
    """Decorator: a link source under a name."""

    def put(f: Source) -> Source:
        _SOURCES[name] = f
        return f

    return put


def source(name: str) -> Source:
    if name not in _SOURCES:
        raise KeyError(f"no source {name!r}; known: {', '.join(sorted(_SOURCES)) or 'none'}")
    return _SOURCES[name]


# ------------------------------------------------------------------ tables
def first_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first path that can be read."""
    error: Exception | None = None
    for p in paths:
        try:
            return spark.read.parquet(p)
        except Exception as x:  # not there or not Parquet: the next candidate
            error = x
    raise FileNotFoundError(f"none of {paths}: {error}")


def candidate_links(spark: SparkSession, path: str) -> DataFrame:
    """Links of a candidates file (groups with nested links), one row each."""
    link = "struct<source:string,file_url:string,page_url:string,title:string,school:string,school_code:string,year:int,exam_type:string,paper_no:int,doc_type:string>"
    groups = spark.read.schema(f"n_groups int, groups array<struct<exam_key:string,links:array<{link}>>>").json(path, multiLine=True)
    return groups.select(F.explode("groups").alias("g")).select("g.exam_key", F.explode("g.links").alias("l")).select("exam_key", "l.*")


# ------------------------------------------------------------------ html
def matching_links(links: DataFrame, title_pattern: str | None = None, href_pattern: str | None = None, title_col: str = "title", href_col: str = "href") -> DataFrame:
    out = links
    if title_pattern:
        out = out.where(F.col(title_col).rlike(f"(?i){title_pattern}"))
    if href_pattern:
        out = out.where(F.col(href_col).rlike(f"(?i){href_pattern}"))
    return out


# ------------------------------------------------------------------ bytes
#: Byte order marks in the order in which they are tried.
BOMS = (("FFFE0000", 4, "utf-32-le"), ("0000FEFF", 4, "utf-32-be"), ("FFFE", 2, "utf-16-le"), ("FEFF", 2, "utf-16-be"), ("EFBBBF", 3, "utf-8"))


def encoding(raw: Column, declared: Column) -> Column:
    """The encoding by byte order mark, else the declared one, else utf-8."""
    out = None
    for mark, n, name in BOMS:
        hit = F.hex(F.substring(raw, 1, n)) == mark
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.coalesce(F.lower(declared), F.lit("utf-8")))


@F.pandas_udf(StringType())
def decode(raw: pd.Series, name: pd.Series) -> pd.Series:
    """Bytes to text: the encoding if it is known and fits, else utf-8, else cp1252 with replacement; no leading byte order mark."""

    def one(b, n):
        if b is None:
            return None
        for enc in (n, "utf-8"):
            try:
                return bytes(b).decode(enc).removeprefix("﻿")
            except (LookupError, UnicodeDecodeError, TypeError):
                continue
        return bytes(b).decode("cp1252", "replace").removeprefix("﻿")

    return pd.Series([one(b, n) for b, n in zip(raw, name, strict=True)], dtype=object)


def decoded(df: DataFrame, raw_col: str = "content", declared_col: str = "charset") -> DataFrame:
    name = encoding(F.col(raw_col), F.col(declared_col))
    return df.withColumn("encoding", name).withColumn("text", decode(F.col(raw_col), F.col("encoding")))


def zip_listing(archives: DataFrame, id_col: str = "url", raw_col: str = "content") -> DataFrame:
    """(id, name, size, is_pdf, error) of the members of zip archives, from their central directory alone; the bytes may be an archive's tail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, raw in zip(pdf["id"], pdf["raw"], strict=True):
                try:
                    out += [(i, n, s, n.lower().endswith(".pdf"), None) for n, s in zip_members(bytes(raw))]
                except ValueError as x:
                    out.append((i, None, None, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=["id", "name", "size", "is_pdf", "error"])

    kind = archives.schema[id_col].dataType.simpleString()
    return archives.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw")).mapInPandas(run, f"id {kind}, name string, size long, is_pdf boolean, error string")


def directory_place(tail: bytes) -> tuple[int, int, int]:
    """Members, size and offset of the central directory, from the bytes of an archive's end."""
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, offset):
        raise ValueError("zip64 archives are not supported")
    return count, size, offset


def directory_members(directory: bytes, count: int) -> list[tuple[str, int]]:
    """(name, uncompressed size) of the entries of a central directory."""
    pos, out = 0, []
    while len(out) < count:
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        flags, plain = struct.unpack_from("<H", directory, pos + 8)[0], struct.unpack_from("<I", directory, pos + 24)[0]
        n, extra, comment = struct.unpack_from("<HHH", directory, pos + 28)
        out.append((directory[pos + 46 : pos + 46 + n].decode("utf-8" if flags & 0x800 else "cp437"), plain))
        pos += 46 + n + extra + comment
    return out


def zip_members(tail: bytes) -> list[tuple[str, int]]:
    """(name, uncompressed size) from the bytes of an archive or of an end that holds its central directory."""
    count, size, _ = directory_place(tail)
    at = tail.rfind(b"PK\x05\x06") - size
    if at < 0:
        raise ValueError("the central directory is not in the bytes given")
    return directory_members(tail[at:], count)


def safe_member(name: Column) -> Column:
    """Whether an archive member is a PDF whose name stays inside the folder it is unpacked to: no folder, no drive, no root, no `..`."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    inside = ~F.exists(parts, lambda p: p == "..") & ~F.startswith(name, F.lit("/")) & ~F.startswith(name, F.lit("\\")) & ~F.contains(name, F.lit(":"))
    return F.coalesce(inside & F.endswith(F.lower(name), F.lit(".pdf")), F.lit(False))


def page_count(files: DataFrame, counter: Callable[[bytes], int], id_col: str = "paper_id", raw_col: str = "content") -> DataFrame:
    """(id, pages) of documents by a callable; 0 for one that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, raw in zip(pdf["id"], pdf["raw"], strict=True):
                try:
                    n = int(counter(bytes(raw)))
                except Exception:  # a broken document has no pages
                    n = 0
                yield pd.DataFrame([(i, n)], columns=["id", "pages"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw")).mapInPandas(run, f"id {kind}, pages int").withColumnRenamed("id", id_col)


def compressed(files: DataFrame, compressors: list[Callable[[bytes], bytes]], target: int, raw_col: str = "content") -> DataFrame:
    """files with `stored` (the smallest of the bytes and what the callables make of them) and a note; files of up to `target` bytes stay."""

    def run(raw: pd.Series) -> pd.Series:
        out = []
        for b in raw:
            best = b = None if b is None else bytes(b)
            for f in compressors if b is not None and len(b) > target else ():
                try:
                    new = f(b)
                except Exception:  # a compressor that fails changes nothing
                    continue
                best = new if len(new) < len(best) else best
            out.append(best)
        return pd.Series(out, dtype=object)

    stored = files.withColumn("stored", F.pandas_udf(run, BinaryType())(F.col(raw_col)))
    before, after = F.octet_length(raw_col), F.octet_length("stored")
    return stored.withColumn("note", F.when(before <= target, "small enough as it is").otherwise(T.compression_note(before, after, F.lit(target))))


def is_pdf(raw: Column) -> Column:
    return F.hex(F.substring(raw, 1, 4)) == "25504446"


@F.pandas_udf(BinaryType())
def extract_member(raw: pd.Series, name: pd.Series) -> pd.Series:
    """A PDF member's bytes out of whole archives; null where it cannot be read, its name is not safe or it is no PDF."""

    def one(b, n):
        try:
            parts = n.replace("\\", "/").split("/")
            if ".." in parts or not parts[0] or ":" in n or not n.lower().endswith(".pdf"):
                return None
            out = zipfile.ZipFile(BytesIO(bytes(b))).read(n)
        except (KeyError, zipfile.BadZipFile, TypeError, AttributeError):
            return None
        return out if out.startswith(b"%PDF") else None

    return pd.Series([one(b, n) for b, n in zip(raw, name, strict=True)], dtype=object)


def smallest_version(rows: DataFrame, id_col: str, versions: list[str]) -> DataFrame:
    """(id, chosen, size): the smallest of several encodings given as binary columns; the first one on ties."""
    pick = F.array_min(F.array(*[F.struct(F.octet_length(v).alias("size"), F.lit(i).alias("i"), F.lit(v).alias("chosen")) for i, v in enumerate(versions)]))
    return rows.select(id_col, pick.alias("p")).select(id_col, "p.chosen", "p.size")


# ------------------------------------------------------------------ fetch policy
def allowed(urls: DataFrame, robots: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """urls with host and `allowed`: whether a table of rules (host, pos, agent, prefix, allow) permits it to any of the agents; see `robots.applied`."""
    given = urls.withColumnRenamed("delay", "_given") if "delay" in urls.columns else urls
    return applied(given, from_table(robots), agents).drop("delay").withColumnRenamed("_given", "delay")


def crawl_delay(delay: Column, least: float) -> Column:
    return F.greatest(F.coalesce(delay, F.lit(0.0)), F.lit(least))


def schedule(requests: DataFrame, order: str = "ord", delay: str = "delay") -> DataFrame:
    """start_at seconds of each request: the delays of its host's earlier ones.

    Sums over sums: the requests are sorted into ranges by host and order, each
    range adds up its own delays, and the ranges of a host are few, so a host
    with very many requests is no single task.
    """
    ranged = requests.repartitionByRange("host", order).withColumn("_part", F.spark_partition_id())
    ranged = tables.written(ranged, "schedule")  # the ranges stay what they are
    own = Window.partitionBy("host", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("host", "_part").agg(F.sum(delay).alias("_sum"))
    sums = sums.select("host", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    out = ranged.withColumn("_own", F.coalesce(F.sum(delay).over(own), F.lit(0.0))).join(sums, ["host", "_part"])
    return out.withColumn("start_at", F.col("_before") + F.col("_own")).select(*requests.columns, "start_at")


def backoff(base: Column, attempt: Column, most: float = 120.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


# ------------------------------------------------------------------ configuration
DEFAULTS: dict = {
    "crawl": {"sources": [], "target": 8, "cap": 0, "max_bytes": 52_428_800, "min_delay": 2.0, "max_retries": 4},
    "split": {"min_chars_per_page": 50, "expected_questions_min": 10, "expected_questions_max": 13, "gutter_max_x0": 120, "gutter_tolerance": 6.0, "paper_marks": 100},
    "tag": {"model": "", "llm_enabled": False},
}


def load_config(path: str | Path | None = None, env_file: str | Path | None = None) -> dict:
    """Sections over the defaults from a TOML file; KEY=value lines of an env file do not override what is set."""
    found = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    if env_file and Path(env_file).exists():
        for line in Path(env_file).read_text().splitlines():
            key, eq, value = line.strip().partition("=")
            if eq and key and not key.startswith("#"):
                os.environ.setdefault(key.strip(), value.strip().strip("\"'"))
    return {**found, **{k: {**v, **found.get(k, {})} for k, v in DEFAULTS.items()}}
