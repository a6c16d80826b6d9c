"""Structured Streaming faces of the incremental operators: idempotent ingest and windowed crawl reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lithic.operators import ingest, tables


def new_by_sha(links: DataFrame, time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """A stream of links with the first of each content hash within the watermark: state stays bounded by the delay."""
    return links.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["sha"])


def crawl_report(events: DataFrame, time_col: str = "ts", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Links, bytes and sources per window of event time; late rows beyond the delay are dropped with their window."""
    seen = events.withWatermark(time_col, delay)
    return (
        seen.groupBy(F.window(time_col, window), "source")
        .agg(F.count(F.lit(1)).alias("links"), F.sum("size").alias("bytes"))
        .select(F.col("window.start").alias("start"), "source", "links", "bytes")
    )


def upsert_batches(merge: Callable[[DataFrame, DataFrame], DataFrame], table: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge each micro-batch into a table.

    Every epoch writes a whole new version beside the old one; `table` is a view
    of the version that counts, and replacing the view is the one step that
    makes an epoch count.  A replay after a failure at any place finds the old
    version whole, or the epoch done.  The version before stays for readers that
    still read it; older ones are dropped, with what failed attempts have left.
    A table belongs to one stream and its checkpoint, as epochs only go up.  A
    plain table of that name becomes the first version.
    """
    first = f"{table}_v_first"

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = current(spark, table)
        if at and int(at["lithic.epoch"]) >= epoch:
            return
        if at is None and spark.catalog.tableExists(table):
            spark.sql(f"ALTER TABLE {table} RENAME TO {first}")
        if at:
            base = spark.table(at["lithic.version"])
        else:
            base = spark.table(first) if spark.catalog.tableExists(first) else batch.limit(0).drop("ord")
        name = f"{table}_v{epoch}_{uuid.uuid4().hex[:12]}"
        merge(base, batch).write.saveAsTable(name)
        spark.sql(f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('lithic.epoch' = '{epoch}', 'lithic.version' = '{name}') AS SELECT * FROM {name}")
        held = {name.lower(), (at or {}).get("lithic.version", first).lower()}
        for t in spark.catalog.listTables(pattern=f"{table.split('.')[-1]}_v*"):
            full = ".".join([*table.split(".")[:-1], t.name])
            if full.lower() not in held:
                spark.sql(f"DROP TABLE IF EXISTS {full}")

    return put


def current(spark: SparkSession, table: str) -> dict[str, str] | None:
    """Epoch and version that the view of a table stands for; None where there is no such view."""
    if not spark.catalog.tableExists(table):
        return None
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return found if "lithic.epoch" in found else None


def ingest_batches(path: str, max_bytes: int, known_urls: DataFrame | None = None, known_shas: DataFrame | None = None, order: str = "ord") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the ingest state of every link of a stream, as `operators.ingest.ingest_states` gives it for all links at once.

    Links (url, sha, size, failed) count in the order of batches and of `order`
    within one.  What earlier batches have stored is the state of the stream: the
    folders `epoch=n` below path.  A batch looks up only its own URLs and hashes
    there and writes one folder, which a replay writes again from the folders
    before it, so nothing is rewritten and nothing can be lost.
    """

    def put(links: DataFrame, epoch: int) -> None:
        spark = links.sparkSession
        links = tables.written(links, "batch")
        seen = []
        for key, known in (("url", known_urls), ("sha", known_shas)):
            rows = [] if known is None else [known.select(key)]
            if epoch and tables.exists(spark, path):
                stored = spark.read.schema(StructType([*links.schema.fields, *StructType.fromDDL("state string, epoch long").fields])).parquet(path)
                rows.append(stored.where((F.col("epoch") < epoch) & (F.col("state") == "new")).select(key))
            whole = reduce(DataFrame.unionByName, rows) if rows else links.select(key).limit(0)
            seen.append(whole.join(links.select(key).distinct(), key, "left_semi"))
        with tables.recording() as made:
            ingest.ingest_states(links, *seen, max_bytes, order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        tables.delete(spark, *made)
        tables.drop(links)

    return put
