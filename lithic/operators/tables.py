"""Tables in the cluster's shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RECORDS: list[list[str]] = []


@contextmanager
def recording():
    """A list of the folders that `written` makes meanwhile, for `delete` once nothing reads them any more."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders of Spark's file systems."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop(*made: DataFrame) -> None:
    """Delete tables made by `written` that nothing will read again."""
    for t in made:
        if path := getattr(t, "_lithic_path", None):
            delete(t.sparkSession, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine a temporary folder serves where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lithic-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _RECORDS:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lithic_path = path
    return out
