"""The corpus pipeline: five operators of `lithic.llm` in a row over `documents`.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of
`documents`; the last one returns the mix.  Between stages the documents are
written as Parquet and read again, so a lost executor repeats one stage at most.
When a stage begins, what the stage before it wrote for itself is deleted, as
its result is a table of its own by then: run the stages one after the other.
Python gets at most `ARROW_ROWS` rows a batch, as the session is set from the
first stage on: a batch stands in memory several times, in JVM and worker.

In every stage null and empty texts stay what they are, repeated rows and null
ids are rows like others (see the operators), other columns pass through
whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import decontaminate, mixing, neardup, quality, recompress
from lithic.llm.common import delete, recording, shared_dir, sweep, table, unused


_LEFT: list[str] = []
ARROW_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _stage(f):
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if run is STAGES[0][1]:
            _LEFT.clear()  # an earlier pipeline's result may still be read
        sweep(docs, _LEFT)
        if not 0 < int(spark.conf.get(_ROWS)) <= ARROW_ROWS:
            spark.conf.set(_ROWS, str(ARROW_ROWS))
        with recording() as made:
            out = f(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage may have cut."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, rejects go; null and empty texts are scored as well."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = unused(docs, "score"), unused(docs, "predicted")
    scored = quality.score(docs, model, score_col=score, predicted_col=predicted)
    return scored.where(F.col(predicted) == 1).drop(score, predicted)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id."""
    return neardup.deduplicate(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a document with a smaller id has are cut out."""
    return _counted(recompress.remove(docs))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take from each document that is left, for the target weights of the sources."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
