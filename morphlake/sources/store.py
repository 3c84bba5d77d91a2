"""Tables of a job's own, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
# A written table of more bytes is not broadcast, one of more bytes is worked through in so many passes.
LARGE, PASS_BYTES, PASSES = 1 << 20, 16 << 20, 8
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="morphlake-"))
        where = _OWN[0]
    return where.rstrip("/")


def size(df: DataFrame) -> int:
    """Bytes that the optimizer expects of df; of a written table those of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def passes(table: DataFrame) -> int:
    """How many passes a step over a written table is cut into, so that the shuffles of one pass are on disk at a time."""
    return PASSES if size(table) > PASS_BYTES else 1


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: computed once however often it is used, its lineage cut, safe from lost executors.

    The shuffle files of the write go when it ends. A large table asks for merge joins: its files are compressed several
    times, so that Spark would broadcast, through the driver, tables far beyond its threshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/morphlake-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if size(out) > LARGE else out
