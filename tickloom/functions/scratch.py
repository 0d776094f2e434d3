"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir). Where that is unset, a temporary one is set, but in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes that a task reads at most, of files or of a shuffle, while rows are kept.
PART_BYTES = 16 << 20


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once and written: what reads them several times does not compute them again.

    A task reads parts of PART_BYTES, so what it holds (of an aggregate, a row for nearly each row read) does not grow with the input.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    own = {"spark.sql.files.maxPartitionBytes": PART_BYTES, "spark.sql.adaptive.advisoryPartitionSizeInBytes": PART_BYTES, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, str(value))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
