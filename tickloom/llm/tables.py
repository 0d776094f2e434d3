"""Intermediate tables in the folder that all executors share, and joins that check sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a broadcast semi join may hold; beyond it the join shuffles.
BROADCAST_IDS = 200_000
#: Bytes of an Arrow batch on its way to a Python worker, where the session sets no other bound.
BATCH_BYTES = 2 << 20
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one is set, but in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python are bounded by bytes, since rows of text have any size; a session's own bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    bounded_batches(spark)
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once and read back: lineage ends here and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing still to be computed reads."""
    for table in tables:
        spark, path = table.sparkSession, _paths.pop(table)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose id is in ids (a written table with that column). Broadcast only after counting."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids.select(column), column, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: Column) -> DataFrame:
    """Rows of df whose key is not in ids (a written table with one column). Broadcast only after counting."""
    gone = ids.toDF("_gone")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return df.join(gone, key == F.col("_gone"), "left_anti")
