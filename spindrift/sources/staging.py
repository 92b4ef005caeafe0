"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where a local session has none."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found
    if (known := sc._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has a table removed when the driver ends, should nothing have removed it before."""
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)


def removed(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table. Unlike a cached frame, which carries its whole plan into every
    plan above it, the result is a plain scan. The table goes with ``unwritten``, or when the driver ends."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.written_at = path
    return held


def unwritten(*frames: DataFrame) -> None:
    """Removes the tables of ``written`` frames that nothing reads any more."""
    for df in frames:
        removed(df.sparkSession, df.written_at)
