"""Shared pieces of the corpus operators: the shared folder, written stages and table access."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.staging import gone_at_exit, removed
from spindrift.sources.staging import shared_folder as shared_dir

#: White space of the word rules: space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, every later use
    reads the same rows, and a lost executor costs no more than its own tasks. The table goes with
    ``unstaged``, or when the driver ends."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    gone_at_exit(spark, path)
    held = spark.read.schema(df.schema).parquet(path)
    held.staged_at = path
    return held


def unstaged(*frames: DataFrame) -> None:
    """Remove the tables of ``staged`` frames that nothing reads any more."""
    for df in frames:
        removed(df.sparkSession, df.staged_at)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def utf8_column(column):
    """The raw UTF-8 bytes of each value of an Arrow string column, b"" for null."""
    import pyarrow as pa

    for v in column.cast(pa.large_binary()):
        yield v.as_py() or b""
