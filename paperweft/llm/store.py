"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a new Parquet folder below the shared one and continue from there.

    The plan is cut, a lost executor costs no recomputation of what was written, and the columns
    stay prunable. The folder lives as long as the shared folder does, or until ``drop``.
    """
    path = f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once everything that was derived from it is stored itself."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number of its own for each row, made once and written, and that column's name."""
    key = fresh(df, "row_key")
    return stored(df.withColumn(key, F.monotonically_increasing_id()), "zstd"), key  # whole texts: two thirds of the default's disk
