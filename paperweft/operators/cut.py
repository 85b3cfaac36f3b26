"""Cutting lineage in long compositions, in the folder that all executors share."""

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


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` by a reliable checkpoint and continue from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Materialize ``df`` as Parquet and continue from there: columns stay prunable, which a checkpoint's don't."""
    path = f"{shared(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that grows with the input: shuffled, never sent through the driver.

    Written and checkpointed tables are estimated by their files, which are a small part of their rows.
    """
    return df.hint("merge")


#: Rows and characters up to which a lookup table is sent to every executor.
LOOKUP_ROWS, LOOKUP_CHARS = 500_000, 32_000_000


def lookup(df: DataFrame) -> DataFrame:
    """``df`` as the smaller side of joins: broadcast if small when counted, else shuffled and merged.

    Estimates of generated or parsed rows may be far too low, and then a growing table goes through the driver.
    """
    chars = sum((F.length(F.coalesce(c, F.lit(""))) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    return F.broadcast(df) if n <= LOOKUP_ROWS and size <= LOOKUP_CHARS else df.hint("merge")
