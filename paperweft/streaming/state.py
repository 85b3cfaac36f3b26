"""Keyed state of a stream as a table in buckets: a micro-batch rewrites the buckets that it touches and no others.

    <folder>/batch/version=n              the micro-batch, reduced to one row a key
    <folder>/data/version=n/bucket=b      state of a bucket as of micro-batch n
    <folder>/index/version=n              bucket -> version that holds its state; written last, so it commits n
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64


class BucketedState:
    """State of one row a key. ``merge`` reduces rows (state and news together) to one row a key, with the same columns.

    A repeated micro-batch starts from the index before it and overwrites its own version, so a restart changes nothing.
    Files that a micro-batch replaced go two micro-batches later: the next one may be repeated from them, and readers have
    that long to finish. The driver holds the index: a pair of numbers a bucket.
    """

    def __init__(self, folder: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.folder, self.keys, self.merge, self.buckets = folder.rstrip("/"), keys, merge, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _index(self, spark: SparkSession, number: int) -> dict[int, int]:
        if number < 0:
            return {}
        rows = spark.read.schema("bucket int, at long").parquet(f"{self.folder}/index/version={number}").collect()
        return {r.bucket: r["at"] for r in rows}

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merge micro-batch ``number`` into the state."""
        spark, known = batch.sparkSession, self._index(batch.sparkSession, number - 1)
        news, path = self.merge(batch), f"{self.folder}/batch/version={number}"
        news.write.mode("overwrite").parquet(path)
        news = spark.read.schema(news.schema).parquet(path)
        touched = [r.bucket for r in news.select(self._bucket().alias("bucket")).distinct().collect()]
        old = [f"{self.folder}/data/version={known[b]}/bucket={b}" for b in touched if b in known]
        both = news.unionByName(spark.read.schema(news.schema).parquet(*old)) if old else news
        state = self.merge(both).withColumn("bucket", self._bucket()).repartition("bucket")
        state.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={number}")
        index = known | dict.fromkeys(touched, number)
        spark.createDataFrame(list(index.items()), "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/index/version={number}")
        self._drop(spark, f"{self.folder}/batch/version={number - 1}")
        for bucket, version in (self._index(spark, number - 2).items() if number > 1 else ()):
            if known[bucket] != version:  # replaced by the micro-batch before this one
                self._drop(spark, f"{self.folder}/data/version={version}/bucket={bucket}")

    @staticmethod
    def _drop(spark: SparkSession, path: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def current(self, spark: SparkSession) -> DataFrame:
        """The state as of the newest micro-batch that is committed."""
        number = spark.read.parquet(f"{self.folder}/index").agg(F.max("version")).first()[0]
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in self._index(spark, number).items()]
        schema = spark.read.option("recursiveFileLookup", True).parquet(f"{self.folder}/batch/version={number}").schema
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
