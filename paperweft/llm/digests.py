"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. New data is reduced to one row per digest
(partial aggregation first, so a text that a third of the rows share costs one row per task),
joined to the index by a sort-merge anti-join, and what is new is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import stored

SPACE = r"[\x20\x09-\x0D]+"


def normal_text(text: Column) -> Column:
    """NULL becomes empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class DigestIndex:
    """A persistent table (digest binary, keep_id long), bucketed and sorted by digest.

    ``buckets`` is fixed when the table is created; each append writes at most one file a bucket.
    ``compact`` rewrites buckets that hold many files, so that the stored order saves the sort again.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets

    def rows(self) -> DataFrame:
        if self.spark.catalog.tableExists(self.table):
            return self.spark.table(self.table)
        return self.spark.createDataFrame([], "digest binary, keep_id long")

    def _write(self, df: DataFrame, table: str, mode: str) -> None:
        (df.select("digest", "keep_id").repartition(self.buckets, "digest").write.mode(mode).format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table))

    def append(self, groups: DataFrame) -> None:
        """Add the digests that the index lacks; adding the same groups again changes nothing."""
        fresh = groups.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
        self._write(fresh, self.table, "append")

    def compact(self) -> None:
        """One sorted file a bucket again, through a second table.

        The old table keeps a name of its own until the new one has taken its place, so a crash loses nothing: ``recover``
        (also called here first) puts it back.
        """
        self.recover()
        spare, old = f"{self.table}_compact", f"{self.table}_old"
        self._write(self.rows(), spare, "overwrite")
        self.spark.sql(f"ALTER TABLE {self.table} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {spare} RENAME TO {self.table}")
        self.spark.sql(f"DROP TABLE {old}")

    def recover(self) -> None:
        """Finish or undo a compaction that died half-way."""
        old = f"{self.table}_old"
        if self.spark.catalog.tableExists(old):
            if self.spark.catalog.tableExists(self.table):
                self.spark.sql(f"DROP TABLE {old}")
            else:
                self.spark.sql(f"ALTER TABLE {old} RENAME TO {self.table}")


def dedup(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Deduplicate ``docs`` against ``index`` and append what is new.

    Returns one row per row of ``docs``: doc_id, keep_id (of the row that stays: the index's, else the
    smallest doc_id of equal texts), group_size (rows of ``docs`` with this text), kept, text_sha256.
    Texts are equal when identical after white-space runs become one space; NULL counts as empty.
    Rows that share a doc_id and a text are one document: all carry its decision. A NULL doc_id never
    stays while a row with an id has the same text. Of the other columns of ``docs``, those in ``carry`` come along.
    """
    rows = stored(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(normal_text(F.col(text)).cast("binary"), 256)).alias("digest"), *carry))
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    index.append(groups)
    known = groups.select("digest", "group_size").join(index.rows(), "digest")
    return rows.join(known, "digest", "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *carry)
