"""Token counts by source, language and tokenizer version, kept by signed deltas.

Two tables: signed entries by document, and signed rollup rows, both partitioned by batch; a third lists
committed batches. A batch overwrites its own partitions and is listed last, so a run that died half-way
is repeated whole and a batch that was committed is never applied again.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tokenizer versions that are plain patterns: words between white space; digit runs, letter runs and single signs.
PATTERNS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[0-9]+|[^\x00-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]",
}
KEYS = ["source", "lang", "tokenizer"]


def pattern_count(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def vocabulary_counter(path: str) -> Callable[[Column], Column]:
    """Counts tokens with a public tokenizer file (Hugging Face JSON); ``path`` must exist on every executor."""
    def count(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return pa.array([len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)], pa.int64())

    return F.arrow_udf(count, "long")


class Rollup:
    """Additive totals under ``name`` in the session's warehouse."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def _table(self, kind: str, schema: str) -> DataFrame:
        table = f"{self.name}_{kind}"
        return self.spark.table(table) if self.spark.catalog.tableExists(table) else self.spark.createDataFrame([], schema)

    def committed(self) -> DataFrame:
        return self._table("commits", "batch string").distinct()

    def entries(self) -> DataFrame:
        """Current count of every document and tokenizer: the sum of its signed entries of committed batches."""
        signed = self._table("entries", "doc_id long, source string, lang string, tokenizer string, tokens long, sign int, batch string")
        live = signed.join(self.committed(), "batch", "left_semi").groupBy("doc_id", *KEYS)
        return live.agg(F.sum(F.col("sign") * F.col("tokens")).alias("tokens"), F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the documents that are present."""
        deltas = self._table("deltas", "source string, lang string, tokenizer string, docs long, tokens long, batch string")
        sums = deltas.join(self.committed(), "batch", "left_semi").groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs > 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (doc_id, source, lang, tokenizer, tokens; tokens NULL deletes) once.

        Returns False if ``batch`` was committed before. A document's former count under the same
        tokenizer is withdrawn with its former source and language, so inserts and revisions are one
        operation and a delete of an absent document changes nothing. Of several rows of one document and
        tokenizer in a batch the greatest by (tokens, source, lang) counts; a NULL doc_id is one document.
        """
        if self.committed().where(F.col("batch") == batch).limit(1).count():
            return False
        row = F.struct(F.col("tokens").cast("long").alias("tokens"), F.col("source"), F.col("lang"))
        new = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", row.alias("r")).groupBy("doc_id", "tokenizer").agg(F.max("r").alias("r"))
        keys = new.select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t"))
        old = self.entries().alias("e").join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tokenizer") == F.col("t")), "left_semi")
        signed = old.select("doc_id", *KEYS, "tokens", F.lit(-1).alias("sign")).union(
            new.where("r.tokens is not null").select("doc_id", "r.source", "r.lang", "tokenizer", "r.tokens", F.lit(1)))
        self._write("entries", signed, batch)
        mine = self.spark.table(f"{self.name}_entries").where(F.col("batch") == batch)
        self._write("deltas", mine.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")), batch)
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("append").saveAsTable(f"{self.name}_commits")
        return True

    def _write(self, kind: str, rows: DataFrame, batch: str) -> None:
        table = f"{self.name}_{kind}"
        out = rows.withColumn("batch", F.lit(batch)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
        if self.spark.catalog.tableExists(table):
            out.insertInto(table)
        else:
            out.partitionBy("batch").saveAsTable(table)


def counted(docs: DataFrame, version: str, text: Column) -> DataFrame:
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), pattern_count(text, version).alias("tokens"))
