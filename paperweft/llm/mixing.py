"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source in one range of its random keys.
RANGE_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target.

    Sources in code-point order, NULL last, take the weights in turn and share ``share`` of all
    sizes; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight until none is above (water level: with sources ordered by the level at which they stop,
    the level is the first at which the rest need not stop). One row per source.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    by_level = Window.orderBy("stop_level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("stop_level", F.col("cap") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("full")) / F.col("rest"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("stop_level"), F.col("level"))).over(everything)))
    target = F.when(F.col("stop_level") < F.col("level"), F.col("cap")).otherwise(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "0",
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Words that a mix takes of every document: doc_id, source, size, source_size, target, taken, copies.

    Within a source, documents are ordered by a hash of seed and doc_id (ties: doc_id, size). The
    order is cut into key ranges of about ``RANGE_ROWS`` rows, so one source that holds a third of all
    rows is summed by many tasks; range totals carry over. The source's budget (its target, rounded
    down) takes whole epochs first, then documents in order; the one at the cut is taken in part.
    NULL or empty text has size 0; a NULL source is a source; a NULL doc_id hashes as empty; repeated
    rows count each. ``copies`` is how often the document occurs in the mix, the partial one included.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = budgets(sizes.select("source", "source_size"), weights, share, most).alias("p").join(
        sizes.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = stored(plan.select(F.col("source").alias("of"), "source_size", "n_rows", "target", F.floor("target").alias("budget")))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.ceil(F.col("n_rows") / RANGE_ROWS))
    ranged = rows.join(plan, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("range", part)
    totals = ranged.groupBy("of", "range").agg(F.sum("size").alias("total"))
    upto = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("of").alias("c_of"), F.col("range").alias("c_range"), F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("of", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("before", F.sum("size").over(inside) - F.col("size")).join(
        carry, F.col("of").eqNullSafe(F.col("c_of")) & (F.col("range") == F.col("c_range")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("carry")
    last = F.greatest(F.lit(0), F.least(left, F.col("size")))
    return placed.withColumn("epochs", epochs).withColumn("last", last).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken"),
        (F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.lit(0)) + (F.col("last") > 0).cast("int")).cast("int").alias("copies"))
