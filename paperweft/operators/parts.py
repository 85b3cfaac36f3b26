"""Nested results in bounded parts.

A nested result (all fields of a job, all documents of a project) is one row per key and *part*: the items of a key in
their order, cut after every ``size``. Parts concatenate to the whole order, at every size. No row holds more than
``size`` items, and no task more than a range of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cut import lookup, merged, written

PART_SIZE = 10_000
WINDOW_ROWS = 10_000  # of a key that one task ranks


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank``, the position of a row in its key from 0, without one task per key.

    Rows are dealt by ranges of (keys, order) and sorted; a row's rank is its place in its range plus the rows that
    its key has in earlier ranges. Rows that are equal in ``order`` lie in one range.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(dealt.withColumns({"_at": F.monotonically_increasing_id(), "_range": F.spark_partition_id()}))
    by_range = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_range.select(*keys, "_range", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(merged(firsts), [*keys, "_range"]).withColumn("rank", F.col("_at") - F.col("_from") + F.col("_before")).drop("_at", "_from", "_before", "_range")


def with_parts(df: DataFrame, keys: list[str], order: list[str], size: int = PART_SIZE) -> DataFrame:
    """``df`` with ``part_no``: rank in the key, by ``order``, divided by ``size``.

    Rows of keys with at most ``WINDOW_ROWS`` rows (or ``size``) are ranked in a window over the key; only rows of larger keys
    are dealt out by ranges. The rows are written first, so that counting, window and ranges don't evaluate them again.
    """
    df = written(df)
    large = written(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(size, WINDOW_ROWS)).select(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rest = df.join(lookup(large), keys, "left_anti").withColumn("part_no", F.floor(place / size).cast("int"))
    if large.isEmpty():
        return rest
    cut = ranked(df.join(lookup(large), keys, "left_semi"), keys, order)
    return rest.unionByName(cut.withColumn("part_no", F.floor(F.col("rank") / size).cast("int")).drop("rank"))


def nest(df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str, size: int = PART_SIZE) -> DataFrame:
    """(keys, part_no, out: array<struct<columns>>), items in order."""
    body: list[Column] = [F.struct(*[F.col(c) for c in columns]).alias("v")]
    rows = with_parts(df, keys, order, size).groupBy(*keys, "part_no").agg(F.array_sort(F.collect_list(F.struct(*order, *body))).alias("_b"))
    return rows.select(*keys, "part_no", F.col("_b.v").alias(out))
