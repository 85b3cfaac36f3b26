"""Running values over an ordered key, without one task per key.

A plain window over ``key`` puts all rows of a key into one task. Here every key is cut into
segments of consecutive positions. One exchange deals the rows by key and segment; every segment is scanned on its
own and the result is written. Segment totals (one row per segment) come from the written rows, reading their own
columns only; they are scanned over the key, and what is carried into later segments is joined back. So the input is
evaluated and dealt once, a key that holds a third of the table is spread over as many tasks as it has segments, and
a key of one segment carries nothing. Rows travel with all their columns: callers pass those that they need, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cut import lookup, written

SEGMENT = 65_536


def running(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, Column]],
            segment: int = SEGMENT) -> DataFrame:
    """Add running columns. ``specs``: output name -> (kind, expression).

    kinds: ``sum``, ``max`` (over all rows up to and including this one), ``last`` (last non-NULL
    value up to and including this one), ``lag`` (value of the previous row; NULL on the first).
    ``order`` is an integer position, unique within the key. The rows are written when this is called.
    """
    seg = F.floor(F.col(order) / segment).cast("long")
    base = df.withColumn("_seg", seg)
    for name, (_, expr) in specs.items():
        base = base.withColumn(f"_in_{name}", expr)
    part = keys + ["_seg"]
    here = Window.partitionBy(*part).orderBy(order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local, totals, carried, final = {}, [], [], {}
    across = Window.partitionBy(*keys).orderBy("_seg")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in specs.items():
        x, here_, tot, car = F.col(f"_in_{name}"), f"_here_{name}", f"_tot_{name}", f"_car_{name}"
        if kind == "sum":
            local[here_] = F.sum(x).over(upto)
            totals.append(F.sum(x).alias(tot))
            carried.append(F.sum(tot).over(before).alias(car))
            final[name] = F.coalesce(F.col(here_), F.lit(0)) + F.coalesce(F.col(car), F.lit(0))
        elif kind == "max":
            local[here_] = F.max(x).over(upto)
            totals.append(F.max(x).alias(tot))
            carried.append(F.max(tot).over(before).alias(car))
            final[name] = F.greatest(F.col(here_), F.col(car))
        elif kind == "last":
            local[here_] = F.last(x, ignorenulls=True).over(upto)
            totals.append(F.max_by(x, F.when(x.isNotNull(), F.col(order))).alias(tot))
            carried.append(F.last(tot, ignorenulls=True).over(before).alias(car))
            final[name] = F.coalesce(F.col(here_), F.col(car))
        elif kind == "lag":
            local[here_] = F.lag(F.struct(x.alias("v"))).over(here)
            totals.append(F.max_by(F.struct(x.alias("v")), order).alias(tot))
            carried.append(F.lag(tot).over(across).alias(car))
            final[name] = F.coalesce(F.col(here_), F.col(car))["v"]
        else:
            raise ValueError(kind)
    scanned = written(base.select("*", *[c.alias(n) for n, c in local.items()]))
    # only keys of several segments carry; the many others are neither dealt nor joined again
    ends = scanned.groupBy(*keys).agg(F.min("_seg").alias("_low"), F.max("_seg").alias("_high"))
    wide = written(ends.where("_low < _high").select(*keys))
    carry = scanned.join(lookup(wide), keys, "left_semi").groupBy(*part).agg(*totals).select(*part, *carried)
    some = " or ".join(f"_car_{name} is not null" for name in specs)
    joined = scanned.join(lookup(written(carry.where(some))), part, "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def position(block_seq: Column, row_no: Column | None = None) -> Column:
    """One integer for (block, row): rows of a block never reach the next block, as both are 32-bit numbers."""
    at = F.shiftleft(block_seq.cast("long"), 31)
    return at if row_no is None else at + row_no
