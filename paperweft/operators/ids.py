"""Unique ids with numeric suffixes: the id itself if it is free, else the smallest free id_2, id_3, ...

Requests for one base are served in order. Ids that are taken cut the numbers 1 (the base itself), 2, 3, ... into gaps:
with the i-th smallest taken number t, t - i free numbers lie below it, so the r-th request (from 0) gets number
r + 1 + (taken numbers with t - i <= r). That is its place in the order of taken numbers and requests by these values, so
it comes from a distributed rank, whatever the size of a family. Only where a requested base looks like a suffixed form of
another that needs suffixes do requests depend on one another; such a family is served one after another.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .cut import lookup, merged, written
from .parts import ranked

_SUFFIXED = r"^(.*)_([2-9]|[1-9][0-9]{1,17})$"


def _parent(c: Column) -> Column:
    """The base that ``c`` is a suffixed form of, or NULL."""
    return F.nullif(F.regexp_extract(c, _SUFFIXED, 1), F.lit(""))


def _serve(asked: pd.DataFrame, used: pd.DataFrame) -> list[str]:
    seen, following, ids = set(used["id"]), {}, []
    for base in asked["base"]:
        candidate = base
        while candidate in seen:
            n = following.get(base, 2)
            candidate, following[base] = f"{base}_{n}", n + 1
        seen.add(candidate)
        ids.append(candidate)
    return ids


def _fill_gaps(asks: DataFrame, taken: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Requests (key, order, _at) with ``_number``, their place among taken numbers and requests of a base."""
    below = ranked(taken, key, ["number"]).withColumn("_at", F.col("number") - F.col("rank") - 1)
    none = [F.lit(None).cast(dict(asks.dtypes)[c]).alias(c) for c in order]
    line = asks.withColumn("_asks", F.lit(1)).unionByName(below.select(*key, *none, "_at", F.lit(0).alias("_asks")))
    return ranked(line, key, ["_at", "_asks"]).where("_asks = 1").select(*key, *order, F.col("rank").alias("_number"))


def allocate(asked: DataFrame, scope: list[str], order: list[str], used: DataFrame | None = None) -> DataFrame:
    """``asked`` (scope, base, order columns, ...) with ``id``, unique in the scope and not among ``used`` (scope, id).

    ``order`` is a total order in the scope. The rows are written when this is called.
    """
    spark = asked.sparkSession
    asked = written(asked)
    key, none_used = [*scope, "base"], used is None
    if none_used:
        used = spark.createDataFrame([], asked.select(*scope, F.col("base").alias("id")).schema)
    used = used.select(*scope, "id").distinct()
    wanted = asked.groupBy(*key).agg(F.count("*").alias("_n"))
    number = F.regexp_extract("id", _SUFFIXED, 2)
    both = F.array(F.struct(F.col("id").alias("base"), F.lit(1).cast("long").alias("number")),
                   F.struct(_parent(F.col("id")).alias("base"), F.nullif(number, F.lit("")).cast("long").alias("number")))
    taken = used.select(*scope, F.explode(both).alias("t")).select(*scope, "t.*").where("base is not null").join(merged(wanted), key, "left_semi")
    moving = written(wanted.where("_n > 1").select(*key).union(taken.where("number = 1").select(*key)).distinct())
    root = F.regexp_replace("base", r"(_\d+)+$", "")
    clash = wanted.select(*scope, root.alias("_root"), _parent(F.col("base")).alias("base")).join(merged(moving), key, "left_semi").select(*scope, "_root").distinct()
    few = lookup(written(clash))
    family = [*scope, "_root"]
    rows = asked.withColumn("_root", root)
    alone = rows.join(few, family, "left_anti")
    kept = alone.join(merged(moving), key, "left_anti").withColumn("id", F.col("base"))

    moved = alone.join(merged(moving), key, "left_semi")
    asks = ranked(moved.select(*key, *order), key, order).withColumnRenamed("rank", "_at")
    if none_used:  # no gaps
        served = asks.withColumnRenamed("_at", "_number")
    else:
        served = _fill_gaps(asks, taken.join(merged(moving), key, "left_semi"), key, order)
    suffixed = F.when(F.col("_number") == 0, F.col("base")).otherwise(F.concat_ws("_", "base", (F.col("_number") + 1).cast("string")))
    numbered = moved.join(merged(served), [*key, *order]).withColumn("id", suffixed)

    columns = [*asked.columns, "_root"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in asked.select(*scope, "base", *order).dtypes)

    def serve(a: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values(order)
        return a[[*scope, "base", *order]].assign(id=_serve(a, u))

    mine = used.withColumn("_root", F.regexp_replace("id", r"(_\d+)+$", "")).join(few, family, "left_semi")
    hard = rows.join(few, family, "left_semi")
    folded = hard.select(*family, "base", *order).groupBy(*family).cogroup(mine.groupBy(*family)).applyInPandas(serve, f"{kinds}, id string")
    resolved = hard.join(merged(folded), [*key, *order])
    every = [df.select(*columns, "id") for df in (kept, numbered, resolved)]
    return every[0].unionByName(every[1]).unionByName(every[2]).drop("_root")
