"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import drop, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id reachable.

    Every round hangs the larger neighbours of a node, then the smaller ones, onto its smallest
    neighbour, until each component is a star around its smallest id. A node's neighbours are only
    aggregated (minimum) and joined, never gathered; the number of rounds is logarithmic.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        former = edges
        edges = stored(small.select("a", F.col("m").alias("b")).union(small.select(b.alias("a"), F.col("m").alias("b"))).where(a != b).distinct())
        drop(former)
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(a.alias("id"), b.alias("component")).union(edges.select(b.alias("id"), b.alias("component")).distinct())
