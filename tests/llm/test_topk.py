"""Threshold algorithm: against brute force, early stop, and exact scores beyond doubles."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperweft.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rank int"


def brute(rows, k, scale):
    some = sorted({(i, tuple(int(np.floor(c * scale)) for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}, key=str)
    out = []
    for q, x in some:
        if q is not None and q % 3 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(x, y)), i is None, i) for i, y in some if i != q), key=lambda t: (t[0], t[1], t[2] or 0))
            out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,width,spread", [(1, 1, 1.0), (2, 3, 2.0), (3, 12, 0.01), (4, 5, 1e6)])
def test_equals_brute_force(spark, seed, width, spread):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, spread) for _ in range(width)]) for i in range(90)]
    rows += [(200 + i, [1.0] * width) for i in range(40)] + [rows[0], (None, [2.0] * width), (500, None), (501, [None] * width), (502, [float("nan")] * width), (504, [1.5])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA).repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, k=4, scale=16, block_rows=16, group_blocks=2)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4, 16)


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_scan_stops_when_the_bound_is_beaten():
    rnd = np.random.default_rng(0)
    v = rnd.integers(-20, 20, (2000, 2))
    v[:10] = 1000
    block = topk.lists(pa.array(range(2000), pa.int64()), v)
    block["ids"] = block["ids"].to_pylist()
    q = np.array([[3, 2], [1, 1]])
    kth = np.full(2, -np.inf, object)
    row, col, score, scored = topk.threshold_scan(q, [-1, -2], block, kth, 5)
    assert scored < 0.1 * q.shape[0] * len(v)
    assert sorted(score[row == 0].tolist()) == [5000.0] * 5 and sorted(block["ids"][j] for j in col[row == 0]) == [0, 1, 2, 3, 4]
    again = topk.threshold_scan(q, [-1, -2], block, np.array([10**6, 10**6], object), 5)
    assert again[3] == 0 and not len(again[0])


def test_scores_beyond_doubles_are_exact():
    big = np.array([[(1 << 31) + 1, 1], [1 << 31, 5]])
    block = topk.lists(pa.array([7, 8], pa.int64()), big)
    block["ids"] = block["ids"].to_pylist()
    kth = np.full(1, -np.inf, object)
    row, col, score, _ = topk.threshold_scan(np.array([[(1 << 31) - 1, 3]]), [-1], block, kth, 1)
    assert [(block["ids"][c], s) for c, s in zip(col, score)] == [(7, ((1 << 31) + 1) * ((1 << 31) - 1) + 3)]
