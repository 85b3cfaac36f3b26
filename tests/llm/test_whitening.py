"""Whitening against an eigendecomposition; exact deviations; rank, nulls, lengths, empty tables."""

import numpy as np
from pyspark.sql import functions as F

from paperweft.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, component int, n string"


def test_equals_eigendecomposition(spark):
    path = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_whitening"](spark, path).toPandas()
    rows = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    x = np.floor(np.array(rows.embedding.tolist(), float) * 1024).astype(np.int64) + 100_000
    n = len(x)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - x.mean(0)) @ axes[:, :8] / np.sqrt(values[:8])
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert w.shape == (n, 8) and np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-9)
    share = got.drop_duplicates("component").set_index("component").explained
    assert np.allclose([share[i] for i in range(1, 9)], values[:8] / values.sum(), rtol=1e-10)
    deviation = got[got.component == 1].set_index("vec_id").deviation.loc[rows.vec_id].to_numpy()
    assert (deviation == ((n * x - x.sum(0)) ** 2).sum(1)).all() and (got.n == n).all() and got.identity_error.max() < 1e-10


def test_factor_and_rotations():
    rnd = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (9, 4), (16, 16)):
        y = rnd.normal(size=(40, rank)) @ rnd.normal(size=(rank, d)) * 10.0 ** rnd.integers(-3, 4, d)
        a = y.T @ y
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape == (d, rank) and np.allclose(np.triu(factor, 1), 0) and np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-12 * a.max())
        values, axes = whitening.principal(a, 40, 8)
        assert np.allclose(values, np.linalg.eigvalsh(a / 40)[::-1][: min(8, rank)], rtol=1e-9, atol=1e-14 * a.max())
        assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)


def test_odd_rows(spark):
    rows = [(1, [0.5, 1.0, 2.0]), (2, [0.5, -1.0, 1.0]), (2, [0.5, -1.0, 1.0]), (None, [0.5, 3.0, 0.0]), (4, None), (5, [None, 1.0, 1.0]),
            (6, [float("inf"), 1.0, 1.0]), (7, [float("nan"), 0.0, 0.0]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame([(i, v, 3, "z") for i, v in rows], SCHEMA)
    got = whitening.whiten(df).toPandas()
    x = np.floor(np.array([v for _, v in rows[:4]]) * 1024)
    assert sorted(set(got.component)) == [1, 2] and len(got) == 8 and (got.n == 4).all()  # the first dimension is constant
    assert got[got.component == 1].vec_id.isna().sum() == 1
    want = sorted(((4 * x - x.sum(0)) ** 2).sum(1).astype(int).tolist())
    assert sorted(got[got.component == 2].deviation.tolist()) == want
    assert abs(got.drop_duplicates("component").explained.sum() - 1) < 1e-12 and got.identity_error.max() < 1e-9
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id = 2")).count() == 0
    assert whitening.whiten(df.where("vec_id = 2")).columns == list(got.columns)


def test_deviation_beyond_long(spark):
    df = spark.createDataFrame([(1, [1e12], 1, ""), (2, [-1e12], 1, ""), (3, [0.0], 1, "")], SCHEMA)
    got = whitening.whiten(df).orderBy("vec_id").collect()
    assert [r.deviation for r in got] == [None, None, 0] and abs(got[0].whitened + got[1].whitened) < 1e-9
    assert whitening.whiten(df).agg(F.max("identity_error")).first()[0] < 1e-9
