"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

The scatter A of the centred vectors is summed by Spark. A = P L L' P' with pivoting, and rotations from the right
make the columns of L orthogonal: L J = U D. Then A = P U D D U' P', so the squared column norms are the scatter's
eigenvalues and the normalised columns the components. Small eigenvalues keep their relative accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import stored
from .topk import matrix, valid

SWEEPS = 60
_EPS = np.finfo(np.float64).eps


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L'; L has as many columns as pivots above rounding error."""
    a, d = a.copy(), len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    floor = d * _EPS * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        j = k + int(a.diagonal()[k:].argmax())
        if not a[j, j] > floor:
            return factor[:, :k], order
        if j != k:
            a[[k, j]], factor[[k, j]], order[[k, j]] = a[[j, k]], factor[[j, k]], order[[j, k]]
            a[:, [k, j]] = a[:, [j, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(g: np.ndarray) -> np.ndarray:
    """``g`` with its columns rotated until they are orthogonal; disjoint pairs of columns turn together."""
    g = g.copy()
    n = g.shape[1]
    ring = list(range(n + n % 2))  # tournament: every pair meets once a sweep; the odd place out waits
    done = _EPS * np.sqrt(len(g))
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]) if max(p, q) < n]
            ring[1:] = ring[-1:] + ring[1:-1]
            p, q = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > done
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            g[:, p], g[:, q] = c * x - s * y, s * x + c * y
        if worst <= done:
            break
    return g


def principal(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of scatter / n, falling; unit eigenvectors as columns), at most ``most`` and the rank."""
    factor, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(factor)
    norm = np.sqrt((turned * turned).sum(0))
    by = np.argsort(-norm, kind="stable")[:most]
    axes = np.zeros((len(scatter), len(by)))
    axes[order] = turned[:, by] / norm[by]
    return norm[by] ** 2 / n, axes


def _wide_enough(a: np.ndarray, times: int) -> np.ndarray:
    """``a`` as int64 if sums of ``times`` products with it fit, else as Python integers."""
    most = max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))
    return a if most * times < 1 << 62 else a.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count and per-dimension sums by vector length."""
    total: dict[int, list] = {}
    for batch in batches:
        x = batch.column(0)
        size = np.diff(x.offsets.to_numpy())
        for width in np.unique(size).tolist():
            v = matrix(x.filter(pa.array(size == width)))
            part = [int(s) for s in _wide_enough(v, len(v)).sum(0)]
            have = total.setdefault(width, [0, [0] * width])
            have[0] += len(v)
            have[1] = [a + b for a, b in zip(have[1], part)]
    for width, (n, sums) in total.items():
        yield pa.record_batch([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([str(s) for s in sums])], ["width", "dim", "n", "total"])


def _centred(x: pa.Array, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, whole numbers."""
    v = matrix(x, len(sums))
    s = np.array(sums, object)
    z = _wide_enough(v, 2 * n)
    return z * n - (s.astype(np.int64) if z.dtype != object and max(map(abs, sums), default=0) < 1 << 62 else s)


def _gram(column: int, width: int, as_rows):
    """mapInArrow function: a task's sum of y y' as (i, values), where y = as_rows(batch column)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                y = as_rows(batch.column(column).slice(lo, 4096))
                total += y.T @ y
                some = True
        if some:
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    return add


def _collected(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the tasks' matrices: width x width numbers reach the driver."""
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    out[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy()
    return out


def whiten(rows: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row and its first ``most`` components.

    Entries count as x = floor(``scale`` * c) + ``shift``. All remaining rows are the fit list, repeated rows each.
    Rows whose vector is NULL, empty or holds a NULL or non-finite entry go, as do vectors of another length than the
    commonest (of equally common ones the longest). A NULL vec_id stays NULL. Components end at the scatter's rank: constant
    dimensions add none, and a table of equal vectors, like an empty one, has no component and gives no row. Sums and
    deviations are whole numbers of any size; a deviation that no long holds is NULL.

    Three passes over the table and one over the projections, each summed in its task before the shuffle. The
    driver gets the sums (a number a dimension and vector length) and two matrices of dimensions x dimensions and
    components x components, whatever the number of rows.
    """
    spark = rows.sparkSession
    x = F.transform(F.col(embedding), lambda c: F.floor(c.cast("double") * scale) + shift)
    used = rows.where(valid(F.col(embedding)) & (F.size(embedding) > 0)).select(F.col(vec_id).alias("vec_id"), x.alias("x"))
    parts = used.select("x").mapInArrow(_sums, "width int, dim int, n long, total string")
    by_dim = stored(parts.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    kind = f"vec_id {dict(used.dtypes)['vec_id']}, deviation long, w array<double>"
    out = "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    common = by_dim.where("dim = 0").orderBy(F.col("n").desc(), F.col("width").desc()).first()
    if common is None:
        n, width, sums = 0, 0, []
    else:
        n, width = common["n"], common["width"]
        sums = [int(r.total) for r in by_dim.where(F.col("width") == width).orderBy("dim").collect()]
    same = used.where(F.size("x") == width)
    scatter = _collected(same.select("x").mapInArrow(_gram(0, width, lambda v: (_centred(v, n, sums) / n).astype(np.float64)), "i int, row array<double>"), width) if n else np.zeros((0, 0))
    values, axes = principal(scatter, n, most)
    if not len(values):
        return spark.createDataFrame([], f"vec_id {dict(used.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = [float(v) for v in values * n / scatter.trace()]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _centred(batch.column(1), n, sums)
            squares = _wide_enough(z, width * max(1, int(np.abs(z).max(initial=0))))
            deviation = [d if d < 1 << 63 else None for d in map(int, (squares * squares).sum(1))]
            w = (z / n).astype(np.float64) @ axes / np.sqrt(values)
            yield pa.record_batch([batch.column(0), pa.array(deviation, pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    white = stored(same.mapInArrow(project, kind))
    count = len(values)
    as_rows = lambda w: w.flatten().to_numpy().reshape(-1, count)
    moments = _collected(white.select("w").mapInArrow(_gram(0, count + 1, lambda w: np.pad(as_rows(w), ((0, 0), (0, 1)), constant_values=1.0)), "i int, row array<double>"), count + 1) / n
    centre = moments[count, :count]  # zero but for rounding
    error = float(np.abs(moments[:count, :count] - np.outer(centre, centre) - np.eye(count)).max())
    each = white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")).select(*out)
