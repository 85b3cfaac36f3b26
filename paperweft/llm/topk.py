"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks. Within a block every dimension has a sorted list, read from the top for a
positive weight of a query and from the bottom for a negative one. At depth t no row that none of the lists has
shown yet can score above the sum of weight times value at depth t (the threshold). Rows that were seen are scored in
full; a query leaves the block once its kth best score is above the threshold. Queries go in blocks too: a batch
shares the sorted access, so the rows of a block lie in the order in which any list shows them first, and every
depth is one matrix product over the queries that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

#: Rows of a block of candidates, queries of a block of queries, blocks of candidates that meet a query block in one task.
BLOCK_ROWS, QUERY_ROWS, GROUP_BLOCKS = 4096, 1024, 128
#: Depth of the first look at the threshold; it doubles from there.
FIRST_DEPTH = 8
_EXACT = 1 << 53


def valid(vector: Column) -> Column:
    """True for vectors that are not NULL and hold neither NULL nor a non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix; missing components of shorter rows are 0."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(size), max(int(size.max(initial=0)), width or 0)), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _narrow(values: np.ndarray) -> tuple[bytes, str]:
    """Bytes in the smallest integer type that holds every value."""
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not values.size or (np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max))
    return values.astype(kind).tobytes(), np.dtype(kind).str


def lists(ids: pa.Array, v: np.ndarray) -> dict:
    """One block of candidates: rows in the order in which a list shows them, thresholds by depth."""
    n, width = v.shape
    order = np.argsort(v, axis=0, kind="stable")
    rank = np.empty((n, width), np.int64)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], (n, width)), 0)
    shown = np.minimum(rank, n - 1 - rank).min(1, initial=n)
    by = np.argsort(shown, kind="stable")
    depth = [0]
    while depth[-1] < n:
        depth.append(min(n, max(FIRST_DEPTH, 2 * depth[-1])))
    at = np.array(depth[:-1])
    ranked = np.take_along_axis(v, order, 0)
    data, kind = _narrow(v[by])
    return {"ids": ids.take(pa.array(by)), "width": width, "data": data, "kind": kind, "seen": np.searchsorted(shown[by], depth[1:]).astype(np.int32).tolist(),
            "high": ranked[n - 1 - at].tobytes(), "low": ranked[at].tobytes()}


def _packed(rows: int, index: bool):
    """mapInArrow function: (vec_id, x) rows to blocks of ``rows``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 24, 0, []

        def block(t: pa.Table) -> pa.RecordBatch:
            ids, v = t.column("vec_id").combine_chunks(), matrix(t.column("x"))
            one = {"block": base + made}
            if index:
                one |= lists(ids, v)
            else:
                data, kind = _narrow(v)
                one |= {"ids": ids, "width": v.shape[1], "data": data, "kind": kind}
            return pa.RecordBatch.from_pylist([one | {"ids": one["ids"].to_pylist()}], INDEX if index else QUERIES)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            while sum(map(len, held)) >= rows:
                every = pa.concat_tables(held)
                yield block(every.slice(0, rows))
                held, made = [every.slice(rows)], made + 1
        if sum(map(len, held)):
            yield block(pa.concat_tables(held))

    return pack


QUERIES = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("data", pa.binary()), ("kind", pa.string())])
INDEX = pa.schema([*QUERIES, ("seen", pa.list_(pa.int32())), ("high", pa.binary()), ("low", pa.binary())])
_QUERY_SQL = "block long, ids array<long>, width int, data binary, kind string"
_INDEX_SQL = _QUERY_SQL + ", seen array<int>, high binary, low binary"


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _best(row: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: highest score first, smallest tie next."""
    order = np.lexsort((tie, -score, row))
    ranked = row[order]
    first = np.searchsorted(ranked, ranked)
    return order[np.arange(len(order)) - first < k]


def threshold_scan(q: np.ndarray, own: list, c: dict, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, block row, score) of what may be among the k best, and the number of scores computed.

    ``kth`` (objects) holds every query's kth best score so far, -inf below k, and is raised in place.
    """
    width = max(q.shape[1], c["width"])
    v = _wide(np.frombuffer(c["data"], c["kind"]).astype(np.int64).reshape(len(c["ids"]), c["width"]), width)
    high, low = (_wide(np.frombuffer(c[x], np.int64).reshape(len(c["seen"]), c["width"]), width) for x in ("high", "low"))
    q = _wide(q, width)
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (q, v)]
    kind = np.float64 if most[0] * most[1] * width < _EXACT else object  # whole numbers either way, never rounded
    q, v, high, low, best = (x.astype(kind) for x in (q, v, high, low, kth))
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T  # query x depth
    ids = c["ids"]
    tie = np.empty(len(ids), np.int64)
    tie[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
    place: dict[int, list[int]] = {}
    for i, x in enumerate(ids):
        place.setdefault(x, []).append(i)
    own_row, own_col = (np.array(x, np.int64) for x in zip(*[(r, i) for r, x in enumerate(own) for i in place.get(x, [])])) if any(x in place for x in own) else (np.zeros(0, np.int64),) * 2
    row, col, score, n_scored, begin = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind), 0, 0
    for level, end in enumerate(c["seen"]):
        live = np.flatnonzero((best <= bound[:, level]).astype(bool))  # an equal score may still win by its id
        if not len(live):
            break
        if end > begin:
            s = q[live] @ v[begin:end].T
            n_scored += s.size
            fits = (s >= best[live][:, None]).astype(bool)
            inside = (own_col >= begin) & (own_col < end) & np.isin(own_row, live)
            fits[np.searchsorted(live, own_row[inside]), own_col[inside] - begin] = False
            r, j = np.nonzero(fits)
            row, col, score = np.concatenate([row, live[r]]), np.concatenate([col, j + begin]), np.concatenate([score, s[r, j]])
            order = np.lexsort((tie[col], -score, row))
            nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            last = order[nth == k - 1]
            best[row[last]] = np.maximum(best[row[last]], score[last])
            row, col, score = (x[order[nth < k]] for x in (row, col, score))
        begin = end
    raised = np.flatnonzero((best > kth).astype(bool))
    kth[raised] = [int(x) for x in best[raised].tolist()]
    return row, col, score, n_scored


def _scan(k: int):
    """mapInArrow function: pairs of a query block and a candidate block to (slot, query_id, vec_id, score)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, limit = None, (1 << 63) - 1
        for batch in batches:
            for p in range(len(batch)):
                one = batch.slice(p, 1).to_pylist()[0]
                if one["q_block"] != at:  # what a query has found in one block bounds the next ones
                    at, own = one["q_block"], one["q_ids"]
                    q = np.frombuffer(one["q_data"], one["q_kind"]).astype(np.int64).reshape(len(own), one["q_width"])
                    kth = np.full(len(own), -np.inf, object)
                row, col, score, _ = threshold_scan(q, own, one, kth, k)
                yield pa.record_batch([
                    pa.array(at * QUERY_ROWS + row), pa.array([own[i] for i in row.tolist()], pa.int64()), pa.array([one["ids"][j] for j in col.tolist()], pa.int64()),
                    pa.array([max(-limit - 1, min(limit, int(s))) for s in score.tolist()], pa.int64())], ["slot", "query_id", "vec_id", "score"])

    return scan


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding",
          block_rows: int = BLOCK_ROWS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row for which ``is_query`` holds, all if there are fewer.

    Components count as floor(``scale`` * x); the score is their integer inner product, exact at any size (one that no
    long holds stops at the largest long). Ties go to the smaller vec_id, NULL last. Vectors that are NULL or hold a NULL or
    non-finite component take no part; in a shorter vector the missing components are 0 (an empty one scores 0). Equal
    rows (vec_id and vector) are one row. Rows of a query's own vec_id are no candidates of it; a vec_id with two
    vectors is two queries. An empty table gives no rows.

    Of equal vectors only the k + 1 smallest ids can be among a query's k best, so the others leave first; a vector
    that a third of all rows share costs k + 1 rows. Queries meet the candidates in blocks, so a task
    holds one query block and at most ``group_blocks`` candidate blocks; queries are dealt to every group of
    candidate blocks.
    """
    spark = rows.sparkSession
    x = F.transform(F.col(embedding), lambda c: F.floor(c.cast("double") * scale))
    used = rows.where(valid(F.col(embedding)))
    some = stored(used.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asked")).groupBy("vec_id", "x").agg(F.max("asked").alias("asked")))
    first = F.row_number().over(Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last()))
    index = stored(some.select("vec_id", "x").withColumn("_n", first).where(F.col("_n") <= k + 1).drop("_n").repartition(_parts(some, block_rows), F.xxhash64("vec_id", "x"))
                   .mapInArrow(_packed(block_rows, True), _INDEX_SQL))
    asked = stored(some.where("asked").select("vec_id", "x").mapInArrow(_packed(QUERY_ROWS, False), _QUERY_SQL))
    n_blocks = index.count()
    groups = max(1, -(-n_blocks // group_blocks), min(n_blocks, 2 * spark.sparkContext.defaultParallelism))
    left = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    pairs = left.join(index.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).hint("merge"), "g").drop("g", "block")
    found = pairs.mapInArrow(_scan(k), "slot long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parts(rows: DataFrame, block_rows: int) -> int:
    """Partitions of whole blocks: about four blocks each."""
    return max(1, -(-rows.count() // (4 * block_rows)))
