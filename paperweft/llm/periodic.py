"""Periodic runs of words: tiles per period octave, boundary Z-functions, fragments stitched by document and period.

A run of period q is a maximal stretch in which words q apart are equal; it shows as an interval of places i with
word[i] = word[i + q]. For the octave of periods P <= q < 2P every document has boundaries each 2P words. Such an
interval of at least 3q places holds a boundary b with the P + 1 places from b on, so the octave's run passes a
tile whose words from b equal those from b + q. Tiles that pass this screen are rows of their own and are solved
anywhere: the Z-function of the words from the boundary and the one of the reversed words before it give, for all
periods of the octave at once, how far the equality reaches to both sides within the tile. The intervals of
neighbouring tiles overlap; after a shuffle by document and period they are stitched to whole runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .store import stored

#: Tiles that travel in one row at most, and words in one such row beyond a single tile.
TILES, ROW_WORDS = 64, 1 << 16
_PAIRS = 1 << 18
_U = np.uint64
RESULT = "struct<n_runs: long, start: long, length: long, period: long, exponent_milli: long, runs_sha256: string, collapsed_sha256: string, collapsed: string>"


def least_interval(period: int) -> int:
    """Places that a run's interval has at least: its length is at least 6 and 4 periods."""
    return max(6, 4 * period) - period


@lru_cache(64)
def octave_shape(octave: int) -> tuple[int, int, int]:
    """(stride of boundaries, places from a boundary on that every long interval holds, reach of a tile to the right)."""
    stride = 2 * octave
    sure = min(least_interval(q) for q in range(octave, min(2 * octave, octave + 4))) - stride + 1
    return stride, sure, stride + sure - 1


def z_function(x: list[int]) -> list[int]:
    """Length of the longest common prefix of the whole list and its suffix from each place on."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(1 << 16)
def _prime_divisors(n: int) -> tuple[int, ...]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return tuple(out + [n] * (n > 1))


def solve_tile(x: list[int], b: int, octave: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end): intervals of equal places around boundary ``b``, clipped to its tile.

    A period whose root is a power of a shorter word is left out: the shorter period has the run. The root is
    whole inside the tile, so all tiles of a run agree.
    """
    stride, sure, reach = octave_shape(octave)
    forward = z_function(x[b : b + reach + 2 * octave])
    fitting = [q for q in range(octave, min(2 * octave, len(forward))) if forward[q] >= sure]
    if not fitting:
        return
    low, high = max(0, b - stride), min(len(x), b + 2 * octave)
    before = x[low:b][::-1]
    backward = z_function(before + [-1] + x[low:high][::-1])[len(before) + 1 :]
    for q in fitting:
        if all(forward[q // r] < q - q // r for r in _prime_divisors(q)):
            back = backward[high - b - q] if b + q <= high and high - b - q < len(backward) else 0
            yield q, b - back, b + min(forward[q], reach)


def screened(codes: np.ndarray, first: np.ndarray, octave: int) -> np.ndarray:
    """Boundaries (places in ``codes``) of the octave whose next words recur one of its periods later.

    ``first`` are the documents' first words and the end; hashes of word runs are compared, so no tile is missed.
    """
    stride, sure, _ = octave_shape(octave)
    count = np.diff(first)
    docs = np.flatnonzero(count >= max(6, 4 * octave))
    if not len(docs):
        return np.zeros(0, np.int64)
    grams = W.gram_hashes(codes, sure)
    n = -(-(count[docs] - octave - sure + 1) // stride)  # boundaries that leave room for the least period
    doc = np.repeat(docs, n)
    at = first[doc] + stride * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    room = first[doc + 1] - sure - at  # largest period that fits
    hit = np.zeros(len(at), bool)
    step = max(1, _PAIRS // octave)
    for lo in range(0, len(at), step):
        here = at[lo : lo + step, None] + np.arange(octave, 2 * octave)
        fits = np.arange(octave, 2 * octave) <= room[lo : lo + step, None]
        hit[lo : lo + step] = ((grams[np.minimum(here, len(grams) - 1)] == grams[at[lo : lo + step]][:, None]) & fits).any(1)
    return at[hit]


def tile_rows(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(document, octave, first boundary, tiles, first word, words) of the tiles that pass; neighbours share a row."""
    octave, longest = 1, int(np.diff(first).max(initial=0))
    while 4 * octave <= longest and longest >= 6:
        stride, _, reach = octave_shape(octave)
        at = screened(codes, first, octave)
        doc = np.searchsorted(first, at, "right") - 1
        most = min(TILES, max(1, ROW_WORDS // stride))
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + stride)
        head = np.flatnonzero(new)
        nth = np.arange(len(at)) - np.repeat(head, np.diff(np.concatenate([head, [len(at)]])))
        head = np.flatnonzero(nth % most == 0)
        for i, j in zip(head.tolist(), [*head[1:].tolist(), len(at)]):
            d, base, end = int(doc[i]), int(first[doc[i]]), int(first[doc[i] + 1])
            low, high = max(base, int(at[i]) - stride), min(end, int(at[j - 1]) + reach + 2 * octave)
            _, ranks = np.unique(codes[low:high], return_inverse=True)
            yield d, octave, int(at[i]) - low, j - i, low - base, ranks.astype(np.int32).tobytes()
        octave *= 2


_ROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tiles", pa.int32()), ("text", pa.string()), ("plain_sha256", pa.string()),
                  ("octave", pa.int32()), ("boundary", pa.int32()), ("tiles", pa.int32()), ("low", pa.int32()), ("words", pa.binary()), ("plain", pa.string())])
_ROW_SQL = "row long, doc_id long, n_tiles int, text string, plain_sha256 string, octave int, boundary int, tiles int, low int, words binary, plain string"


def _explode(give_text: bool):
    """mapInArrow function: a row for each document (octave NULL) and one for each group of its tiles."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, offsets = W.flat(batch.column(1))
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in W.blocks(offsets):
                piece, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, counts = W.spans(piece, own)
                codes = W.word_hashes(piece, starts, ends)
                tiles = list(tile_rows(codes, np.concatenate([[0], np.cumsum(counts)])))
                n_tiles = np.bincount([t[0] for t in tiles], minlength=hi - lo) if tiles else np.zeros(hi - lo, np.int64)
                data, out = piece.tobytes(), []
                for d in range(hi - lo):
                    some = n_tiles[d] > 0
                    plain = b"" if some else b" ".join(data[own[d] : own[d + 1]].split())
                    out.append({"row": row + d, "doc_id": ids[lo + d], "n_tiles": int(n_tiles[d]), "text": texts[lo + d].as_py() if some else None,
                                "plain_sha256": None if some else hashlib.sha256(plain).hexdigest(), "plain": plain.decode("utf-8", "replace") if give_text and not some else None})
                out += [{"row": row + d, "octave": o, "boundary": b, "tiles": k, "low": low, "words": w} for d, o, b, k, low, w in tiles]
                yield pa.RecordBatch.from_pylist(out, _ROW)
                row += hi - lo

    return explode


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals (row, period, start, end) of every group of tiles, those of neighbouring tiles joined."""
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for one in batch.to_pylist():
            x = np.frombuffer(one["words"], np.int32).tolist()
            stride, open_ = octave_shape(one["octave"])[0], {}
            for b in range(one["boundary"], one["boundary"] + stride * one["tiles"], stride):
                for q, s, e in solve_tile(x, b, one["octave"]):
                    have = open_.get(q)
                    if have and s <= have[1]:
                        open_[q] = (have[0], e)
                    else:
                        if have:
                            out.append((one["row"], q, have[0] + one["low"], have[1] + one["low"]))
                        open_[q] = (s, e)
            out += [(one["row"], q, s + one["low"], e + one["low"]) for q, (s, e) in open_.items()]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 4, ["row", "period", "start", "end"])


def stitched(fragments: DataFrame) -> DataFrame:
    """(row, runs): fragments of a document and period that touch are one interval; those long enough are its runs."""
    by = Window.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = fragments.withColumn("reach", reach).withColumn("part", part).groupBy("row", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long_enough = whole.where(F.col("end") - F.col("start") + F.col("period") >= F.greatest(F.lit(6), 4 * F.col("period")))
    run = F.struct("start", "period", (F.col("end") - F.col("start") + F.col("period")).alias("length"))
    return long_enough.groupBy("row").agg(F.array_sort(F.collect_list(run)).alias("runs"))


def _summary(give_text: bool):
    def summary(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), runs.to_pylist()):
            words, at, kept = (text or "").encode("utf-8", "replace").split(), 0, []
            for r in sorted(found or [], key=lambda r: r["start"] + r["period"]):
                gone = r["start"] + r["period"]
                kept += words[at:gone] if gone > at else []
                at = max(at, r["start"] + r["length"])
            collapsed = b" ".join(kept + words[at:])
            best = min(found, key=lambda r: (-r["length"], r["start"], r["period"])) if found else None
            lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in found or [])
            out.append({"n_runs": len(found or []), "start": best and best["start"], "length": best and best["length"], "period": best and best["period"],
                        "exponent_milli": best and 1000 * best["length"] // best["period"], "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
                        "collapsed_sha256": hashlib.sha256(collapsed).hexdigest(), "collapsed": collapsed.decode("utf-8", "replace") if give_text else None})
        longs, texts_ = ("n_runs", "start", "length", "period", "exponent_milli"), ("runs_sha256", "collapsed_sha256", "collapsed")
        return pa.array(out, pa.struct([(c, pa.int64()) for c in longs] + [(c, pa.string()) for c in texts_]))

    return summary


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", give_runs: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256 of every row.

    Words lie between ASCII white space and count from 0. A run is a stretch of consecutive words with smallest
    period q and length of at least 6 and 4 q that can't grow with that period. ``collapsed`` keeps the first q words
    of every run; of overlapping runs each drops its own. ``give_runs`` adds ``runs`` (start, period, length) and
    ``collapsed``. Ties for the longest go to the smallest start, then period; without runs its four values are NULL.
    NULL and blank texts have no words. Rows are documents of their own, so repeated and NULL doc_ids are kept and
    answered row by row. A long document's tiles are spread over tasks; only its words' hashes and its intervals
    are held whole by one.
    """
    rows = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_explode(give_runs), _ROW_SQL))
    tiles = rows.where("octave is not null").select("row", "octave", "boundary", "tiles", "low", "words")
    fragments = tiles.repartition("row", "octave", "low").mapInArrow(_solve, "row long, period long, start long, end long")
    every = rows.where("octave is null").select("row", "doc_id", "n_tiles", "text", "plain_sha256", "plain")
    none = F.lit(None).cast("long")
    plain = every.where("n_tiles = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.sha2(F.lit(b""), 256).alias("runs_sha256"), F.col("plain_sha256").alias("collapsed_sha256"),
        *([F.col("plain").alias("collapsed"), F.expr("cast(array() as array<struct<start: long, period: long, length: long>>)").alias("runs")] if give_runs else []))
    summary = F.arrow_udf(_summary(give_runs), RESULT)
    found = every.where("n_tiles > 0").join(stitched(fragments), "row", "left").select("doc_id", summary("text", "runs").alias("r"), "runs")
    extra = ["r.collapsed", F.coalesce("runs", F.expr("cast(array() as array<struct<start: long, period: long, length: long>>)")).alias("runs")] if give_runs else []
    return plain.union(found.select("doc_id", *[f"r.{c}" for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")], *extra))
