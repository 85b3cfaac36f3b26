"""Repeated windows: seeds on winnowed anchors, extension to both sides.

Items are words or bytes. The anchor of a window of ``window`` items is its smallest run of ``gram`` items by
hash (winnowing), so equal windows have equal anchors at equal offsets; consecutive windows mostly share
one. Anchors that occur once are dropped; the windows of every other one are compared by extending it to
the left and to the right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import words as W
from .store import stored

_U = np.uint64
#: Bytes of contexts that are compared at once; a key is never cut.
CHUNK = 4 << 20
#: Occurrences of an anchor from which on its windows travel alone, each under its own hash.
HOT = 20_000
RANGES = "array<struct<start:int,end:int>>"


class Unit:
    """How a batch's texts become items: (items, document offsets in items)."""

    def __init__(self, kind: str, window: int, gram: int):
        if not 0 < gram <= window <= gram + 254:
            raise ValueError("gram must be between 1 and window, and at most 254 items shorter")
        self.kind, self.window, self.gram = kind, window, gram

    def items(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "byte":
            return W._BYTES[raw], offsets
        starts, ends, counts = W.spans(raw, offsets)
        return W.word_hashes(raw, starts, ends), np.concatenate([[0], np.cumsum(counts)])

    def anchors(self, items: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, hash, mark) of the anchors of a block; see ``unpack`` for marks, which count from the document."""
        grams = W.gram_hashes(items, self.gram)
        owner = W.smallest(grams, self.window - self.gram + 1)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(owner)]
        whole = np.flatnonzero(np.arange(len(owner)) + self.window <= offsets[doc + 1])
        own = owner[whole]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        at, start = own[new], whole[new]
        n = np.diff(np.concatenate([new, [len(own)]]))
        return at, grams[at], ((at - offsets[doc[start]]) << 16) + ((at - start) << 8) + n


def unpack(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, items of the first owned window before it, number of owned windows)."""
    return marks >> 16, marks >> 8 & 255, marks & 255


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def occurrences(src: DataFrame, unit: Unit, hot: int = HOT) -> DataFrame:
    """(doc_id, marks, hot): for every document, the marks of its anchors that occur elsewhere.

    ``hot`` lists, once or more over all documents, the keys of anchors with more than ``hot`` occurrences.

    A batch sends a repeated anchor once under its hash; its other occurrences are known to repeat and
    travel under keys of their own, so a passage that a third of the documents share stays spread.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.flat(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for lo, hi in W.blocks(offsets):
                items, own = unit.items(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at, key, mark = unit.anchors(items, own)
                parts.append((key, ids[lo + np.searchsorted(own, at, "right") - 1].astype(np.int64), mark))
            if parts:
                key, doc, mark = (np.concatenate(x) for x in zip(*parts))
                _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                later = first[inverse] != np.arange(len(key))
                n = np.where(later, 0, count[inverse])
                key = np.where(later, W.mix(doc.astype(_U) * _U(0x9E3779B97F4A7C15) + mark.astype(_U)), key)
                yield pa.record_batch([_signed(key), pa.array(doc), pa.array(mark), pa.array(n)], ["key", "doc_id", "mark", "n"])
            W.give_back()

    by_key = Window.partitionBy("key").orderBy("doc_id")
    rows = src.where("doc_id is not null").mapInArrow(emit, "key long, doc_id long, mark long, n long")
    so_far = F.sum("n").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    again = rows.select("doc_id", "mark", "n", F.lag("mark").over(by_key).alias("l"), F.lead("mark").over(by_key).alias("r"), F.when(so_far > hot, F.col("key")).alias("key"))
    return stored(again.where("n != 1 or l is not null or r is not null").groupBy("doc_id").agg(F.collect_set("mark").alias("marks"), F.collect_set("key").alias("hot")))


def dealt(src: DataFrame) -> DataFrame:
    """The texts of rows with a doc_id as both joins read them: equal plans, so Spark deals the texts once."""
    return src.where("doc_id is not null").select("doc_id", "text")


def contexts(src: DataFrame, marked: DataFrame, unit: Unit, payload: Callable) -> DataFrame:
    """One row for each distinct context of an anchor in a task: (key, doc_id, start, own, data, end).

    ``data`` is what ``payload`` makes of the owned windows. Later equal contexts of the task (documents
    come in order of doc_id) repeat as a whole: they are sent as ranges, with ``data`` NULL.

    The windows of a hot anchor are contexts of one window each, whose key is a hash of the whole window. So
    different windows of one anchor don't meet, and of equal ones a task sends one. The driver collects the
    hot keys: 8 bytes for every ``HOT`` anchors at most.
    """
    keys = [r.key for r in marked.select(F.explode("hot").alias("key")).distinct().collect()]
    hot = np.sort(np.array(keys, np.int64)).view(_U)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for batch in batches:
            raw, offsets = W.flat(batch.column(1))
            ids = batch.column(0).to_pylist()
            marks = batch.column(2)
            for lo, hi in W.blocks(offsets):
                piece, cut = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                items, own = unit.items(piece, cut)
                lists = [np.sort(np.asarray(marks[d].values)) for d in range(lo, hi)]
                doc = np.repeat(np.arange(hi - lo), [len(x) for x in lists])
                packed = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)
                at, back, n = unpack(packed)
                at = at + own[doc]
                key = W.gram_hashes(items, unit.gram)[at]
                alone = np.isin(key, hot)
                if alone.any():
                    times = np.where(alone, n, 1)
                    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at, back, n, doc, key, alone = (np.repeat(x, times) for x in (at, back, n, doc, key, alone))
                    back, n = back - place, np.where(alone, 1, n)
                start = at - back
                stop = start + n - 1 + unit.window
                same = W.range_hashes(items, start, stop) ^ W.mix(back.astype(_U))
                key = np.where(alone, W.mix(key + same), key)
                data = payload(unit, piece, items, at, back, stop)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                local = start - own[doc]
                ends = stop - own[doc]
                for i, pair in enumerate(zip(key.tolist(), same.tolist())):
                    mine = (ids[lo + int(doc[i])], int(local[i]))
                    first = seen.setdefault(pair, mine)
                    if first is mine:
                        row = (pair[0], mine[0], mine[1], int(back[i]), data(i), int(ends[i]))
                    elif first != mine:
                        if out[4] and out[4][-1] is None and out[1][-1] == mine[0] and out[5][-1] >= mine[1]:
                            out[5][-1] = int(ends[i])
                            continue
                        row = (pair[1], mine[0], mine[1], int(back[i]), None, int(ends[i]))
                    else:
                        continue
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.record_batch([
                    _signed(np.array(out[0], _U)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()),
                    pa.array(out[4], pa.binary()), pa.array(out[5], pa.int32())], ["key", "doc_id", "start", "own", "data", "end"])
            W.give_back()

    joined = dealt(src).join(marked.select("doc_id", "marks").hint("merge"), "doc_id").select("doc_id", "text", "marks").sortWithinPartitions("doc_id")
    return joined.mapInArrow(emit, "key long, doc_id long, start int, own int, data binary, end int")


def resolve(rows: DataFrame, unit: Unit, judge: Callable) -> DataFrame:
    """(doc_id, start, end): ranges covered by windows that also start earlier.

    Contexts of one key meet in one task, sorted; about ``CHUNK`` bytes of keys are judged at once. A key
    has at most ``HOT`` contexts, or one a task of ``contexts``.
    ``judge(unit, key, doc, start, own, data, length)`` gets them in order of (doc_id, start) and returns a
    boolean matrix (context x owned start).
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(tables: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(tables).sort_by([("doc_id", "ascending"), ("start", "ascending")])
            doc, start, own = (t.column(c).to_numpy() for c in ("doc_id", "start", "own"))
            length = t.column("end").to_numpy() - start
            hit = judge(unit, t.column("key").to_numpy(), doc, start, own, t.column("data").to_pylist(), length)
            side = np.zeros((len(hit), 1), bool)
            change = np.diff(np.concatenate([side, hit, side], 1).astype(np.int8), axis=1)
            row, a = np.nonzero(change == 1)
            _, b = np.nonzero(change == -1)
            return pa.record_batch([pa.array(doc[row]), pa.array((start[row] + a).astype(np.int32)), pa.array((start[row] + b - 1 + unit.window).astype(np.int32))], ["doc_id", "start", "end"])

        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            known = t.filter(pa.compute.is_null(t.column("data")))
            if len(known):
                yield from known.select(["doc_id", "start", "end"]).combine_chunks().to_batches()
            t = t.filter(pa.compute.is_valid(t.column("data")))
            if not len(t):
                continue
            held.append(t)
            size += t.nbytes
            if size >= CHUNK:
                last = t.column("key")[-1].as_py()
                every = pa.concat_tables(held)
                key = every.column("key").to_numpy()
                upto = int(np.searchsorted(key, last, "left"))
                if upto:
                    yield done([every.slice(0, upto)])
                    held = [every.slice(upto)]
                    size = held[0].nbytes
        if held:
            yield done(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(emit, "doc_id long, start int, end int")


def extensions(unit: Unit, raw: np.ndarray, items: np.ndarray, at: np.ndarray, back: np.ndarray, stop: np.ndarray) -> Callable:
    """Payload: for each owned window, a hash of its extension to the left and to the right of the anchor."""
    n = stop - (at - back) - unit.window + 1
    first = np.concatenate([[0], np.cumsum(n)])
    start = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(at - back, n)
    anchor = np.repeat(at, n)
    left = W.range_hashes(items, start, anchor)
    right = W.range_hashes(items, anchor + unit.gram, start + unit.window)
    both = W.mix(left ^ W.mix(right))
    return lambda i: both[first[i] : first[i + 1]].tobytes()


def judge_extensions(unit: Unit, key, doc, start, own, data, length) -> np.ndarray:
    """Windows whose anchor and both extensions occur earlier."""
    counts = np.array([len(x) // 8 for x in data])
    flat = np.frombuffer(b"".join(data), _U)
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(flat)) - first[row]
    group = W.mix(flat ^ W.mix(key.view(_U)[row] + (own[row] - place).astype(_U)))
    return earlier(group, row, place, doc, start, own, unit)


def earlier(group, row, place, doc, start, own, unit: Unit) -> np.ndarray:
    """Matrix of the windows whose group has a window with a smaller (doc_id, start)."""
    begin = start[row] + place
    order = np.lexsort((begin, doc[row]))
    _, first, inverse = np.unique(group[order], return_index=True, return_inverse=True)
    head = order[first][inverse]
    mine = order
    hit = np.zeros((len(own), unit.window - unit.gram + 1), bool)
    is_later = (doc[row[head]] != doc[row[mine]]) | (begin[head] != begin[mine])
    hit[row[mine][is_later], place[mine][is_later]] = True
    return hit


def repeated_ranges(docs: DataFrame, unit: Unit, payload: Callable = extensions, judge: Callable = judge_extensions, hot: int = HOT) -> DataFrame:
    """(doc_id, ranges) of documents (doc_id, text) with items covered by a window that also starts earlier."""
    rows = resolve(contexts(docs, occurrences(docs, unit, hot), unit, payload), unit, judge)
    return rows.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def merged(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((r["start"], r["end"]) for r in ranges or []):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def _cleaned(unit: Unit, texts: pa.Array, ranges: pa.Array, give_text: bool) -> pa.Array:
    raw, offsets = W.flat(texts)
    out = []
    for lo, hi in W.blocks(offsets):
        piece, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, counts = W.spans(piece, own) if unit.kind == "word" else (None, None, np.diff(own))
        first = np.concatenate([[0], np.cumsum(counts)])
        data = piece.tobytes()
        for d, found in enumerate(ranges.slice(lo, hi - lo).to_pylist()):
            gone = merged(found)
            edge = [0, *[x for r in gone for x in r], int(counts[d])]
            if unit.kind == "byte":
                base = int(own[d])
                kept = b"".join(data[base + a : base + b] for a, b in zip(edge[::2], edge[1::2]))
            else:
                kept = b" ".join(data[starts[i] : ends[i]] for a, b in zip(edge[::2], edge[1::2]) for i in range(first[d] + a, first[d] + b))
            row = {"n_items": int(counts[d]), "n_removed": sum(b - a for a, b in gone), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            out.append(row | ({"kept": kept.decode("utf-8", "replace")} if give_text else {}))
    W.give_back()
    fields = [("n_items", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    return pa.array(out, pa.struct(fields + [("kept", pa.string())] * give_text))


def remove(docs: DataFrame, unit: Unit, payload: Callable = extensions, judge: Callable = judge_extensions, give_text: bool = False,
           doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_items, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining text) of every row.

    An item goes when a window of ``unit.window`` items that covers it also starts earlier: in a document
    with a smaller doc_id, or earlier in the same one. Windows are judged on the input. NULL text is
    empty; a text shorter than a window keeps all. Rows of one doc_id must hold one text and are one
    document; a row with a NULL doc_id keeps all and is no earlier occurrence of anything.
    """
    same = doc_id == "doc_id" and dict(docs.dtypes)[doc_id] == "bigint"  # a plain column keeps both reads of the texts equal
    src = docs.select("doc_id" if same else F.col(doc_id).cast("long").alias("doc_id"), "text" if text == "text" else F.col(text).alias("text"))
    found = repeated_ranges(src, unit, payload, judge, hot)
    kind = "struct<n_items: long, n_removed: long, n_spans: long, kept_sha256: string" + (", kept: string>" if give_text else ">")
    clean = F.arrow_udf(lambda texts, ranges: _cleaned(unit, texts, ranges, give_text), kind)
    none = src.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(RANGES).alias("ranges"))
    every = dealt(src).join(found.hint("merge"), "doc_id", "left").select("doc_id", "text", "ranges").union(none)
    return every.select("doc_id", clean("text", "ranges").alias("r")).select("doc_id", "r.*")
