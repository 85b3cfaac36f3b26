"""Line dedup with a log-template tree.

Lines go down a tree of fixed depth: number of tokens, then the leading tokens. In a leaf, a field is constant
where more than half of the leaf's lines hold the same token; the other fields are variable. What remains is the
line's template. Templates that recur across documents are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .store import stored

_U = np.uint64
#: Hash of a variable field.
ANY = 0
#: Leading tokens that the tree branches on.
DEPTH = 2
#: Documents that a dropped template needs.
MIN_DOCS = 3
#: Tenths of the tokens after the leading ones that a generalised template keeps constant.
CONSTANT_TENTHS = 6
#: Parts into which the rows of one leaf or template are split when they meet its summary.
SALTS = 8
#: Bits of the map of leaves that enough documents share: 8 MB, whatever the number of leaves.
MAP_BITS = 1 << 26


class Lines:
    """The non-blank lines of a block of documents, with hashed tokens; one with a digit is variable from the start."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        starts, ends, counts = W.spans(raw, offsets)
        exact = W.word_hashes(raw, starts, ends)
        digits = np.concatenate([[0], np.cumsum((raw >= 0x30) & (raw <= 0x39))])
        self.tokens = np.where(digits[ends] > digits[starts], _U(ANY), exact | _U(1))
        breaks = np.flatnonzero(raw == 0x0A)
        doc = np.repeat(np.arange(len(counts)), counts)
        line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[doc]
        new = np.ones(len(starts), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        self.head = np.flatnonzero(new)
        self.stop = np.concatenate([self.head[1:], [len(starts)]]).astype(np.int64)
        self.doc, self.line, self.n = doc[self.head], line[self.head], self.stop - self.head
        first = self.tokens[self.head]
        second = self.tokens[np.minimum(self.head + 1, max(len(starts) - 1, 0))] if len(starts) else first
        self.leaf = W.mix(W.mix(self.n.astype(_U)) + W.mix(first + _U(2)) * _U(3) + np.where(self.n > 1, W.mix(second + _U(5)), _U(0)))
        general = np.concatenate([[0], np.cumsum(self.tokens != _U(ANY))])
        some = general[self.stop] > general[self.head]
        self.whole = np.where(some, W.range_hashes(self.tokens, self.head, self.stop), ~W.range_hashes(exact, self.head, self.stop))
        self.some = some


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Lines]]:
    for batch in batches:
        raw, offsets = W.flat(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in W.blocks(offsets):
            yield ids[lo:hi], Lines(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        W.give_back()


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def shared_leaves(docs: DataFrame, min_docs: int) -> np.ndarray:
    """A map of ``MAP_BITS`` bits with the leaves of at least ``min_docs`` rows; other leaves rarely share a bit."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            pair = np.unique(np.rec.fromarrays([x.leaf, x.doc]))
            leaf, n = np.unique(pair.f0, return_counts=True)
            yield pa.record_batch([_signed(leaf), pa.array(n)], ["leaf", "n"])

    many = docs.mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    bit = F.pmod("leaf", F.lit(MAP_BITS)) + 1  # places in these maps count from 1
    parts = many.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for part, bits in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist()):  # parts count from 1 and hold 32,768 bits
        at = (part - 1) * 4096
        out[at : at + len(bits)] = np.frombuffer(bits, np.uint8)[: len(out) - at]
    return out


def live_lines(docs: DataFrame, leaves) -> DataFrame:
    """(doc_id, line_no, leaf, whole, some, tokens, salt) of the lines whose leaf is on the broadcast map ``leaves``."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = leaves.value
        for ids, x in _blocks(batches):
            at = (x.leaf.view(np.int64) % MAP_BITS).astype(np.int64)
            use = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            n = x.n[use]
            edge = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            flat = np.repeat(x.head[use], n) + np.arange(edge[-1]) - np.repeat(edge[:-1], n)
            tokens = pa.ListArray.from_arrays(pa.array(edge), _signed(x.tokens[flat]))
            doc = ids[x.doc[use]].astype(np.int64)
            salt = (W.mix(doc.astype(_U)) % _U(SALTS)).astype(np.int32)
            yield pa.record_batch([pa.array(doc), pa.array(x.line[use].astype(np.int32)), _signed(x.leaf[use]), _signed(x.whole[use]), pa.array(x.some[use]), tokens, pa.array(salt)],
                                  ["doc_id", "line_no", "leaf", "whole", "some", "tokens", "salt"])

    return docs.mapInArrow(emit, "doc_id long, line_no int, leaf long, whole long, some boolean, tokens array<long>, salt int")


def _with_salts(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def constants(near: DataFrame) -> DataFrame:
    """(leaf, places, values): the fields after the leading ones of which more than half of the leaf's lines hold one token."""
    fields = near.select("leaf", F.posexplode("tokens").alias("place", "token")).where((F.col("place") >= DEPTH) & (F.col("token") != ANY))
    often = fields.groupBy("leaf", "place", "token").agg(F.count("*").alias("n")).where("n > 1")
    sizes = near.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1")
    most = often.join(sizes, "leaf").where("2 * n > lines")
    return most.groupBy("leaf").agg(F.collect_list("place").alias("places"), F.collect_list("token").alias("values"))


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The template of every line: its leaf and the constants it holds, or the line as a whole if those are too few."""
    for batch in batches:
        size = np.cumsum(pa.compute.list_value_length(batch.column("tokens")).to_numpy())
        lo = 0
        while lo < len(batch):  # about a block's tokens at a time
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + W.BLOCK // 8, "right")))
            part, lo = batch.slice(lo, hi - lo), hi
            leaf, whole, some = (part.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "whole", "some"))
            tokens, places, values = (part.column(c) for c in ("tokens", "places", "values"))
            n = pa.compute.list_value_length(tokens).to_numpy()
            first = np.cumsum(n) - n
            row = np.repeat(np.arange(len(part)), pa.compute.fill_null(pa.compute.list_value_length(places), 0).to_numpy())
            place, value = places.flatten().to_numpy(), values.flatten().to_numpy()
            held = tokens.flatten().to_numpy()[first[row] + place] == value
            row, place, value = row[held], place[held], value[held]
            fixed = np.bincount(row, minlength=len(part))
            total = np.zeros(len(part), _U)
            np.add.at(total, row, W.mix(value.view(_U) ^ W.mix(place.astype(_U) + _U(1))))
            general = some & (fixed * 10 >= (n - DEPTH) * CONSTANT_TENTHS)
            template = np.where(general, W.mix(leaf.view(_U) + total), W.mix(whole.view(_U) ^ _U(0x9E3779B97F4A7C15)))
            yield pa.record_batch([part.column("doc_id"), part.column("line_no"), _signed(template), part.column("salt")], ["doc_id", "line_no", "template", "salt"])
        W.give_back()


def templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, line_no, template, salt) of lines in leaves that ``min_docs`` rows share.

    A leaf's lines are never gathered: tokens are counted by (leaf, place, token), and the constants, a row a leaf, come
    to the lines by a join on leaf and salt. Only the map of shared leaves passes the driver.
    """
    sent = docs.sparkSession.sparkContext.broadcast(shared_leaves(docs, min_docs))
    near = stored(live_lines(docs, sent))
    sent.destroy()
    met = near.join(_with_salts(constants(near)), ["leaf", "salt"], "left").select("doc_id", "line_no", "leaf", "whole", "some", "tokens", "places", "values", "salt")
    return met.mapInArrow(_name, "doc_id long, line_no int, template long, salt int")


def _kept(give_text: bool):
    def kept(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts, dropped):
            lines, gone = (text.as_py() or "").split("\n"), set(gone.as_py() or [])
            left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            row = {"n_lines": len(lines), "n_dropped": len(gone), "kept_sha256": hashlib.sha256(left.encode("utf-8", "replace")).hexdigest()}
            out.append(row | ({"kept": left} if give_text else {}))
        W.give_back()
        return pa.array(out, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * give_text))

    return kept


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", give_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and ``kept``, the remaining text) of every row.

    Lines end at line feeds; every line with a token goes down the tree, and all lines of a template that
    occurs in ``min_docs`` documents go. A line of at most two tokens is its own template, numbers variable; one of
    variable tokens only stands for itself, numbers and all. Blank lines stay. NULL text is one empty line. Rows of
    one doc_id must hold one text and are one document (each row weighs in the shares); a row with a NULL doc_id keeps
    all its lines and counts for nothing.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = stored(templates(src.where("doc_id is not null"), min_docs))
    recurring = named.select("template", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    gone = named.join(_with_salts(recurring.select("template")), ["template", "salt"], "left_semi").groupBy("doc_id").agg(F.collect_set("line_no").alias("dropped"))
    clean = F.arrow_udf(_kept(give_text), "struct<n_lines: long, n_dropped: long, kept_sha256: string" + ", kept: string" * give_text + ">")
    return src.join(gone, "doc_id", "left").select("doc_id", clean("text", "dropped").alias("r")).select("doc_id", "r.*")
