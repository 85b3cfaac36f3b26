"""Benchmark decontamination with a generalised suffix automaton over words.

The test items are a bounded query set. They are cut into blocks of bounded size; each block
becomes one automaton, sent to the executors, and every document's words stream through it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .store import fresh

#: Characters of items in one automaton.
BLOCK_CHARS = 8_000_000
RESULT_TYPE = "struct<n_words: long, n_hit: long, items: array<string>, spans: array<struct<start: int, end: int>>>"


def item_words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and non-ASCII characters (UTF-8)."""
    raw, offsets = W.flat(pa.array([text], pa.large_string()))
    raw = W.lower(raw)
    starts, ends, _ = W.spans(raw, offsets, "alnum")
    return [raw[s:e].tobytes() for s, e in zip(starts, ends)]


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``windows[v]`` are the items with the window of ``size`` words that state v ends with; ``whole[v]``
    are the items shorter than that which end at v, with their length.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.size = size
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        symbols = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in seq]) for item, seq in items if seq]
        for _, seq in symbols:
            at = 0
            for c in seq:
                at = self._extend(at, c)
        n = len(self.next)
        self.windows: list[set[str]] = [set() for _ in range(n)]
        self.whole: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.window_state = list(range(n))
        for v in order:
            if self.length[self.link[v]] >= size:
                self.window_state[v] = self.window_state[self.link[v]]
        for item, seq in symbols:
            at = 0
            for i, c in enumerate(seq, 1):
                at = self.next[at][c]
                if i >= size:
                    self.windows[self.window_state[at]].add(item)
            if len(seq) < size:
                self.whole[at].append((len(seq), item))
        for v in order:
            self.whole[v] = self.whole[v] + self.whole[self.link[v]]
        self.shortest = min((min(len(seq), size) for _, seq in symbols), default=0)
        names = sorted(self.vocabulary, key=self.vocabulary.__getitem__)
        lengths = np.array([len(w) for w in names], np.int64)
        ends = np.cumsum(lengths)
        hashes = W.word_hashes(np.frombuffer(b"".join(names), np.uint8), ends - lengths, ends) if names else np.zeros(0, np.uint64)
        self.sorted_hashes = np.sort(hashes)

    def _clone(self, p: int, c: int, q: int) -> int:
        """The state for the longest strings of q that also end at p's extension by c."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def stream(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Longest match at every word: (covered word ranges, items with an occurring window)."""
        covered: list[tuple[int, int]] = []
        found: set[str] = set()
        v = matched = 0
        for i, w in enumerate(seq, 1):
            c = self.vocabulary.get(w, -1)
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                matched += 1
            if matched >= self.size:
                covered.append((i - matched, i))
                found |= self.windows[self.window_state[v]]
            for n, item in self.whole[v]:
                if n <= matched:
                    covered.append((i - n, i))
                    found.add(item)
        return covered, found


def scan(automaton: Automaton, texts: pa.Array, earlier: pa.Array | None = None) -> pa.Array:
    """Struct rows (n_words, n_hit, items, spans) of a batch; ``earlier`` are results of other blocks.

    A word outside the items' vocabulary resets the automaton, so only runs of known words that are
    long enough for a window are streamed; the vocabulary look-up is one vectorised search.
    """
    raw, offsets = W.flat(texts)
    before = earlier.to_pylist() if earlier is not None else None
    out = []
    for lo, hi in W.blocks(offsets):
        piece, own = W.lower(raw[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        starts, ends, counts = W.spans(piece, own, "alnum")
        first = np.concatenate([[0], np.cumsum(counts)])
        hits: dict[int, tuple[list, set]] = {}
        if len(starts) and len(automaton.sorted_hashes):
            h = W.word_hashes(piece, starts, ends)
            at = np.searchsorted(automaton.sorted_hashes, h)
            known = automaton.sorted_hashes[np.minimum(at, len(automaton.sorted_hashes) - 1)] == h
            edge = np.zeros(len(h) + 1, bool)
            edge[first] = True
            open_ = known & (edge[:-1] | np.concatenate([[True], ~known[:-1]]))
            close = known & (edge[1:] | np.concatenate([~known[1:], [True]]))
            runs = np.stack([np.flatnonzero(open_), np.flatnonzero(close) + 1], 1)
            runs = runs[runs[:, 1] - runs[:, 0] >= automaton.shortest]
            doc = np.searchsorted(first, runs[:, 0], "right") - 1
            data = piece.tobytes()
            for (a, b), d in zip(runs.tolist(), doc.tolist()):
                ranges, items = automaton.stream([data[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())])
                if ranges:
                    have = hits.setdefault(d, ([], set()))
                    have[0].extend((a - int(first[d]) + s, a - int(first[d]) + e) for s, e in ranges)
                    have[1].update(items)
        for d in range(hi - lo):
            ranges, items = hits.get(d, ([], set()))
            if before is not None:
                ranges = ranges + [(x["start"], x["end"]) for x in before[lo + d]["spans"]]
                items = items | set(before[lo + d]["items"])
            spans: list[list[int]] = []
            for s, e in sorted(ranges):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            out.append({"n_words": int(counts[d]), "n_hit": sum(e - s for s, e in spans), "items": sorted(items), "spans": [{"start": s, "end": e} for s, e in spans]})
    W.give_back()
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    return pa.array(out, kind)


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            out: str = "match", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items (ids as strings, sorted), spans (word
    ranges covered by a window, end exclusive; overlapping and touching ones merged).

    A window is ``size`` consecutive words of an item; a shorter item with words is one window. NULL
    texts have no words; items without id or words match nothing; rows of one item id are one item.
    Items are cut by a hash of their id into blocks of about ``block_chars`` characters, one automaton
    each, so neither the driver nor a task holds more than a block at a time.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("words")).dropna().distinct()
    n_blocks = int(-(-(items.agg(F.sum(F.length("words"))).first()[0] or 1) // block_chars))
    for b in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b) if n_blocks > 1 else items
        sent = spark.sparkContext.broadcast(Automaton(sorted((r.id, item_words(r.words)) for r in mine.toLocalIterator()), size))
        first = F.arrow_udf(lambda texts, sent=sent: scan(sent.value, texts), RESULT_TYPE)
        later = F.arrow_udf(lambda texts, had, sent=sent: scan(sent.value, texts, had), RESULT_TYPE)
        docs = docs.withColumn(out, later(F.col(text), F.col(out)) if b else first(F.col(text)))
    return docs


def remove_spans(texts: pa.Array, spans: pa.Array, drop_below: int) -> pa.Array:
    """Texts without the words of spans of at least ``drop_below`` words; what surrounds them stays."""
    raw, offsets = W.flat(texts)
    starts, ends, counts = W.spans(W.lower(raw), offsets, "alnum")
    first = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for d, found in enumerate(spans.to_pylist()):
        at, kept = int(offsets[d]), []
        for x in found or []:
            if x["end"] - x["start"] >= drop_below:
                kept.append(raw[at : starts[first[d] + x["start"]]].tobytes())
                at = int(ends[first[d] + x["end"] - 1])
        kept.append(raw[at : offsets[d + 1]].tobytes())
        out.append(b"".join(kept).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, min_span: int = 10, max_coverage: float = 0.5, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without test items: spans of at least ``min_span`` words are cut out of the text, and a
    document of which more than ``max_coverage`` of the words are hit is removed.

    Touching and overlapping windows are one span. NULL and blank texts hold no words and stay as they are; repeated rows and
    rows without an id are judged each; without items with words nothing is cut. All columns are kept, whatever their names.
    """
    match = fresh(docs, "match")
    m = F.col(match)
    found = matches(docs, benchmark, size, text, item_id, item_text, match)
    kept = found.where(m["n_hit"] <= m["n_words"] * F.lit(max_coverage))
    cut = F.arrow_udf(lambda texts, spans: remove_spans(texts, spans, min_span), "string")
    clean = F.when(m["n_hit"] > 0, cut(F.col(text), m["spans"])).otherwise(F.col(text))
    return kept.withColumn(text, clean).drop(match)

