"""N-gram Jaccard join with PartEnum signatures.

Sets are put into bands of similar size. Sets that are similar enough to a set of band i differ from it
in at most k_i elements. The feature domain is cut (by hash) into first-level partitions, each into
second-level ones; so many that in one of the first-level partitions the difference is at most k2, and
all but k2 of its second-level partitions agree. A signature is the content of one such subset; similar
sets share one. There are a few more partitions than needed, so that the content is rarely empty: a set with more
than k_i filled cells needs no signature of an empty one, which unrelated sets would share. Each differing
element spoils one cell, so a set shares at least (filled cells - largest difference) signatures with a similar
one; a set that shares fewer with all others together is left out. Signatures only propose pairs; every link is
verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import words as W
from .components import components
from .store import drop, stored

_U = np.uint64
SECOND_LEVEL = 2
_NEED = (1 << 32) - 1


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per document): each document's distinct ``size``-word shingles, sorted.

    Words are between ASCII white space, A-Z lower-cased; fewer words than ``size`` are one shingle.
    """
    raw = W.lower(raw)
    starts, ends, counts = W.spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, _U), counts
    words = W.word_hashes(raw, starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = W.gram_hashes(words, size)
    inside = np.flatnonzero(np.arange(len(grams)) + size <= first[doc[: len(grams)] + 1])
    short = np.flatnonzero((counts > 0) & (counts < size))
    hashes = np.concatenate([grams[inside], W.range_hashes(words, first[short], first[short + 1])])
    doc = np.concatenate([doc[inside], short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(counts))


def bands(largest: int, percent: int) -> np.ndarray:
    """Largest size of each band; the last is at least ``largest``. A band spans a ratio of 1/similarity squared."""
    tops, low = [], 1
    while not tops or tops[-1] < largest:
        tops.append(max(low, low * 10_000 // percent**2))
        low = tops[-1] + 1
    return np.array(tops, np.int64)


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set; 0 for an empty one."""
    edge = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(W.mix(hashes ^ _U(salt)), dtype=_U)])
        out.append(W.mix(total[edge[1:]] - total[edge[:-1]]))
    return out[0], out[1]


def signatures(hashes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of the set, lane) of many sets; an empty set has none.

    A lane is a set's band (high half) and the number of that band's signatures it shares with a similar set at
    least (low half, ``_NEED``).
    """
    if not len(hashes):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    tops = bands(int(counts.max()), percent)
    edge = np.concatenate([[0], np.cumsum(counts)])
    own = np.searchsorted(tops, counts)
    sigs, sets, lanes = [], [], []
    back = 0
    while True:  # own band, then those below whose sets may be similar to this larger one
        band = own - back
        use = np.flatnonzero((counts > 0) & (band >= 0) & (counts <= 100 * tops[np.maximum(band, 0)] // percent))
        if back and not len(use):
            break
        n, top = counts[use], tops[band[use]]
        k = (100 - percent) * top // percent
        parts = np.where(k > 0, (23 * (k + 1) + 39) // 40, 1)  # a few more than the (k + 1) / 2 that k2 = 1 needs; k2 is 0 if k is
        base = np.concatenate([[0], np.cumsum(parts)]) * SECOND_LEVEL
        at = np.arange(n.sum()) + np.repeat(edge[use] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        h = hashes[at]
        cells = np.repeat(parts * SECOND_LEVEL, n).astype(_U)
        cell = np.repeat(base[:-1], n) + (W.mix(h ^ _U(0x2545F4914F6CDD1D)) % cells).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        total = np.concatenate([np.zeros(1, _U), np.cumsum(W.mix(h)[order], dtype=_U)])
        cut = np.searchsorted(cell[order], np.arange(base[-1] + 1))
        content = (total[cut[1:]] - total[cut[:-1]]).reshape(-1, SECOND_LEVEL)
        filled = (cut[1:] > cut[:-1]).reshape(-1, SECOND_LEVEL)
        owner = np.repeat(np.arange(len(use)), parts)
        # with over k filled cells a set agrees with a similar one in a filled cell; only others need the empty ones
        full = np.add.reduceat(filled.sum(1), base[:-1] // SECOND_LEVEL)
        sparse = full <= k
        # the partner is at most n * 100 / percent large, in a band below at most top
        apart = (100 - percent) * (n + top) // (100 + percent) if back else (100 - percent) * n // percent
        lane = (band[use] << 32) + np.where(k > 0, np.maximum(1, full - np.minimum(k, apart)), 1)
        tag = (np.arange(len(owner)) - base[owner] // SECOND_LEVEL).astype(_U) * _U(64) + band[use][owner].astype(_U) * _U(1 << 40)
        for k2 in (0, 1):
            rows = np.flatnonzero((k[owner] > 0) == bool(k2))
            for j, subset in enumerate(combinations(range(SECOND_LEVEL), SECOND_LEVEL - k2)):
                sent = rows[filled[rows][:, subset].any(1) | sparse[owner[rows]]]
                value = np.zeros(len(sent), _U)
                for c in subset:
                    value = value + W.mix(content[sent, c] ^ _U(c + 1))
                sigs.append(W.mix(value ^ W.mix(tag[sent] + _U(j + 1))))
                sets.append(use[owner[sent]])
                lanes.append(lane[owner[sent]])
        back += 1
    return np.concatenate(sigs), np.concatenate(sets), np.concatenate(lanes)


def _each(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = W.flat(texts)
    for lo, hi in W.blocks(offsets):
        yield lo, hi, *shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _several(nodes: DataFrame) -> DataFrame:
    """(sig, key, lane), each once, of signatures that more than one set has; no group is gathered."""
    by_sig = Window.partitionBy("sig").orderBy("key")
    once = nodes.withColumn("before", F.lag("key").over(by_sig)).where("before is null or before != key")
    ends = once.withColumns({"first": F.lag("key").over(by_sig), "next": F.lead("key").over(by_sig)})
    return ends.where("first is not null or next is not null").select("sig", "key", "lane")


def _compare(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, ...) with both sets (sa, sb), their sizes and whether they link; other sets aren't shuffled."""
    pairs = stored(pairs)
    keys = stored(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    profiles = profiles.join(keys, "key", "left_semi")
    left = profiles.select(F.col("key").alias("a"), F.col("set").alias("sa"))
    right = profiles.select(F.col("key").alias("b"), F.col("set").alias("sb"))
    rows = pairs.join(left, "a").join(right, "b").withColumns({"na": F.size("sa"), "nb": F.size("sb"), "both": F.size(F.array_intersect("sa", "sb"))})
    return rows.withColumn("linked", F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent)


def _placed(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the components that a and b are in so far; a class without links is its own."""
    def of(column: str) -> DataFrame:
        return part.select(F.col("id").alias(column), F.col("component").alias(f"{column}_part"))

    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        "a", "b", F.coalesce("a_part", "a").alias("part"), F.coalesce("b_part", "b").alias("pivot_part"))


def _cross(placed: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a pivot's classes in different components that may still link.

    With D(x) the symmetric difference of x and the pivot, x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)|
    elements. A linked pair differs in at most c (|x| + |y|) of them, c = (100 - percent) / (100 + percent),
    so D(x) and D(y) share at least s elements. Of a pair in different components one, say y, isn't linked to the
    pivot, so |D(y)| > c (|y| + |pivot|). For x not linked, s >= |D(x)| - (100 - percent) |x| / percent
    (triangle inequality); for x linked, s >= (|D(x)| + 1 - c (|x| - |pivot|)) / 2; s is never below 1.
    Two sets that share s elements share one among the |D| - s + 1 rarest of each (prefix filter), and
    in copies with edits of their own the rarest elements are their own. A row's prefix takes the least s of any
    partner. Where two rows meet, their own s holds: the rarest element that x and y share is among the
    |D| - s + 1 rarest of each by it, so other meetings propose nothing.
    """
    open_pivots = placed.where("part != pivot_part").select("b").distinct()
    sets = _compare(placed.drop("pivot_part").join(open_pivots, "b", "left_semi"), profiles, percent)
    size = F.size("delta")
    wider = F.greatest(F.lit(0), F.ceil((100 - percent) * (F.col("na") - F.col("nb")) / (100 + percent)))
    shared = F.when(F.col("linked"), F.ceil((size + 1 - wider) / 2)).otherwise(size - F.floor((100 - percent) * F.col("na") / percent))
    rows = stored(
        sets.withColumn("delta", F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")))
        .select("a", "b", "part", "na", size.alias("total"), (size - F.greatest(F.lit(1), shared) + 1).alias("prefix"), F.explode("delta").alias("element")))
    common = stored(rows.groupBy("b", "element").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
                    .where("low < high").select("b", "element", "n"))
    held = rows.join(common, ["b", "element"])  # no other component has a set's other elements; they come before these
    own = F.col("total") - F.count("*").over(Window.partitionBy("b", "a"))
    place = own + F.row_number().over(Window.partitionBy("b", "a").orderBy("n", "element"))
    prefix = stored(held.withColumn("place", place).where("place <= prefix"))
    x, y = prefix.alias("x"), prefix.alias("y")
    fits = F.least("x.na", "y.na") * 100 >= F.greatest("x.na", "y.na") * percent
    left = 1 + F.least(F.col("x.total") - F.col("x.place"), F.col("y.total") - F.col("y.place"))  # at most so many are shared from here on
    meets = 2 * (100 + percent) * left >= (100 + percent) * (F.col("x.total") + F.col("y.total")) - (100 - percent) * (F.col("x.na") + F.col("y.na"))
    return x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.part") < F.col("y.part")) & fits & meets).select(
        F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their distinct ``size``-word
    shingles. component_id is the smallest doc_id reachable by links. NULL, empty and blank texts have
    no shingles and link with nothing: their component is their own doc_id. Equal sets, repeated rows
    among them, are one node. Rows with a NULL doc_id take part only through equal sets.

    Steps: equal sets become one class; every class sends its signatures; each signature's most
    connected class is its pivot, and a class is compared with its pivots (a star, so a large group costs
    a row a member): with the one it shares most signatures with, then with those that are still in other
    components. Classes of a pivot that are still in different components are compared when their
    differences to the pivot share a rare element (see ``_cross``). No pair that could join two
    components is left out.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def keys(batches):
        for batch in batches:
            parts = [(counts, *set_keys(h, counts)) for _, _, h, counts in _each(batch.column(1), size)]
            if parts:
                n, one, two = (np.concatenate(x) for x in zip(*parts))
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), _signed(one), _signed(two)], ["doc_id", "n", "key", "key2"])
            W.give_back()

    def sign(batches):
        sent: set[int] = set()  # a class signs once a task
        for batch in batches:
            for _, _, h, counts in _each(batch.column(1), size):
                key, _ = set_keys(h, counts)
                new = np.zeros(len(counts), bool)
                for i, x in enumerate(key.tolist()):
                    if counts[i] and x not in sent:
                        sent.add(x)
                        new[i] = True
                sig, of, lane = signatures(h[np.repeat(new, counts)], counts[new], percent)
                yield pa.record_batch([_signed(sig), _signed(key[new][of]), pa.array(lane)], ["sig", "key", "lane"])
            W.give_back()

    def profile(batches):
        for batch in batches:
            for lo, hi, h, counts in _each(batch.column(1), size):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), _signed(h))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), lists], ["key", "set"])
            W.give_back()

    sets = stored(src.mapInArrow(keys, "doc_id long, n long, key long, key2 long"))
    classes = stored(sets.where("n > 0").groupBy("key", "key2", "n").agg(F.min("doc_id").alias("rep")))
    met = stored(_several(src.mapInArrow(sign, "sig long, key long, lane long")))
    enough = F.count("*").over(Window.partitionBy("key", "lane")) >= F.col("lane").bitwiseAND(_NEED)
    nodes = stored(_several(met.withColumn("enough", enough).where("enough")).select("sig", "key"))
    drop(met)
    degree = nodes.groupBy("key").agg(F.count("*").alias("degree"))
    rank = F.col("degree") * F.lit(1 << 40) + F.pmod(F.xxhash64("key"), F.lit(1 << 40))  # the same order for every signature
    pivots = nodes.join(degree, "key").groupBy("sig").agg(F.max_by("key", rank).alias("lead"))
    star = stored(nodes.join(pivots, "sig").where("key != lead").groupBy("key", "lead").agg(F.count("*").alias("n")))
    drop(nodes)
    involved = star.select("key").union(star.select("lead")).distinct().join(classes.where("rep is not null"), "key").select("key", F.col("rep").alias("doc_id"))
    profiles = stored(src.join(involved, "doc_id").select("key", "text").mapInArrow(profile, "key long, set array<long>"))

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(_compare(pairs, profiles, percent).where("linked").select("a", "b"))

    pairs = star.select(F.col("key").alias("a"), F.col("lead").alias("b"))
    nearest = star.groupBy("key").agg(F.max_by("lead", F.col("n") * F.lit(1 << 40) + F.pmod(F.xxhash64("lead"), F.lit(1 << 40))).alias("lead"))
    links = linked(nearest.select(F.col("key").alias("a"), F.col("lead").alias("b")))
    near = stored(components(links))
    links = links.union(linked(_placed(pairs, near).where("part != pivot_part").select("a", "b")))
    wide = stored(components(links))
    links = links.union(linked(_cross(_placed(pairs, wide), profiles, percent)))
    drop(star, profiles, near, wide)  # the links are stored; nothing below reads these
    reps = classes.where("rep is not null").groupBy("key").agg(F.min("rep").alias("rep"))
    by_rep = links.join(reps.select(F.col("key").alias("a"), F.col("rep").alias("ra")), "a").join(
        reps.select(F.col("key").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    part = components(by_rep)
    named = classes.join(part, classes.rep == part.id, "left").select("key", "key2", "n", F.coalesce("component", "rep").alias("component_id"))
    return sets.join(named, ["key", "key2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
