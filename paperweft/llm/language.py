"""Language identification by multilingual mixture inference.

A document is a mixture of languages: every word is drawn from one of them, with the likelihood of its
letter trigrams in that language. Expectation-maximisation estimates the proportions; the set of
languages is grown while the penalised likelihood rises; the largest proportion names the document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W

BUCKETS = 1 << 16
#: Labelled documents of a language that training reads at most, in expectation.
PER_LANGUAGE = 20_000
SMOOTHING = 0.5
ROUNDS = 8
#: Log-likelihood that one more language must gain, per log of the number of words.
PENALTY = 4.0
UNKNOWN = "und"
RESULT = "struct<lang_pred: string, score: double, proportions: map<string,double>>"
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower-case form) by code point; a form of several characters is left as it is."""
    if not _tables:
        n = sys.maxunicode + 1
        _tables.append(np.fromiter((chr(i).isalpha() for i in range(n)), bool, n))
        small = (chr(i).lower() for i in range(n))
        _tables.append(np.fromiter((ord(s) if len(s) == 1 else i for i, s in enumerate(small)), np.uint32, n))
    return _tables[0], _tables[1]


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of every letter, first letter of every word, words per document).

    A word is a maximal run of letters; a letter's trigram is it and its neighbours in the word.
    """
    letter, small = _letters()
    try:
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    except UnicodeError:  # broken UTF-8: decode each document by itself
        parts = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
        codes = np.concatenate([np.zeros(0, np.uint32), *parts])
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    mask = letter[codes]
    codes = np.where(mask, small[codes], 0).astype(np.uint64)
    n = len(codes)
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:], after[:-1] = codes[:-1], codes[1:]
    inner = at[1:-1]
    before[inner[inner < n]] = 0
    after[inner[inner > 0] - 1] = 0
    own = np.flatnonzero(mask)
    u = np.uint64
    h = before[own] * u(0x9E3779B97F4A7C15) + codes[own] * u(0xD6E8FEB86659FD93) + after[own] * u(0xA0761D6478BD642F)
    h ^= h >> u(31)
    h *= u(0xBF58476D1CE4E5B9)
    starts = np.flatnonzero(before[own] == 0)
    place = own[starts]
    return (h >> u(48)).astype(np.int64), starts, np.diff(np.searchsorted(place, at, "left"))


class Model:
    """Trigram log-probabilities by language. Size: ``BUCKETS`` x languages x 4 bytes."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(0, keepdims=True)
        self.log_p = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32)

    def predict(self, texts: pa.Array) -> pa.Array:
        raw, offsets = W.flat(texts)
        n = len(offsets) - 1
        best, score, sets = np.full(n, -1), np.zeros(n), [[] for _ in range(n)]
        for lo, hi in W.blocks(offsets, max(1 << 16, W.BLOCK * 4 // max(4, len(self.languages)))):
            g, starts, counts = grams(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            some = np.flatnonzero(counts)
            if not len(some) or not self.languages:
                continue
            theta = self._mixtures(np.add.reduceat(self.log_p[g], starts, axis=0), counts[some])
            best[lo + some], score[lo + some] = theta.argmax(1), theta.max(1)
            for d, row in zip((lo + some).tolist(), theta.tolist()):
                sets[d] = [(self.languages[i], p) for i, p in enumerate(row) if p > 0]
        names = [self.languages[i] if i >= 0 else UNKNOWN for i in best.tolist()]
        kind = pa.map_(pa.string(), pa.float64())
        W.give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64()), pa.array(sets, kind)], ["lang_pred", "score", "proportions"])

    def _mixtures(self, log_words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Proportions (documents x languages) over each document's selected languages."""
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        peak = log_words.max(1, keepdims=True)
        like = np.exp(log_words - peak)
        docs, langs = len(counts), like.shape[1]
        full, _ = self._em(like, first, counts, np.full((docs, langs), 1.0 / langs, np.float32), ROUNDS)
        order = np.argsort(-full, axis=1, kind="stable")
        chosen = np.zeros((docs, langs), np.float32)
        chosen[np.arange(docs), order[:, 0]] = 1
        _, had = self._em(like, first, counts, chosen, 0)
        live = np.arange(docs)  # documents whose set still grows
        for k in range(1, langs):
            live = live[full[live, order[live, k]] > 1e-4]
            if not len(live):
                break
            use = np.repeat(np.isin(np.arange(docs), live), counts)
            own_counts = counts[live]
            own_first = np.concatenate([[0], np.cumsum(own_counts)[:-1]])
            allowed = np.zeros((len(live), langs), np.float32)
            np.put_along_axis(allowed, order[live, : k + 1], 1, axis=1)
            begin = np.maximum(full[live], 1e-4) * allowed
            theta, now = self._em(like[use], own_first, own_counts, begin / begin.sum(1, keepdims=True), ROUNDS)
            better = now - had[live] > PENALTY * np.log(own_counts + 1.0)
            live = live[better]
            chosen[live], had[live] = theta[better], now[better]
        return chosen.astype(np.float64)

    @staticmethod
    def _em(like: np.ndarray, first: np.ndarray, counts: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log-likelihood) after ``rounds`` of expectation and maximisation."""
        for _ in range(rounds):
            share = like * np.repeat(theta, counts, axis=0)
            share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
            theta = np.add.reduceat(share, first, axis=0) / counts[:, None].astype(np.float32)
        weight = np.maximum((like * np.repeat(theta, counts, axis=0)).sum(1, dtype=np.float64), 1e-30)
        return theta, np.add.reduceat(np.log(weight), first)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on labelled documents that are not held out.

    At most about ``per_language`` documents of a language are read, chosen by a hash of doc_id
    (documented bound). Trigram counts are summed by language and bucket; the model that reaches the
    driver has ``BUCKETS`` numbers a language, whatever the input's size.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n_rows = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n_rows:
        return Model([], np.zeros((BUCKETS, 0)))
    languages = sorted(n_rows)
    scale = 1 << 30
    limits = F.create_map(*[F.lit(x) for name in languages for x in (name, min(scale, scale * per_language // n_rows[name] + 1))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < limits[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offsets = W.flat(batch.column(0))
            names = batch.column(1).to_pylist()
            for lo, hi in W.blocks(offsets):
                g, starts, counts = grams(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                index = {name: i for i, name in enumerate(dict.fromkeys(names[lo:hi]))}
                of_word = np.repeat([index[x] for x in names[lo:hi]], counts)
                of_gram = np.repeat(of_word, np.diff(np.concatenate([starts, [len(g)]])))
                for name, i in index.items():
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(g[of_gram == i], minlength=BUCKETS)
        W.give_back()
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], ["lang", "bucket", "n"])

    table = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    model = np.zeros((BUCKETS, len(languages)))
    index = {name: i for i, name in enumerate(languages)}
    model[table.column("bucket").to_numpy(), [index[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    return Model(languages, model)


def predictor(docs: DataFrame, model: Model):
    """A function Column -> Column (lang_pred, score, proportions) with the model sent to the executors.

    NULL text or text without a letter gives ``und`` with score 0, as does a model that learned nothing.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return F.arrow_udf(lambda texts: sent.value.predict(texts), RESULT)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, proportions for every row; learns from the rows' own labels.

    Repeated rows get equal predictions; a NULL doc_id counts as the empty text for holding out.
    """
    predict = predictor(docs, train(docs, per_language, doc_id, text, lang))
    return docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), predict(F.col(text)).alias("_p")).select("doc_id", "held_out", "_p.*")
