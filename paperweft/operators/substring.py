"""Substring join: which needles occur in which texts, without comparing every pair.

A needle that occurs in a text with single spaces must line up with the text's words:

* three words or more: every inner word is a whole word of the text;
* two words: the first ends a word of the text, the second starts one;
* one word: it lies inside one word of the text.

So needles are compared with the *vocabulary* (distinct words) and only then, by equality on the
word, with the texts. Needles of three or more words are anchored on their rarest inner word, and
are dropped when one of those words never occurs. One-word hits are exact; the others are verified
on the text itself. The work follows the number of (text, word) pairs and of true hits.

Needles without scopes that are few enough for a broadcast, however many texts there are, meet the texts where these
are: each word of a text looks its grams up among the needles' grams. Texts are read once, and nothing is dealt or written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .cut import written

_GRAM = 4
BROADCAST_ROWS = 500_000
BROADCAST_CHARS = 32_000_000


def fits_broadcast(lookup: DataFrame) -> bool:
    """Size check on materialized rows; beyond it the join is shuffled."""
    n, chars = lookup.agg(F.count("*"), F.coalesce(F.sum(F.length("_word") + F.coalesce(F.length("_needle"), F.lit(0))), F.lit(0))).first()
    return n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS


def _grams(word, sizes):
    """Distinct substrings of the given sizes."""

    def of_size(n):
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.when(F.length(word) >= n, F.substring(word, i, F.lit(n))))

    parts = [of_size(n) for n in sizes]
    return F.array_distinct(F.filter(F.concat(*parts), lambda g: g.isNotNull()))


def _probes(wanted: DataFrame) -> DataFrame:
    """(_mode, _word, _id, _needle, _gram): the word by which a needle is looked up in a text's words, and the gram of it that leads there.

    Of three words or more it is the inner word that fewest needles have, and of these the longest; it must be a whole word. _needle
    is NULL where the word decides.
    """
    inner = wanted.where(F.size("_w") >= 3).select("_id", "_needle", F.explode(F.array_distinct(F.slice("_w", F.lit(2), F.size("_w") - 2))).alias("_word"))
    spread = inner.groupBy("_word").agg(F.count("*").alias("_n"))
    rarest = inner.join(spread, "_word").groupBy("_id", "_needle").agg(F.min_by("_word", F.struct("_n", -F.length("_word"), "_word")).alias("_word"))
    first, last = F.get("_w", F.lit(0)), F.get("_w", F.size("_w") - 1)
    longer = F.length(first) >= F.length(last)
    mode = F.when(F.size("_w") == 1, "in").when(longer, "end").otherwise("start")
    short = wanted.where(F.size("_w") <= 2).select(
        mode.alias("_mode"), F.when((F.size("_w") == 1) | longer, first).otherwise(last).alias("_word"), "_id", F.when(F.size("_w") > 1, F.col("_needle")).alias("_needle"))
    every = rarest.select(F.lit("whole").alias("_mode"), "_word", "_id", "_needle").unionByName(short)
    size = F.least(F.length("_word"), F.lit(_GRAM))
    return every.withColumn("_gram", F.when(F.col("_mode") == "whole", F.col("_word")).when(F.col("_mode") == "end", F.right("_word", size)).otherwise(F.left("_word", size)))


def _met_in_place(texts: DataFrame, ident: list[str], probes: DataFrame) -> DataFrame:
    """Hits of a text's words among broadcast probes; a text travels along inside the generated code."""
    size = F.when(F.col("_mode") != "whole", F.length("_gram"))
    kinds = probes.select("_mode", size.alias("_size")).distinct().collect()
    word, key = F.col("_at"), lambda mode, gram: F.concat(F.lit(f"{mode} "), gram)

    def keys(mode: str, n: int | None):
        if mode == "in":
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: key(mode, F.substring(word, i, F.lit(n))))
        return F.array(key(mode, word if mode == "whole" else F.left(word, F.lit(n)) if mode == "start" else F.right(word, F.lit(n))))

    every = [keys(k["_mode"], k["_size"]) for k in kinds] or [F.array().cast("array<string>")]
    words = texts.select(*ident, "_text", F.explode(F.array_distinct(F.split("_text", " "))).alias("_at")).where("_at <> ''")
    asked = words.select(*ident, "_text", "_at", F.explode(F.array_distinct(F.concat(*every))).alias("_key"))
    given = probes.select(F.concat("_mode", F.lit(" "), "_gram").alias("_key"), "_mode", "_word", "_id", "_needle")
    fits = (
        F.when(F.col("_mode") == "in", F.contains("_at", F.col("_word")))
        .when(F.col("_mode") == "start", F.startswith("_at", F.col("_word")))
        .when(F.col("_mode") == "end", F.endswith("_at", F.col("_word"))).otherwise(True))
    holds = F.col("_needle").isNull() | F.contains("_text", F.col("_needle"))
    return asked.join(F.broadcast(given), "_key").where(fits & holds).select(*ident, "_id")


def substring_hits(texts: DataFrame, key: list[str], needles: DataFrame, scope: list[str] | None = None,
                   text: str = "text", needle: str = "needle") -> DataFrame:
    """Distinct ``(key, scope, needle)`` with ``needle`` contained in ``text``.

    ``texts`` hold white-space-normalized text; ``key`` (+ ``scope``) identifies a row. With
    ``scope`` only needles of the same scope are looked for.
    """
    found, numbered = numbered_hits(texts, key, needles, scope, text, needle)
    return found.distinct().join(numbered.select("_id", needle), "_id").drop("_id")


def numbered_hits(texts: DataFrame, key: list[str], needles: DataFrame, scope: list[str] | None = None,
                  text: str = "text", needle: str = "needle") -> tuple[DataFrame, DataFrame]:
    """(hits, needles): ``(key, scope, _id)`` of every hit, some more than once, and ``(scope, _id, needle)``.

    For callers that aggregate hits anyway: they carry a number and need no distinct.
    """
    scope = scope or []
    ident = [c for c in key if c not in scope] + scope
    texts = texts.select(*ident, F.col(text).alias("_text"))
    wanted = needles.select(*scope, F.col(needle).alias("_needle")).where("_needle <> ''").distinct()
    pieces = F.filter(F.split("_needle", " "), lambda w: w != "")
    # numbered once (writing fixes the numbers), so that the many raw hits carry a number, not a text
    wanted = written(wanted.withColumn("_w", pieces).where(F.size("_w") > 0).withColumn("_id", F.monotonically_increasing_id()))
    if not scope:
        probes = written(_probes(wanted))
        if fits_broadcast(probes):
            return _met_in_place(texts, ident, probes), wanted.select("_id", F.col("_needle").alias(needle))
        texts = written(texts)  # read several times below

    words = texts.select(*ident, F.explode(F.array_distinct(F.split("_text", " "))).alias("_word")).where("_word <> ''")
    vocabulary = written(words.groupBy(*scope, "_word").agg(F.count("*").alias("_df")))

    # three words or more: rarest inner word, provided that all inner words occur
    inner = wanted.where(F.size("_w") >= 3).select(
        *scope, "_id", F.explode(F.array_distinct(F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0))))).alias("_word"))
    inner = inner.join(vocabulary, scope + ["_word"], "left").groupBy(*scope, "_id").agg(
        F.min_by("_word", F.coalesce("_df", F.lit(0))).alias("_word"), F.min(F.coalesce("_df", F.lit(0))).alias("_low"))
    # the many words of needles travel with their number; the text joins once the word is chosen
    inner = inner.where("_low > 0").join(wanted.select("_id", "_needle"), "_id").select(*scope, "_word", "_id", "_needle")

    # one or two words: look the longer word up in the vocabulary
    first, last = F.get("_w", F.lit(0)), F.get("_w", F.size("_w") - 1)
    mode = F.when(F.size("_w") == 1, "in").when(F.length(first) >= F.length(last), "end").otherwise("start")
    short = wanted.where(F.size("_w") <= 2).withColumn("_mode", mode).withColumn(
        "_piece", F.when(F.col("_mode") == "start", last).otherwise(first))
    size = F.least(F.length("_piece"), F.lit(_GRAM))
    short = short.withColumn("_gram", F.when(F.col("_mode") == "end", F.right("_piece", size)).otherwise(F.left("_piece", size)))
    sizes = range(1, _GRAM + 1)
    ends = lambda cut_: F.array_distinct(F.array(*[cut_("_word", F.lit(n)) for n in sizes]))
    by_mode = {"in": _grams(F.col("_word"), sizes), "start": ends(F.left), "end": ends(F.right)}

    def grams_of(mode: str) -> DataFrame:
        """Grams of the words that a needle of this mode may meet: those of its own scope, if there are scopes."""
        near = vocabulary.join(short.where(F.col("_mode") == mode).select(*scope).distinct(), scope, "left_semi") if scope else vocabulary
        return near.select(*scope, "_word", F.lit(mode).alias("_mode"), F.explode(by_mode[mode]).alias("_gram"))

    grams = grams_of("in").unionByName(grams_of("start")).unionByName(grams_of("end"))
    fits = (
        F.when(F.col("_mode") == "in", F.contains("_word", F.col("_piece")))
        .when(F.col("_mode") == "start", F.startswith("_word", F.col("_piece")))
        .otherwise(F.endswith("_word", F.col("_piece")))
    )
    short = grams.join(short, scope + ["_mode", "_gram"]).where(fits).select(
        *scope, "_word", "_id", F.when(F.col("_mode") != "in", F.col("_needle")).alias("_needle"))

    # _needle is NULL where the word decides (one-word needles)
    lookup = written(inner.unionByName(short))
    holds = F.col("_needle").isNull() | F.contains("_text", F.col("_needle"))
    if fits_broadcast(lookup):
        # the text rides along inside the generated code: nothing but hits is shuffled
        with_text = texts.select(*ident, "_text", F.explode(F.array_distinct(F.split("_text", " "))).alias("_word"))
        found = with_text.join(F.broadcast(lookup), scope + ["_word"]).where(holds).select(*ident, "_id")
    else:
        pairs = words.join(lookup, scope + ["_word"]).select(*ident, "_id", "_needle")
        sure = pairs.where("_needle is null").select(*ident, "_id")
        doubtful = pairs.where("_needle is not null").distinct().join(texts, ident).where(holds).select(*ident, "_id")
        found = sure.unionByName(doubtful)
    return found, wanted.select(*scope, "_id", F.col("_needle").alias(needle))
