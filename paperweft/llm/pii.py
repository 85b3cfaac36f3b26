"""Personal data: candidate spans scored by gradient-boosted trees.

Generators with high recall propose spans from patterns. Format rules decide the plain forms (base spans,
which always stay) and give labels; boosted trees learn from format and context features; a threshold
calibrated on held-out candidates selects among the other forms. Only DataFrame functions and Spark's own
tree learner are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

KINDS = ["email", "ip", "card", "phone"]
#: A match begins at the start of a run of its leading characters or where the last match ended: one that begins
#: further right could begin there as well. So a long run is read once, not once from each of its characters.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
#: Plain forms by kind, and a condition that every text with a valid match meets. Groups that end a form are
#: possessive: nothing follows them, so matches are the same, and Java does not recurse once a repetition.
PLAIN = {
    "email": (_LOCAL + r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Other forms: written-out addresses, cards in groups with other separators, phones without a plus.
OTHER = {
    "email": (_LOCAL + r" ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]+)++", r"[\[(] ?at ?[\])]"),
    "card": (r"[0-9]{4}([._/][0-9]{4}){3}", r"[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}"),
    "phone": (r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{3}[\x20.-][0-9]{4}"),
}
WORDS_BEFORE = {"email": "mail|contact|write|@", "ip": "ip|host|server|address|client", "card": "card|visa|pay|credit|account", "phone": "phone|tel|call|fax|mobile|dial"}
SPAN = "array<struct<start:int,end:int,value:string,ok:boolean,before:string,after:string>>"
CONTEXT = 24
#: Matches of a text that are folded at a time.
PIECE = 256
FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "length", "digits", "groups", "letters", "distinct_digits", "largest_part", "luhn", "word_before", "open_before", "open_after"]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check; false for 0 or over 19 digits."""
    d = digits_of(value)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.when((n > 0) & (n <= 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def largest_part(value: Column) -> Column:
    parts = F.transform(F.filter(F.split(value, "[^0-9]+"), lambda x: x != ""), lambda x: F.when(F.length(x) > 9, F.lit(999_999_999)).otherwise(x.cast("int")))
    return F.coalesce(F.array_max(parts), F.lit(0))


def in_form(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(value)).otherwise(F.lit(False))
    return n.between(9, 15)


def matches(text: Column, pattern: str, guard: str, keep: Callable[[Column], Column], ok: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches as (start, end, value, ok, before, after) in code points, end exclusive.

    The text between matches and the matches themselves are folded into running positions; ``keep``
    drops matches, ``ok`` marks them. ``before`` is the ``CONTEXT`` characters in front, ``after`` the next one.
    """
    none = F.array().cast(SPAN)
    end_of = lambda c: F.right(c, F.lit(CONTEXT))
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, v: F.struct(
        F.length(gap).alias("gap"), end_of(gap).alias("tail"), F.left(gap, F.lit(1)).alias("head"), v.alias("v")))

    def with_next(every: Column) -> Column:
        return F.zip_with(every, F.slice(every, 2, F.size(every)), lambda x, y: F.struct(
            x["gap"].alias("gap"), x["tail"].alias("tail"), x["v"].alias("v"),
            F.left(F.concat(F.coalesce(y["head"], F.lit("")), F.coalesce(y["v"], F.lit(""))), F.lit(1)).alias("after")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["v"]), F.lit(0))
        before = end_of(F.concat(acc["tail"], x["tail"]))
        span = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"), ok(x["v"]).alias("ok"), before.alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), end_of(F.concat(before, F.coalesce(x["v"], F.lit("")))).alias("tail"),
                        F.when(x["v"].isNotNull() & keep(x["v"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def piece(acc: Column, part: Column) -> Column:  # every step copies what it has found, so that stays short
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), none.alias("out")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), x["tail"].alias("tail"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

    def fold(every: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / PIECE).cast("int")), lambda i: F.slice(every, i * PIECE + 1, F.lit(PIECE)))
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(parts, begin, piece, lambda acc: F.flatten(acc["out"]))

    found = F.transform(F.transform(F.array(pairs), with_next), fold)[0]
    return F.when(text.rlike(guard), found).otherwise(none)


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, base, cands): plain matches by kind number, and all proposals with their context."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    any_digits = lambda v: F.length(digits_of(v)).between(12, 19)
    columns = {f"plain_{k}": matches(F.col("text"), *PLAIN[k], any_digits if k == "card" else lambda v: F.lit(True), lambda v, k=k: in_form(k, v)) for k in KINDS}
    columns |= {f"other_{k}": matches(F.col("text"), *OTHER[k], lambda v: F.lit(True), lambda v: F.lit(None).cast("boolean")) for k in OTHER}
    rows = src.withColumns(columns)

    def with_context(name: str, kind: str) -> Column:
        return F.transform(F.col(name), lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), *[x[c].alias(c) for c in ("start", "end", "value", "ok", "before", "after")]))

    return rows.select("row", "doc_id", F.concat(*[with_context(f"plain_{k}", k) for k in KINDS], *[with_context(f"other_{k}", k) for k in OTHER]).alias("cands"))


def features(cands: DataFrame) -> DataFrame:
    """Numeric format and context features of candidates (kind, value, before, after)."""
    v, before = F.col("value"), F.lower("before")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    word = F.lit(False)
    for i, k in enumerate(KINDS):
        word = F.when(F.col("kind") == i, before.rlike(WORDS_BEFORE[k])).otherwise(word)
    d = digits_of(v)
    return cands.withColumns({
        **{f"is_{k}": number(F.col("kind") == i) for i, k in enumerate(KINDS)},
        "length": number(F.length(v)), "digits": number(F.length(d)), "groups": number(F.size(F.split(v, "[^0-9A-Za-z]+"))),
        "letters": number(F.length(F.regexp_replace(v, "[^A-Za-z]", ""))),
        "distinct_digits": number(F.size(F.array_distinct(F.filter(F.split(d, ""), lambda x: x != "")))),
        "largest_part": number(largest_part(v)), "luhn": number(luhn(v)), "word_before": number(word),
        "open_before": number(~before.rlike(r"[\p{L}\p{N}]$")), "open_after": number(~F.col("after").rlike(r"[\p{L}\p{N}]"))})


def fit(labelled: DataFrame, precision: float = 0.98):
    """(model, threshold) or None if the labelled candidates are of one class.

    Two thirds train 8 trees of depth 3; on the rest the threshold is the lowest score (in
    hundredths) from which on the share of valid candidates reaches ``precision``.
    """
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled.withColumn("label", F.col("ok").cast("double")))
    test = F.pmod(F.xxhash64("row", "start", "kind"), F.lit(3)) == 0
    if rows.where(~test).select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=8, maxDepth=3, seed=1).fit(rows.where(~test))
    bins = model.transform(rows.where(test)).groupBy(F.floor(vector_to_array("probability")[1] * 100).alias("bin")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    good = n = 0.0
    threshold = None
    for b in sorted(bins, key=lambda r: -r["bin"]):
        good, n = good + b["good"], n + b["n"]
        if good >= precision * n:
            threshold = b["bin"] / 100
    return None if threshold is None else (model, threshold)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = 0.98) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and all (arrays of start, kind number, end, sorted).

    NULL text counts as empty. Texts without candidates have empty arrays. An added span never
    overlaps a base span or a plain form that its rule refused. Repeated rows give repeated results.
    Every labelled candidate trains the trees or sets the threshold.
    """
    rows = stored(candidates(docs, doc_id, text))
    each = rows.select("row", F.explode("cands").alias("c")).select("row", "c.*")
    learned = fit(stored(features(each.where("ok is not null"))), precision)
    plain = F.filter("cands", lambda c: c["ok"].isNotNull())
    other = F.filter("cands", lambda c: c["ok"].isNull() & ~F.exists(plain, lambda p: (p["start"] < c["end"]) & (c["start"] < p["end"])))
    key = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = rows.select("row", "doc_id", F.array_sort(F.transform(F.filter("cands", lambda c: F.coalesce(c["ok"], F.lit(False))), key)).alias("base"))
    if learned is None:
        return base.select("doc_id", "base", F.col("base").alias("all"))
    model, threshold = learned
    open_ = features(rows.select("row", F.explode(other).alias("c")).select("row", "c.*"))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(open_))
    added = scored.where(vector_to_array("probability")[1] >= threshold).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    return base.join(added, "row", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("all"))


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by [kind]; of overlapping spans the first is replaced."""
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, put).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
