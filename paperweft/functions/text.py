"""Scalar text functions. Every function is Column -> Column and stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed as K

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java(pattern: str) -> str:
    """Only LF ends a line for ``.``, ``^`` and ``$``."""
    return "(?d)" + pattern


def strip(c: ColumnOrName) -> Column:
    return F.btrim(col(c), F.lit(K.WS_CHARS))


def unify_newlines(c: ColumnOrName) -> Column:
    return F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def squeeze(c: ColumnOrName) -> Column:
    """Collapse white space runs to one space and strip."""
    return strip(F.regexp_replace(col(c), K.WS + "+", " "))


def split_lines(c: ColumnOrName) -> Column:
    """Non-empty stripped lines in order."""
    lines = F.split(unify_newlines(F.coalesce(col(c), F.lit(""))), "\n")
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def word_count(c: ColumnOrName) -> Column:
    """White-space separated words of an already squeezed string."""
    return F.when(col(c) == "", 0).otherwise(F.size(F.split(col(c), " ")))


def clean_text(c: ColumnOrName) -> Column:
    unified = F.replace(unify_newlines(F.coalesce(col(c), F.lit(""))), F.lit("\xa0"), F.lit(" "))
    lines = F.transform(F.split(unified, "\n"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize(c: ColumnOrName) -> Column:
    return F.lower(squeeze(F.coalesce(col(c), F.lit(""))))


def slug(c: ColumnOrName, default: str = "field") -> Column:
    body = F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(body, F.lit("")), F.lit(default))


def normalize_label(c: ColumnOrName) -> Column:
    x = strip(F.coalesce(col(c), F.lit("")))
    x = F.regexp_replace(x, "^" + K.BULLET + K.WS + "+", "")
    x = F.regexp_replace(x, "^" + K.OUTLINE + K.WS + "+", "")
    return strip(F.rtrim(squeeze(x), F.lit(":")))


def is_list_marker(c: ColumnOrName) -> Column:
    return F.rlike(col(c), F.lit(K.LIST_MARKER))


def is_label(c: ColumnOrName) -> Column:
    label = normalize_label(c)
    return (label != "") & ~is_list_marker(label)


def is_table_label(c: ColumnOrName) -> Column:
    x = squeeze(F.coalesce(col(c), F.lit("")))
    return (
        (x != "")
        & ~is_list_marker(x)
        & ~F.lower(x).isin(K.STOPWORD_LABELS)
        & (F.length(x) <= K.TABLE_LABEL_MAX_CHARS)
        & (word_count(x) <= K.LABEL_MAX_WORDS)
    )


def _kind(line: Column) -> Column:
    """Which of the three line shapes comes first; cheap substring guards spare the regexes."""
    return (
        F.when((line == "") | (F.length(line) > K.LINE_MAX_CHARS), None)
        .when((F.contains(line, F.lit(":")) | F.contains(line, F.lit("-")))
              & F.rlike(line, F.lit(java(K.LABEL_VALUE))), "value")
        .when(F.contains(line, F.lit("___")) & F.rlike(line, F.lit(java(K.LABEL_BLANK))), "blank")
        .when(F.rlike(line, F.lit(java(K.LABEL_ONLY))), "label")
    )


def _group(line: Column, kind: Column, group: int) -> Column:
    return (
        F.when(kind == "value", F.regexp_extract(line, java(K.LABEL_VALUE), group))
        .when(kind == "blank", F.regexp_extract(line, java(K.LABEL_BLANK), group))
        .when(kind == "label", F.regexp_extract(line, java(K.LABEL_ONLY), group))
    )


def within(x: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once, for use inside expressions."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def candidate_field(c: ColumnOrName) -> Column:
    """Expression form of ``with_candidate`` (kind, label, value), for lines held in an array."""

    def labelled(line: Column, kind: Column, label: Column) -> Column:
        tail = F.when(kind == "value", F.regexp_extract(line, java(K.LABEL_VALUE), 5)).otherwise("")
        keep = (
            (label != "")
            & ~F.lower(label).isin(K.STOPWORD_LABELS)
            & (word_count(squeeze(label)) <= K.LABEL_MAX_WORDS)
            & is_label(label)
        )
        return F.when(keep, F.struct(kind.alias("kind"), label.alias("label"), strip(tail).alias("value")))

    def kinded(line: Column, kind: Column) -> Column:
        return F.when(kind.isNotNull(), within(strip(_group(line, kind, 3)), lambda label: labelled(line, kind, label)))

    return within(strip(F.coalesce(col(c), F.lit(""))), lambda line: within(_kind(line), lambda kind: kinded(line, kind)))


def has_line_shape(c: ColumnOrName) -> Column:
    """False only where ``candidate_field`` is NULL: a filter that needs no further columns."""
    return within(strip(F.coalesce(col(c), F.lit(""))), _kind).isNotNull()


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    Later filters on them then read the computed value; through a plain projection the optimizer
    would copy the whole expression into each filter and evaluate it again.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_candidate(df: DataFrame, c: str, out: str = "candidate") -> DataFrame:
    """Add ``out``: ``struct<kind,prefix,label,value,offset>``, NULL if the line is no candidate.

    ``offset`` is where the value starts in the raw line (where the label ends, if the shape has
    no value part). Each regex result is used several times, hence the steps.
    """
    raw, line, kind, label = F.coalesce(F.col(c), F.lit("")), F.col("_line"), F.col("_kind"), F.col("_label")
    steps = let(df, _line=strip(raw))
    steps = let(steps, _kind=_kind(line))
    steps = let(
        steps,
        _label=strip(_group(line, kind, 3)),
        _prefix=F.coalesce(_group(line, kind, 2), F.lit("")),
        _tail=F.when(kind == "value", F.regexp_extract(line, java(K.LABEL_VALUE), 5)).otherwise(""),
        _lead=F.length(_group(line, kind, 1)),
    )
    steps = let(steps, _plain=normalize_label(label), _words=word_count(squeeze(label)))
    keep = (
        kind.isNotNull()
        & (label != "")
        & ~F.lower(label).isin(K.STOPWORD_LABELS)
        & (F.col("_words") <= K.LABEL_MAX_WORDS)
        & (F.col("_plain") != "")
        & ~is_list_marker("_plain")
    )
    indent = F.length(raw) - F.length(F.ltrim(raw, F.lit(K.WS_CHARS)))
    start = F.when(kind == "value", F.length(line) - F.length("_tail")).otherwise(F.col("_lead"))
    found = F.struct(
        kind.alias("kind"),
        F.col("_prefix").alias("prefix"),
        label.alias("label"),
        strip("_tail").alias("value"),
        (indent + start).cast("int").alias("offset"),
    )
    steps = let(steps, **{out: F.when(keep, found)})
    return steps.drop("_line", "_kind", "_label", "_prefix", "_tail", "_lead", "_plain", "_words")


def numbered_heading(c: ColumnOrName) -> Column:
    x = strip(F.coalesce(col(c), F.lit("")))
    hit = (F.length(x) <= K.NUMBERED_HEADING_MAX_CHARS) & F.rlike(x, F.lit(java(K.NUMBERED_HEADING)))
    return F.when(
        hit,
        F.struct(
            F.regexp_extract(x, java(K.NUMBERED_HEADING), 1).alias("number"),
            F.regexp_extract(x, java(K.NUMBERED_HEADING), 2).alias("title"),
        ),
    )


def is_numbered_heading(c: ColumnOrName) -> Column:
    x = strip(F.coalesce(col(c), F.lit("")))
    return (F.length(x) <= K.NUMBERED_HEADING_MAX_CHARS) & F.rlike(x, F.lit(java(K.NUMBERED_HEADING)))


def is_heading(style: ColumnOrName, text: ColumnOrName) -> Column:
    s = F.lower(F.coalesce(col(style), F.lit("")))
    x = strip(F.coalesce(col(text), F.lit("")))
    shouting = (
        (x != "")
        & (F.length(x) <= K.HEADING_MAX_CHARS)
        & (F.upper(x) == x)
        & ~F.right(x, F.lit(1)).isin(".", ":")
    )
    return F.startswith(s, F.lit("heading")) | (s == "title") | shouting | is_numbered_heading(text)


def is_code(c: ColumnOrName) -> Column:
    x = strip(F.coalesce(col(c), F.lit("")))
    digits = F.regexp_count(x, F.lit("[0-9]"))
    return (digits >= 2) & (digits * 5 >= F.length(x))


def row_cells(c: ColumnOrName) -> Column:
    """Cells of a pipe- or tab-separated line; NULL below two cells."""
    x = col(c)
    cells = F.filter(F.transform(F.split(x, "[|\t]"), strip), lambda p: p != "")
    has_separator = F.contains(x, F.lit("|")) | F.contains(x, F.lit("\t"))
    return F.when(has_separator & (F.size(cells) >= 2), cells)


def dedupe_merged(arr: ColumnOrName) -> Column:
    a = col(arr)
    return F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))


def _plausible_share(x: Column) -> Column:
    """Runs of plausible ASCII go first: the wide class then sees only the few characters left."""
    rest = F.regexp_replace(x, K.PLAUSIBLE_ASCII, "")
    return (F.length(x) - within(rest, lambda r: F.length(r) - F.length(F.regexp_replace(r, K.IMPLAUSIBLE_CHAR, "")))) / F.length(x)


def implausible_ratio(c: ColumnOrName) -> Column:
    """Share of characters that ordinary text would hold; NULL for blank text."""
    x = strip(F.coalesce(col(c), F.lit("")))
    return F.when(x != "", _plausible_share(x))


def _may_repeat(x: Column) -> Column:
    """False only where no chunk comes three times or more over 30 % of ``x``; spares the search for the leftmost run.

    The first third of such a run is at least a tenth of the text, so one of the places 0, 10, 20, ... % lies in it, and the
    other two thirds hold the chunk twice: it comes twice right at that place.
    """
    twice = F.lit(java("^" + K.CHUNK + r"\1"))
    places = F.sequence(F.lit(1), F.length(x), F.floor(F.length(x) / 10).cast("int"))
    return (F.length(x) < 60) | F.exists(places, lambda i: F.rlike(F.substring(x, i, F.lit(2 * K.CHUNK_MAX)), twice))


def garbage_signs(c: ColumnOrName) -> Column:
    """``struct<share,repeated>`` of a text: plausible characters (NULL if blank), and whether a chunk repeats over much of it.

    The leftmost run of a repeated chunk counts. Every step is evaluated once.
    """

    def judged(x: Column, run: Column, chunk: Column) -> Column:
        return (F.length(chunk) >= 3) & ~F.rlike(chunk, F.lit(K.BORDER_ONLY)) & (F.length(run) >= 0.3 * F.length(x))

    def repeated(x: Column) -> Column:
        chunk = lambda run: strip(F.regexp_extract(run, java(K.REPEATED_CHUNK), 1))
        return F.when(_may_repeat(x), within(F.regexp_extract(x, java(K.REPEATED_CHUNK), 0), lambda run: (
            within(chunk(run), lambda piece: judged(x, run, piece))))).otherwise(False)

    return within(strip(F.coalesce(col(c), F.lit(""))), lambda x: F.struct(
        F.when(x != "", _plausible_share(x)).alias("share"), repeated(x).alias("repeated")))


def is_garbage(c: ColumnOrName, min_ratio: float = 0.6) -> Column:
    return within(garbage_signs(c), lambda signs: looks_garbage(signs, min_ratio))


def looks_garbage(signs: ColumnOrName, min_ratio: float = 0.6) -> Column:
    """``is_garbage`` of a text by its ``garbage_signs``."""
    share = col(signs)["share"]
    return share.isNull() | (share < min_ratio) | col(signs)["repeated"]


def truncate_text(c: ColumnOrName, limit: int) -> Column:
    x = F.coalesce(col(c), F.lit(""))
    cut = F.rtrim(F.left(x, F.lit(limit)), F.lit(K.WS_CHARS))
    return F.when(F.length(x) > limit, F.concat(cut, F.lit("\n...[truncated]"))).otherwise(x)


def title_case(c: ColumnOrName) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 2147483647))), "")
