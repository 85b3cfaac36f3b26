"""Page and line analytics. Everything about one page is computed inside its row: no shuffle."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

import html as _html
import pandas as pd

from ..functions import fixed as K, html as H, text as X
from .prefix import SEGMENT, position, running


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """Non-empty stripped lines with their position."""
    keep = [c for c in pages.columns if c != text]
    return pages.select(*keep, F.posexplode(X.split_lines(text)).alias("line_no", "line"))


def _rows(lines: Column) -> Column:
    return F.filter(F.transform(lines, X.row_cells), lambda r: r.isNotNull())


def page_summary(pages: DataFrame, text: str = "text") -> DataFrame:
    """Normalized text, field labels, table rows, counts and layout score of every page."""
    df = X.let(pages, _lines=X.split_lines(text))
    df = X.let(
        df,
        field_labels=F.filter(F.transform("_lines", lambda x: X.candidate_field(x)["label"]), lambda x: x.isNotNull()),
        table_rows=_rows(F.col("_lines")),
        line_count=F.size("_lines"),
        total_words=F.aggregate("_lines", F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(K.WORD))),
    )
    n = F.col("line_count")
    score = (
        F.lit(0.4)
        + F.least(F.lit(0.3), F.size("field_labels") / n)
        + F.least(F.lit(0.2), F.size("table_rows") * 0.1)
        + F.least(F.lit(0.1), F.col("total_words") / n * 0.02)
    )
    return df.select(
        *[c for c in pages.columns if c != text],
        F.array_join("_lines", "\n").alias("normalized_text"),
        "field_labels", "table_rows", F.size("table_rows").alias("table_count"), "line_count", "total_words",
        F.when(n > 0, F.round(F.least(F.lit(1.0), score), 3)).otherwise(0.0).alias("layout_score"),
    )


def page_fidelity(df: DataFrame, source: str, extracted: str) -> DataFrame:
    """How much of the source text and of its table rows the extracted text covers."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(X.normalize(X.unify_newlines(c)), F.lit(f"({K.FIDELITY_TOKEN})"), 1))
    rows = lambda c: F.transform(_rows(F.split(X.unify_newlines(F.coalesce(F.col(c), F.lit(""))), "\n")),
                                 lambda r: F.array_join(r, " | "))
    step = X.let(df, _s=tokens(source), _e=tokens(extracted), source_table_rows=rows(source), extracted_table_rows=rows(extracted))
    step = X.let(
        step,
        covered_tokens=F.size(F.array_intersect("_s", "_e")),
        total_tokens=F.size("_s"),
        _both=F.size(F.array_intersect("source_table_rows", "extracted_table_rows")),
        _any=F.size(F.array_union("source_table_rows", "extracted_table_rows")),
    )
    coverage = F.when(F.col("total_tokens") == 0, 1.0).otherwise(F.col("covered_tokens") / F.col("total_tokens"))
    table = F.when(F.col("_any") == 0, 0.0).otherwise(F.col("_both") / F.col("_any"))
    return step.select(
        *[c for c in df.columns if c not in (source, extracted)],
        F.round(coverage, 3).alias("coverage_ratio"), F.round(table, 3).alias("table_match_ratio"),
        "covered_tokens", "total_tokens", "source_table_rows", "extracted_table_rows")


def first_filled(*cols: Column) -> Column:
    """First argument that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def field_line(label: Column, value: Column) -> Column:
    v = X.strip(F.coalesce(value, F.lit("")))
    return F.when(v != "", F.concat(label, F.lit(": "), v)).otherwise(label)


def page_text_from_fields(fields: DataFrame, keys: list[str], order: list[str],
                          labels=("field_label",), values=("value",), value_defaults=("default_value",)) -> DataFrame:
    """One text per page: ``label: value`` lines in field order, with label and value fall-backs."""
    label = F.coalesce(first_filled(*map(F.col, labels)), F.lit("Unknown field"))
    value = F.coalesce(*map(F.col, values), first_filled(*map(F.col, value_defaults)))
    line = F.struct(*order, field_line(label, value).alias("line"))
    return fields.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("b")).select(
        *keys, X.strip(F.array_join("b.line", "\n")).alias("text"))


def choose_text(given: Column, rebuilt: Column) -> Column:
    g, r = X.strip(F.coalesce(given, F.lit(""))), F.coalesce(rebuilt, F.lit(""))
    return F.when((r != "") & (F.length(g) < F.length(r)), r).otherwise(given)


@F.pandas_udf(ArrayType(StringType()))
def _unescape_each(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else [_html.unescape(x) for x in a])


def html_fields(pages: DataFrame, html: str = "html", limit: int = 20, entities: dict[str, str] | None = None) -> DataFrame:
    """Page-local fields from visible text: distinct blocks in order, split at the first colon.

    A block that reads ``&nbsp;`` once decoded keeps its number but is no field. ``entities``: see ``html.unescape``.
    """
    df = X.let(pages, _raw=F.concat(H.html_blocks(html), F.array(H.drop_tags(html))))
    decoded = _unescape_each("_raw") if entities is None else F.transform("_raw", lambda b: H.unescape(b, entities))
    df = X.let(df, _text=decoded)
    df = X.let(df, _all=F.transform("_text", X.squeeze))
    inner = F.array_distinct(F.filter(F.slice("_all", 1, F.size("_all") - 1), lambda b: b != ""))
    df = X.let(df, _inner=inner)
    whole = F.filter(F.slice("_all", -1, 1), lambda b: b != "")
    blocks = F.when(F.size("_inner") > 0, F.col("_inner")).otherwise(whole)

    def field(block: Column, i: Column) -> Column:
        left = X.strip(F.substring_index(block, ":", 1))
        right = X.strip(F.substring(block, F.instr(block, ":") + 1, F.length(block)))
        split = F.contains(block, F.lit(":")) & (F.length(left) <= 60)
        n = (i + 1).cast("string")
        label = (
            F.when(split, F.coalesce(F.nullif(left, F.lit("")), F.concat(F.lit("Page value "), n)))
            .when(F.length(block) > 80, F.concat(F.lit("Page value "), n))
            .otherwise(F.concat(F.lit("Value "), n))
        )
        return F.struct((i + 1).alias("idx"), label.alias("field_label"), F.when(block == "&nbsp;", "").when(split, right).otherwise(block).alias("value"))

    fields = F.filter(F.transform(blocks, field), lambda f: f["value"] != "")
    keep = [c for c in pages.columns if c != html]
    return df.select(*keep, F.inline(F.slice(fields, 1, limit)))


def structure_summary(fields: DataFrame, keys: list[str], data_type: str = "data_type") -> DataFrame:
    """``Detected n fields: , a string, b date`` with types in order."""
    per_type = fields.groupBy(*keys, F.coalesce(F.col(data_type), F.lit("text")).alias("t")).agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda s: F.concat_ws(" ", s["n"], s["t"]))
    return per_type.groupBy(*keys).agg(F.concat(
        F.lit("Detected "), F.sum("n").cast("string"), F.lit(" fields: , "), F.array_join(parts, ", ")).alias("summary"))


def needs_review(fields: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """Mean confidence below 0.7, a missing one counting 0.5; decimals are averaged exactly."""
    mean = F.avg(F.coalesce(F.col(confidence), F.lit(Decimal("0.5"))))
    return fields.groupBy(*keys).agg((mean < F.lit(Decimal("0.7"))).alias("needs_review"))


def text_preview(blocks: DataFrame, cells: DataFrame, limit: int = 2000) -> DataFrame:
    """First ``limit`` characters of a document. Only pieces whose line break before them lies
    inside the limit are gathered, so the group that is concatenated is bounded whatever the document's size."""
    from .tables import number_tables

    para = blocks.where(F.col("block_type") != "table").select(
        "doc_id", position(F.col("block_seq")).alias("at"), X.clean_text("text").alias("piece")).where("piece <> ''")
    rows = cells.groupBy("doc_id", "table_index", "row_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"))
    rows = rows.where(F.exists("c.text", lambda x: x != "")).join(
        number_tables(blocks).select("doc_id", "table_index", "block_seq"), ["doc_id", "table_index"])
    table = rows.select("doc_id", position(F.col("block_seq"), F.col("row_no")).alias("at"), F.concat(
        F.lit("[TABLE ROW "), (F.col("row_no") + 1).cast("string"), F.lit("] "), F.array_join("c.text", " | ")).alias("piece"))
    scanned = running(para.unionByName(table), ["doc_id"], "at", {"_end": ("sum", F.length("piece") + 1)}, segment=SEGMENT << 31)
    head = scanned.where(F.col("_end") - F.length("piece") - 1 <= limit)
    return head.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("b")).select(
        "doc_id", F.left(F.array_join("b.piece", "\n"), F.lit(limit)).alias("preview"))


def combine_layers(pages: DataFrame, ocr: DataFrame, rows: DataFrame) -> DataFrame:
    """Text layer, OCR text the layer does not already contain, then structured table rows.

    ``rows`` is (doc_id, page_number, row_no, row_text).
    """
    key = ["doc_id", "page_number"]
    per_page = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row_no", "row_text"))).alias("r")).select(
        *key, F.array_join("r.row_text", "\n").alias("_rows"))
    df = pages.join(ocr.select(*key, "ocr_text"), key, "left").join(per_page, key, "left")
    layer, seen = F.coalesce(F.col("text"), F.lit("")), X.strip(F.coalesce(F.col("ocr_text"), F.lit("")))
    joined = F.when((seen != "") & ~F.contains(layer, seen), X.strip(F.concat(layer, F.lit("\n"), F.col("ocr_text")))).otherwise(layer)
    df = X.let(df, _joined=joined)
    block = F.concat(F.col("_joined"), F.lit("\n\nSTRUCTURED TABLE DATA (columns tab-separated, in source order):\n"), F.col("_rows"))
    return df.select(*key, F.when(F.col("_rows").isNotNull(), X.strip(block)).otherwise(F.col("_joined")).alias("text"))


def table_row_texts(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_no, row_text): cells tab-joined, merged-cell repeats and blanks dropped."""
    rows = cells.groupBy("doc_id", "table_index", "row_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"))
    kept = F.filter(X.dedupe_merged(F.transform("c.text", X.strip)), lambda x: x != "")
    return rows.select("doc_id", "table_index", "row_no", F.array_join(kept, "\t").alias("row_text")).where("row_text <> ''")
