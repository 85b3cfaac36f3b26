"""Structure signatures and integrity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .parts import ranked
from .structure import page_count


def _json_string(c: Column) -> Column:
    """JSON string literal with non-ASCII characters escaped."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escape = lambda ch: F.when(F.ascii(ch) > 127, F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(ch)), 4, "0")))).otherwise(ch)
    wide = F.array_join(F.transform(F.split(plain, ""), escape), "")
    return F.concat(F.lit('"'), F.when(F.rlike(c, F.lit(r"[^\x00-\x7f]")), wide).otherwise(plain), F.lit('"'))


def _hash16(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def block_hashes(blocks: DataFrame, dims: DataFrame) -> DataFrame:
    """(doc_id, block_seq, kind, hash): structure, not content, of every block.

    ``dims``: doc_id, block_seq, row_count, col_count, cell_count of the tables.
    """
    para = F.concat(
        F.lit('{"alignment": '), _json_string(F.coalesce("alignment", F.lit("None"))), F.lit(', "level": '), F.coalesce(_s("level"), F.lit("null")),
        F.lit(', "run_count": '), _s("run_count"), F.lit(', "style": '), _json_string(F.coalesce("style", F.lit("Normal"))), F.lit("}"))
    table = F.concat(
        F.lit('{"cells": '), _s(F.coalesce("cell_count", F.lit(0))), F.lit(', "cols": '), _s(F.coalesce("col_count", F.lit(0))),
        F.lit(', "rows": '), _s(F.coalesce("row_count", F.lit(0))), F.lit("}"))
    is_table = F.col("block_type") == "table"
    return blocks.join(dims, ["doc_id", "block_seq"], "left").select(
        "doc_id", "block_seq", F.when(is_table, "table").otherwise("para").alias("kind"), _hash16(F.when(is_table, table).otherwise(para)).alias("hash"))


def table_dims(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_count, col_count, cell_count): rows, widest row, rows x first row."""
    rows = cells.groupBy("doc_id", "table_index", "row_no").agg(F.count("*").alias("n"), F.sum(F.greatest("colspan", F.lit(1))).alias("w"))
    return rows.groupBy("doc_id", "table_index").agg(
        F.count("*").cast("int").alias("row_count"), F.max("w").cast("int").alias("col_count"),
        (F.count("*") * F.min_by("n", "row_no")).cast("int").alias("cell_count"))


def signatures(blocks: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """One row per document: counts, header/footer flags, overall hash.

    ``frames``: doc_id, has_headers, has_footers, has_sections. The overall hash covers counts
    and lengths only, so no block list has to be gathered; the lists stay rows (``block_hashes``).
    """
    counts = blocks.groupBy("doc_id").agg(
        F.count_if(F.col("block_type") == "table").cast("int").alias("table_count"),
        F.count_if(F.col("block_type") != "table").cast("int").alias("paragraph_count"),
        F.count("*").cast("int").alias("block_count"))
    df = counts.join(page_count(blocks).select("doc_id", F.col("signature_pages").alias("page_count")), "doc_id")
    flags = ["has_headers", "has_footers", "has_sections"]
    df = df.join(frames, "doc_id", "left") if frames is not None else df
    for f in flags:
        df = df.withColumn(f, F.coalesce(F.col(f), F.lit(False)) if frames is not None else F.lit(False))
    text = F.concat(
        F.lit('{"block_sequence_length": '), _s("block_count"), F.lit(', "footers": '), _s("has_footers"), F.lit(', "hashes_count": '), _s("block_count"),
        F.lit(', "headers": '), _s("has_headers"), F.lit(', "pages": '), _s("page_count"), F.lit(', "paragraphs": '), _s("paragraph_count"),
        F.lit(', "sections": '), _s("has_sections"), F.lit(', "tables": '), _s("table_count"), F.lit("}"))
    return df.withColumn("overall_hash", _hash16(text))


def sequence_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids whose block kinds differ at some position: a join by position, no list per document.

    ``a``, ``b``: pair_id, block_seq, kind.
    """
    key = ["pair_id", "block_seq"]
    both = a.select(*key, F.col("kind").alias("_a")).join(b.select(*key, F.col("kind").alias("_b")), key, "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("pair_id").distinct()


def _between(label: str, c: str) -> Column:
    return F.concat(F.lit(label + ": "), _s(F.col(f"a.{c}")), F.lit(" vs "), _s(F.col(f"b.{c}")))


def _title(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def compare_signatures(a: DataFrame, b: DataFrame, differing: DataFrame) -> DataFrame:
    """(pair_id, is_identical, differences) plus both signatures as structs ``a`` and ``b``."""
    wrap = lambda df, n: df.select("pair_id", F.struct(*[c for c in df.columns if c != "pair_id"]).alias(n))
    df = wrap(a, "a").join(wrap(b, "b"), "pair_id").join(differing.withColumn("_seq", F.lit(True)), "pair_id", "left")
    ne = lambda c: F.col(f"a.{c}") != F.col(f"b.{c}")
    flag = lambda label, c: F.concat(F.lit(label + ": "), _title(F.col(f"a.{c}")), F.lit(" vs "), _title(F.col(f"b.{c}")))
    problems = F.array(
        F.when(ne("page_count"), _between("Page count mismatch", "page_count")),
        F.when(ne("table_count"), _between("Table count mismatch", "table_count")),
        F.when(F.abs(F.col("a.paragraph_count") - F.col("b.paragraph_count")) > 5, _between("Paragraph count variance", "paragraph_count")),
        F.when(ne("has_headers"), flag("Header presence mismatch", "has_headers")),
        F.when(ne("has_footers"), flag("Footer presence mismatch", "has_footers")),
        F.when(F.col("_seq"), F.lit("Block sequence mismatch (layout structure changed)")))
    df = df.withColumn("differences", F.filter(problems, lambda p: p.isNotNull()))
    return df.select("pair_id", (F.size("differences") == 0).alias("is_identical"), "differences", "a", "b")


def dimension_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair_id, table_index, pos, error): row and column mismatches of tables at the same position.

    ``a``, ``b``: pair_id, table_index, row_count, col_count.
    """
    key = ["pair_id", "table_index"]
    both = a.select(*key, F.struct("row_count", "col_count").alias("a")).join(b.select(*key, F.struct("row_count", "col_count").alias("b")), key)
    name = lambda what, c: F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), F.concat(
        F.lit("Table "), _s("table_index"), F.lit(f" {what} count mismatch: "), _s(F.col(f"a.{c}")), F.lit(" vs "), _s(F.col(f"b.{c}"))))
    errors = both.select(*key, F.posexplode(F.array(name("row", "row_count"), name("column", "col_count"))).alias("pos", "error"))
    return errors.where("error is not null")


def removed_styles(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair_id, removed): styles of the master that the generated document lacks, in order."""
    gone = a.select("pair_id", "style").distinct().join(b.select("pair_id", "style").distinct(), ["pair_id", "style"], "left_anti")
    return gone.groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_list("style")), ", ").alias("removed"))


def integrity_report(compared: DataFrame, dims: DataFrame, styles: DataFrame) -> DataFrame:
    """(pair_id, is_valid, errors, warnings, checks, structure_preserved, layout_preserved).

    ``dims`` is ``dimension_errors``, ``styles`` is ``removed_styles``. Dimension checks apply only
    where both documents have the same number of tables.
    """
    d = dims.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("table_index", "pos", "error"))).alias("_d")).select("pair_id", F.col("_d.error").alias("_dims"))
    df = compared.join(d, "pair_id", "left").join(styles, "pair_id", "left")
    same_pages, same_tables = F.col("a.page_count") == F.col("b.page_count"), F.col("a.table_count") == F.col("b.table_count")
    gap = F.abs(F.col("a.paragraph_count") - F.col("b.paragraph_count"))
    none = F.array().cast("array<string>")
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(none)
    errors = F.concat(
        one(~F.col("is_identical"), F.lit("Document structure changed")),
        one(~same_pages, _between("Page count mismatch", "page_count")),
        one(~same_tables, _between("Table count mismatch", "table_count")),
        F.when(same_tables, F.coalesce("_dims", none)).otherwise(F.array(F.lit("Table count mismatch"))))
    warnings = F.concat(
        F.transform("differences", lambda x: F.concat(F.lit("Structural difference: "), x)),
        one(F.col("removed").isNotNull(), F.concat(F.lit("Styles removed: "), F.col("removed"))),
        one(gap > 10, _between("Paragraph count variance", "paragraph_count")))
    df = df.withColumns({"errors": errors, "warnings": warnings})
    check = lambda name, passed, details: F.struct(F.lit(name).alias("name"), passed.alias("passed"), details.alias("details"))
    yes, blank = F.lit(True), F.lit("")
    checks = F.concat(
        F.array(check("Files exist", yes, blank), check("Document analysis", yes, blank),
                check("Structure comparison", F.col("is_identical"), F.concat(_s(F.size("differences")), F.lit(" differences"))),
                check("Page count", same_pages, F.concat(_s("a.page_count"), F.lit(" pages"))),
                check("Table count", same_tables, F.concat(_s("a.table_count"), F.lit(" tables")))),
        F.when(same_tables, F.array(check("Table structure", F.size("errors") == 0, blank))).otherwise(F.array()),
        F.array(check("Font styles", F.col("removed").isNull(), blank),
                check("Paragraph count", gap <= 10, F.concat(_s("b.paragraph_count"), F.lit(" paragraphs")))))
    return df.select("pair_id", (F.size("errors") == 0).alias("is_valid"), "errors", "warnings", checks.alias("checks"),
                     (F.col("is_identical") & same_tables).alias("structure_preserved"), same_pages.alias("layout_preserved"))


def replacement_only(compared: DataFrame, schema: DataFrame) -> DataFrame:
    """(pair_id, is_valid, errors, dynamic_fields): nothing but field values changed.

    ``schema``: pair_id, field_id, is_dynamic.
    """
    n = schema.where("is_dynamic").groupBy("pair_id").agg(F.countDistinct("field_id").alias("_n"))
    return compared.join(n, "pair_id", "left").select(
        "pair_id", F.col("is_identical").alias("is_valid"),
        F.transform("differences", lambda x: F.concat(F.lit("Structure changed: "), x)).alias("errors"), F.coalesce("_n", F.lit(0)).alias("dynamic_fields"))


def _parts_of(text: Column) -> list[Column]:
    """Two 60-bit numbers of a text; their sums over a set of numbered texts stand for the whole in order."""
    return [F.conv(F.substring(F.md5(text.cast("binary")), at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]


def _digest(df: DataFrame, keys: list[str], text: Column, count: str) -> DataFrame:
    one, two = _parts_of(text)
    sums = df.withColumns({"_one": one, "_two": two}).groupBy(*keys).agg(F.sum("_one").alias("_one"), F.sum("_two").alias("_two"), F.count("*").alias(count))
    return sums.withColumn("digest", F.concat_ws(":", F.col("_one").cast("string"), F.col("_two").cast("string"))).drop("_one", "_two")


def _field_line() -> Column:
    return F.concat(F.lit("FIELD:"), F.concat_ws(":", *[F.coalesce(F.col(c), F.lit("")) for c in ("field_id", "field_label", "data_type")],
                                                 _title(F.coalesce("required", F.lit(False)))))


def section_digests(fields: DataFrame) -> DataFrame:
    """(template_id, section_pos, section_id, section_name, n_fields, digest): a section's fields in order, as one digest.

    A field enters with its rank in the section, so sums, which combine before the shuffle, keep the order; no
    task or row holds a section.
    """
    key = ["template_id", "section_pos"]
    placed = ranked(fields.select(*key, "field_pos", _field_line().alias("_line")), key, ["field_pos"])
    heads = fields.groupBy(*key).agg(F.min(F.coalesce("section_id", F.lit(""))).alias("section_id"), F.min(F.coalesce("section_name", F.lit(""))).alias("section_name"))
    return heads.join(_digest(placed, key, F.concat_ws("|", F.col("rank").cast("string"), "_line"), "n_fields"), key)


def schema_signature(fields: DataFrame) -> DataFrame:
    """(template_id, n_sections, n_fields, digest): equal for templates with the same sections and fields in the same order."""
    placed = ranked(section_digests(fields), ["template_id"], ["section_pos"])
    text = F.concat_ws("|", F.col("rank").cast("string"), "section_id", "section_name", F.col("n_fields").cast("string"), "digest")
    n = placed.groupBy("template_id").agg(F.sum("n_fields").alias("n_fields"))
    return _digest(placed, ["template_id"], text, "n_sections").join(n, "template_id").select("template_id", "n_sections", "n_fields", "digest")


def signature_text(fields: DataFrame) -> DataFrame:
    """(template_id, signature): the lines of ``signature_lines`` in order, joined. A row holds a template; to compare templates, use digests."""
    line = F.struct("section_pos", F.col("field_pos").alias("at"), "line")  # a section's own line sorts first: its place is NULL
    return signature_lines(fields).groupBy("template_id").agg(F.sort_array(F.collect_list(line)).alias("_l")).select(
        "template_id", F.array_join("_l.line", "|").alias("signature"))


def signature_lines(fields: DataFrame) -> DataFrame:
    """(template_id, section_pos, field_pos, line): the signature as text, a row a line; a section's own line has no field_pos."""
    head = F.concat(F.lit("SECTION:"), F.coalesce("section_id", F.lit("")), F.lit(":"), F.coalesce("section_name", F.lit("")))
    heads = fields.groupBy("template_id", "section_pos").agg(F.min(head).alias("line")).withColumn("field_pos", F.lit(None).cast("int"))
    return fields.select("template_id", "section_pos", F.col("field_pos").cast("int").alias("field_pos"), _field_line().alias("line")).unionByName(heads)


def changed_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(template_id, section_pos, change): sections that were ``added``, ``removed`` or ``changed``, by their digests."""
    body = F.struct("section_id", "section_name", "n_fields", "digest")
    key = ["template_id", "section_pos"]
    both = section_digests(old).select(*key, body.alias("_o")).join(section_digests(new).select(*key, body.alias("_n")), key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


# fixed values: messages of the locked-template check
LOCKED = [
    "Template structure is locked and cannot be modified. Only field values can be changed.",
    "Cannot add or remove sections from a locked template.",
    "Cannot add or remove fields from a locked template section.",
]


def validate_locked(templates: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(template_id, is_valid, message): locked templates must keep signature, sections and field counts.

    The signature contains every section and field, so equal signatures imply equal counts; the
    first check that fails is always the signature. Digests are compared, never texts.
    """
    sig = lambda df, n: schema_signature(df).select("template_id", F.col("digest").alias(n))
    df = templates.select("template_id", "structure_locked").join(sig(old, "_o"), "template_id", "left").join(sig(new, "_n"), "template_id", "left")
    same = F.coalesce("_o", F.lit("")) == F.coalesce("_n", F.lit(""))
    ok = ~F.coalesce("structure_locked", F.lit(False)) | same
    return df.select("template_id", ok.alias("is_valid"), F.when(ok, "").otherwise(LOCKED[0]).alias("message"))
