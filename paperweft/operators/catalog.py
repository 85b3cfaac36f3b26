"""Template catalogue: merge, guard, lifecycle. A template's schema is ``MAP<STRING, STRING>``, key to JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed as K, text as X
from .ids import allocate
from .pages import first_filled

# fixed values: JSON texts that count as "nothing there"
BLANK_JSON = ["", "null", "[]", "{}", '""', "0", "false"]
HEAD = ["version", "template_name", "description", "specification_number", "file_name", "structure_locked"]


def _filled(v: Column) -> Column:
    return F.coalesce(~F.trim(v).isin(BLANK_JSON), F.lit(False))


def merge_schema(existing: Column, incoming: Column, kept_if_blank: list[str]) -> Column:
    """Incoming keys win; of ``kept_if_blank`` a filled existing value survives a blank one."""
    wins = F.map_filter(incoming, lambda k, v: ~(k.isin(kept_if_blank) & ~_filled(v) & _filled(F.try_element_at(existing, k))))
    rest = F.map_filter(existing, lambda k, v: ~F.coalesce(F.map_contains_key(wins, k), F.lit(False)))
    return F.map_concat(rest, wins)


def sync(current: DataFrame, incoming: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """Upsert the catalogue from files; ``change`` tells inserted, updated, unchanged, absent.

    Both sides: template_id, ``HEAD``, schema; ``current`` also is_active, status. New templates
    enter as pending and inactive; with ``inferred`` (template_id, sections) their sections are
    the inferred ones unless the file locks its structure.
    """
    old = current.select("template_id", F.struct(*HEAD, "is_active", "status", "schema").alias("o"))
    new = incoming.select("template_id", F.struct(*HEAD, "schema").alias("n"))
    df = old.join(new, "template_id", "full_outer")
    fresh, absent = F.col("o").isNull(), F.col("n").isNull()
    schema = F.when(absent, F.col("o.schema")).when(fresh, F.col("n.schema")).otherwise(
        merge_schema(F.col("o.schema"), F.col("n.schema"), K.COMPUTED_KEYS))
    if inferred is not None:
        df = df.join(inferred.select("template_id", F.col("sections").alias("_sections")), "template_id", "left")
        use = fresh & F.col("_sections").isNotNull() & ~F.coalesce(F.col("n.structure_locked"), F.lit(False))
        one = F.create_map(F.lit("sections"), F.col("_sections"))
        schema = F.when(use, F.map_concat(F.map_filter(F.col("n.schema"), lambda k, v: k != "sections"), one)).otherwise(schema)
    df = df.withColumn("schema", schema)
    entries = lambda m: F.array_sort(F.map_entries(m))
    same = F.lit(True)
    for c in HEAD:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    same = same & entries(F.col("schema")).eqNullSafe(entries(F.col("o.schema")))
    return df.select(
        "template_id", *[F.when(absent, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in HEAD],
        F.when(fresh, False).otherwise(F.col("o.is_active")).alias("is_active"), F.when(fresh, "pending").otherwise(F.col("o.status")).alias("status"),
        "schema", F.when(fresh, "inserted").when(absent, "absent").when(same, "unchanged").otherwise("updated").alias("change"))


def list_active(templates: DataFrame) -> DataFrame:
    return templates.where("is_active").orderBy("template_id")


def list_pending(templates: DataFrame) -> DataFrame:
    return templates.where("status = 'pending'").orderBy(F.desc("created_at"), F.desc("template_id"))


def template_stats(templates: DataFrame, fields: DataFrame) -> DataFrame:
    n = fields.groupBy("template_id").agg(F.countDistinct("section_pos").alias("sections"), F.count("*").alias("fields"))
    return templates.select("template_id").join(n, "template_id", "left").na.fill(0, ["sections", "fields"])


def delete_plan(targets: DataFrame, jobs: DataFrame, projects: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdict per template, names of projects in use, job ids to delete). ``targets``: template_key.

    Jobs of existing projects block unless forced; jobs of vanished projects always go, but only
    with a template that is deleted. A project name in use is a row (template_key, project_name), once each: a template's
    names may be many, so they are sorted and joined only where they are shown.
    """
    mine = jobs.join(targets, "template_key", "left_semi").join(
        projects.select(F.col("id").alias("project_id"), "project_name", F.lit(True).alias("_live")), "project_id", "left")
    live = mine.where("_live")
    names = live.select("template_key", "project_name").distinct()
    quoted = F.sort_array(F.collect_list(F.concat(F.lit('"'), "project_name", F.lit('"'))))
    n_names = names.where("project_name is not null").groupBy("template_key").agg(F.count("*").alias("project_names"), F.array_join(quoted, ", ").alias("projects"))
    counts = live.groupBy("template_key").agg(F.count("*").alias("live_jobs")).join(n_names, "template_key", "left")
    blocked = F.lit(False) if force else F.coalesce(F.col("live_jobs") > 0, F.lit(False))
    verdict = targets.join(counts, "template_key", "left").select(
        "template_key", blocked.alias("blocked"), F.coalesce("live_jobs", F.lit(0)).alias("live_jobs"), F.coalesce("project_names", F.lit(0)).alias("project_names"),
        F.coalesce("projects", F.lit("")).alias("projects"))
    doomed = mine.join(verdict.where("not blocked").select("template_key"), "template_key", "left_semi")
    doomed = doomed if force else doomed.where("_live is null")
    return verdict, names, doomed.select(F.col("id").alias("job_id"), "template_key")


def unique_ids(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(seq, template_id): a free id per new name, in ``seq`` order; ``new``: seq, name."""
    asked = new.select("seq", X.slug("name", "template").alias("base"))
    return allocate(asked, [], ["seq"], existing.select(F.col("template_id").alias("id"))).select("seq", F.col("id").alias("template_id"))


def approve(pending: DataFrame, fields: DataFrame, on_disk: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Pending templates with ``error``; approved ones become active, under ``approved_id``.

    A template that has a folder (``on_disk``: template_id) keeps its id, since files are found by it; any other takes the
    free id of its name, in order of its former id. ``existing`` (template_id) are the ids of all templates; those that are
    given up here are free. Without ``on_disk`` every id is kept.
    """
    n = fields.groupBy("template_id").agg(F.count("*").alias("_n"))
    ok = F.coalesce("_n", F.lit(0)) > 0
    rows = pending.where("status = 'pending'").join(n, "template_id", "left").withColumn("_ok", ok)
    out = ["template_id", F.when(F.col("_ok"), True).otherwise(F.col("is_active")).alias("is_active"), F.when(F.col("_ok"), "active").otherwise(F.col("status")).alias("status"),
           F.when(~F.col("_ok"), "Add at least one field before approving this template").alias("error")]
    if on_disk is None:
        return rows.select(*out, F.when(F.col("_ok"), F.col("template_id")).alias("approved_id"))
    moved = rows.where("_ok").join(on_disk.select("template_id").distinct(), "template_id", "left_anti")
    kept = pending.select("template_id") if existing is None else existing.select("template_id")
    used = kept.join(moved.select("template_id"), "template_id", "left_anti").select(F.col("template_id").alias("id"))
    named = allocate(moved.select("template_id", X.slug("template_name", "template").alias("base")), [], ["template_id"], used)
    return rows.join(named.select("template_id", "id"), "template_id", "left").select(*out, F.when(F.col("_ok"), F.coalesce("id", "template_id")).alias("approved_id"))


def finalize(existing: DataFrame, final: DataFrame, summary: DataFrame) -> DataFrame:
    """Merged schema of reviewed templates with the review's totals; ready for ``approve``."""
    df = existing.select("template_id", F.col("schema").alias("_e")).join(final.select("template_id", F.col("schema").alias("_f")), "template_id")
    df = df.join(summary, "template_id", "left")
    return df.select("template_id", merge_schema(F.col("_e"), F.col("_f"), K.FINALIZE_KEYS).alias("schema"), F.lit("active").alias("status"),
                     "pages_validated", "fields_extracted", "confidence_average")


def apply_edits(blocks: DataFrame, edits: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The edited set of static blocks, with ``applied``.

    ``edits`` is the full set the reviewer keeps (doc_id, block_id, text): blocks it lacks stay
    removed. Text of table blocks is put back; a changed text counts as applied if the block's
    paragraph exists (``paragraphs``: doc_id, n).
    """
    key = ["doc_id", "block_id"]
    old = blocks.select(*key, "block_type", "paragraph_index", F.col("text").alias("_old"))
    df = edits.select(*key, F.col("text").alias("_new")).join(old, key, "left").join(paragraphs, "doc_id", "left")
    table = F.coalesce(F.col("block_type") == "table", F.lit(False))
    changed = F.col("_old").isNotNull() & ~table & ~F.col("_new").eqNullSafe(F.col("_old"))
    valid = F.coalesce((F.col("paragraph_index") >= 0) & (F.col("paragraph_index") < F.col("n")), F.lit(False))
    return df.select(*key, F.when(table, F.col("_old")).otherwise(F.col("_new")).alias("text"), (changed & valid).alias("applied"))


def promote(blocks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new fields, remaining static blocks) for the promoted block ids."""
    key = ["doc_id", "block_id"]
    text = X.strip(F.coalesce("text", F.lit("")))
    page = F.col("page_number").cast("string")
    hint = F.when(text != "", F.concat(
        F.lit('This was static text in the source document ("'), F.left(text, F.lit(80)), F.lit('") - promoted to a dynamic field during template review.'))).otherwise(
        F.concat(F.lit("Blank in the source document (page "), page, F.lit(") - promoted to a dynamic field during template review; fill it in per-project.")))
    fields = blocks.join(ids, key, "left_semi").select(
        *key, F.lit("promoted_fields").alias("section_id"), F.when(text != "", text).otherwise(F.concat(F.lit("Field (page "), page, F.lit(")"))).alias("field_label"),
        "page_number", hint.alias("extraction_hint"))
    return fields, blocks.join(ids, key, "left_anti")


def clean_fields(fields: DataFrame) -> DataFrame:
    """Fields with a label; a missing id is derived from the label."""
    label = X.strip(F.coalesce("field_label", F.lit("")))
    derived = F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_")
    return fields.where(label != "").withColumn("field_id", first_filled(X.strip(F.coalesce("field_id", F.lit(""))), derived))


def list_static(blocks: DataFrame, page: int | None = None) -> DataFrame:
    """Static blocks of a page (or all), likely fill-in spots first; order by the rank columns."""
    df = blocks if page is None else blocks.where(F.col("page_number") == page)
    return df.withColumn("rank", F.when(F.col("looks_like_blank_field"), 0).otherwise(1))


def retire(templates: DataFrame, ids: DataFrame, stamp: str) -> DataFrame:
    """Rename stale templates so that the next sync re-creates them; keys of past jobs stay valid."""
    df = templates.join(ids.withColumn("_stale", F.lit(True)), "template_id", "left")
    return df.withColumn("template_id", F.when(F.col("_stale"), F.concat("template_id", F.lit(f"_legacy_{stamp}"))).otherwise(F.col("template_id"))).drop("_stale")


def page_feedback(fields: DataFrame, actions: DataFrame) -> DataFrame:
    """Correction and approval per field of a reviewed page.

    ``fields``: template_id, page_number, field_id, value. ``actions``: template_id, field_id,
    correction, approved, removed. Removed fields are corrected to an empty text.
    """
    df = fields.join(actions, ["template_id", "field_id"], "left")
    removed = F.coalesce("removed", F.lit(False))
    return df.select(
        "template_id", "page_number", "field_id", F.when(removed, "").otherwise(F.coalesce("correction", "value", F.lit(""))).alias("correction"),
        (~removed & F.coalesce("approved", F.lit(False))).alias("approved"))


def feedback_per_page(feedback: DataFrame) -> DataFrame:
    """(template_id, page_number, corrections map, approved list): a page has few fields."""
    return feedback.groupBy("template_id", "page_number").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", "correction")))).alias("corrections"),
        F.array_sort(F.collect_list(F.when(F.col("approved"), F.col("field_id")))).alias("approved_fields"))
