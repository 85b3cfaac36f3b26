"""Writing: nested and flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.pages import first_filled


def export_jobs(results: DataFrame, documents: DataFrame) -> DataFrame:
    """(job_id, part_no, status, json) of completed jobs; ``results`` is ``job_results``."""
    d = documents.select(F.col("id").alias("document_id"), F.col("original_filename").alias("document_filename"))
    df = results.where("status = 'completed'").join(d, "document_id", "left")
    body = F.struct(
        "project_id", "document_id", "document_filename", F.col("template_code").alias("template_id"), "template_name",
        F.col("job_id").alias("extraction_job_id"), "status", F.col("extracted_fields").alias("fields"))
    return df.select("job_id", "part_no", "status", F.to_json(body).alias("json"))


def write_job_exports(exports: DataFrame, folder: str) -> None:
    exports.select("status", F.col("json").alias("value")).write.partitionBy("status").text(folder)


def export_flat(fields: DataFrame, references: DataFrame) -> DataFrame:
    """(job_id, field, value, status, source_page): one row per field, its first reference's page."""
    dash = F.lit("—")
    # the reference with the smallest key counts as the first one
    first = references.groupBy("job_id", "field_id").agg(F.min_by("page_number", "reference_id").alias("_page"))
    return fields.join(first, ["job_id", "field_id"], "left").select(
        "job_id", F.coalesce(first_filled(F.col("field_label"), F.col("field_id")), F.lit("")).alias("field"),
        F.coalesce(F.nullif("value", F.lit("")), dash).alias("value"), F.coalesce("validation_status", F.lit("")).alias("status"),
        F.coalesce(F.col("_page").cast("string"), dash).alias("source_page"))


def export_documents(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, part_no, json): title, subtitle, meta and sections of edited documents.

    ``sections`` carries part_no for documents of very many sections (see ``operators.parts``).
    """
    body = sections.groupBy("doc_id", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("section_no", F.col("section_no").cast("string").alias("section_number"), "section_name", "content"))).alias("s"))
    item = F.transform("s", lambda x: F.struct(x["section_number"].alias("section_number"), x["section_name"].alias("section_name"), x["content"].alias("content")))
    df = documents.join(body.select("doc_id", "part_no", item.alias("sections")), "doc_id")
    return df.select("doc_id", "part_no", F.to_json(F.struct("title", "subtitle", "project_meta", "sections")).alias("json"))
