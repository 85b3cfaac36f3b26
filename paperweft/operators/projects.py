"""Projects, dashboard, cascading deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels as L
from .parts import PART_SIZE, nest


def _with_template(df: DataFrame, templates: DataFrame) -> DataFrame:
    return df.join(templates.select("template_key", "template_id", "template_name"), "template_key", "left")


def project_list(projects: DataFrame, documents: DataFrame, jobs: DataFrame, templates: DataFrame,
                 limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of projects, newest first, with template, document count and latest job status.

    The page is cut first (top-k); documents and jobs are filtered by its ids before they are
    aggregated. Whether the ids are broadcast is left to the optimizer's size check.
    """
    page = projects.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    ids = page.select(F.col("id").alias("project_id"))
    n_docs = documents.join(ids, "project_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("document_count"))
    latest = jobs.join(ids, "project_id", "left_semi").groupBy("project_id").agg(
        F.max_by("status", F.struct("created_at", "id")).alias("latest_job_status"))
    df = _with_template(page, templates).join(n_docs.withColumnRenamed("project_id", "id"), "id", "left").join(
        latest.withColumnRenamed("project_id", "id"), "id", "left")
    return df.select(
        "id", "project_name", "project_code", "template_id", "template_name", "status", "created_at", "updated_at",
        F.coalesce("document_count", F.lit(0)).alias("document_count"), "latest_job_status")


def project_detail(projects: DataFrame, documents: DataFrame, jobs: DataFrame, templates: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Projects with nested documents and jobs, in bounded parts (part 0 always present)."""
    docs = nest(documents, ["project_id"], ["id"],
                ["id", "original_filename", "file_size", "page_count", "upload_status", "created_at"], "documents", part_size)
    runs = _with_template(jobs, templates).withColumnRenamed("template_id", "template_code")
    runs = nest(runs, ["project_id"], ["id"],
                ["id", "document_id", "template_code", "template_name", "status", "progress", "error_message", "created_at"], "extraction_jobs", part_size)
    key = ["project_id", "part_no"]
    heads = projects.select(F.col("id").alias("project_id"), F.lit(0).alias("part_no"))
    parts = heads.unionByName(docs.select(*key)).unionByName(runs.select(*key)).distinct()
    body = _with_template(projects.withColumnRenamed("id", "project_id"), templates)
    return body.join(parts, "project_id").join(docs, key, "left").join(runs, key, "left").select(
        "project_id", "part_no", "project_name", "project_code", "template_id", "template_name", "status",
        F.coalesce("documents", F.array()).alias("documents"), F.coalesce("extraction_jobs", F.array()).alias("extraction_jobs"))


def dashboard(projects: DataFrame, documents: DataFrame, fields: DataFrame, templates: DataFrame, now: Column) -> DataFrame:
    """One row of totals. ``now`` is a parameter; both windows are inclusive below, open above."""
    month, week = F.date_trunc("month", now), now - F.expr("interval 7 days")
    processed = F.col("upload_status") == "processed"
    parts = [
        projects.agg(F.count("*").alias("total_projects"), F.count_if(F.col("created_at") >= month).alias("projects_created_this_month")),
        documents.agg(F.count_if(processed).alias("documents_processed"),
                      F.count_if(processed & (F.col("created_at") >= week)).alias("documents_processed_this_week")),
        fields.agg(F.round(F.avg("confidence") * 100, 1).alias("extraction_accuracy"),
                   F.count_if(F.col("validation_status") == "pending").alias("pending_validation")),
        templates.agg(F.count_if(F.col("is_active")).alias("active_templates")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def delete_projects(ids: DataFrame, projects: DataFrame, documents: DataFrame, pages: DataFrame, jobs: DataFrame,
                    fields: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """What remains of every table once the projects ``ids(project_id)`` are gone, and the files to remove.

    Children are keyed by their parent's key, so each level is one anti-join; the tables are
    rewritten, never updated in place.
    """
    gone_jobs = jobs.join(ids, "project_id", "left_semi").select(F.col("id").alias("job_id"))
    gone_docs = documents.join(ids, "project_id", "left_semi")
    doc_ids = gone_docs.select(F.col("id").alias("document_id"))
    originals = gone_docs.where("original_filename <> ''").select(
        F.lit("original").alias("kind"), F.col("id").alias("document_id"), F.col("original_filename").alias("path"))
    images = gone_docs.select(F.lit("page_images").alias("kind"), F.col("id").alias("document_id"), F.col("id").cast("string").alias("path"))
    return {
        "projects": projects.join(ids.withColumnRenamed("project_id", "id"), "id", "left_anti"),
        "documents": documents.join(ids, "project_id", "left_anti"),
        "pages": pages.join(doc_ids, "document_id", "left_anti"),
        "jobs": jobs.join(ids, "project_id", "left_anti"),
        "fields": fields.join(gone_jobs, "job_id", "left_anti"),
        "references": references.join(gone_jobs, "job_id", "left_anti"),
        "files": originals.unionByName(images),
    }


def delete_jobs(ids: DataFrame, jobs: DataFrame, fields: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    return {
        "jobs": jobs.join(ids.withColumnRenamed("job_id", "id"), "id", "left_anti"),
        "fields": fields.join(ids, "job_id", "left_anti"),
        "references": references.join(ids, "job_id", "left_anti"),
    }


def project_documents(documents: DataFrame, project_id: int | None = None) -> DataFrame:
    """Documents of one project newest first; of all projects when no id is given (unsorted, ranked
    by the sort key columns for the reader)."""
    cols = ["id", "project_id", "original_filename", "file_size", "page_count", "upload_status", "created_at"]
    if project_id is None:
        return documents.select(*cols)
    return documents.where(F.col("project_id") == project_id).select(*cols).orderBy(F.desc("created_at"), F.desc("id"))


def recent_activity(listed: DataFrame, now: Column, n: int = 8) -> DataFrame:
    """First ``n`` listed projects with status label and relative time."""
    top = listed.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return top.select(
        "id", "project_name", "template_name", "document_count",
        L.project_status("latest_job_status", "document_count").alias("status_label"), L.time_ago("updated_at", now).alias("updated"))
