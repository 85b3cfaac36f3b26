"""R: projects, dashboard, cascade."""

from pyspark.sql import functions as F

from paperweft.operators import projects as R

from .derived import NOW
from .registry import query

_LIST = """listed AS (
    SELECT p.id, project_name, project_code, template_id, template_name, p.status, p.created_at, p.updated_at, coalesce(dc, 0) AS document_count, latest_job_status
    FROM (SELECT * FROM projects ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 20) p LEFT JOIN templates t USING (template_key)
    LEFT JOIN (SELECT project_id AS id, count(*) AS dc FROM project_documents GROUP BY 1) USING (id)
    LEFT JOIN (SELECT project_id AS id, arg_max(status, (created_at, id)) AS latest_job_status FROM jobs GROUP BY 1) USING (id))"""


def _listed(t):
    return R.project_list(t.projects, t.project_documents, t.jobs, t.templates, 100, 20)


@query("r1_project_list", f"WITH {_LIST} SELECT * FROM listed", "projects project_documents jobs templates")
def _(t):
    return _listed(t)


@query("r2_project_detail", """
  WITH d AS (SELECT project_id, part_no, string_agg(id || '/' || original_filename || '/' || upload_status, ',' ORDER BY id) AS documents
    FROM (SELECT *, (row_number() OVER (PARTITION BY project_id ORDER BY id) - 1) // 4 AS part_no FROM project_documents) GROUP BY 1, 2),
  j AS (SELECT project_id, part_no, string_agg(id || '/' || coalesce(template_id, '-') || '/' || status, ',' ORDER BY id) AS extraction_jobs
    FROM (SELECT j.*, template_id, (row_number() OVER (PARTITION BY j.project_id ORDER BY j.id) - 1) // 4 AS part_no FROM jobs j LEFT JOIN templates t USING (template_key)) GROUP BY 1, 2),
  parts AS (SELECT id AS project_id, 0 AS part_no FROM projects UNION SELECT project_id, part_no FROM d UNION SELECT project_id, part_no FROM j)
  SELECT p.id AS project_id, part_no::INTEGER AS part_no, project_name, template_id, coalesce(documents, '') AS documents, coalesce(extraction_jobs, '') AS extraction_jobs
  FROM projects p JOIN parts ON parts.project_id = p.id LEFT JOIN templates USING (template_key) LEFT JOIN d USING (project_id, part_no) LEFT JOIN j USING (project_id, part_no)""",
       "projects project_documents jobs templates")
def _(t):
    s = lambda c: c.cast("string")
    d = R.project_detail(t.projects, t.project_documents, t.jobs, t.templates, part_size=4)
    return d.select(
        "project_id", "part_no", "project_name", "template_id",
        F.array_join(F.transform("documents", lambda x: F.concat_ws("/", s(x["id"]), x["original_filename"], x["upload_status"])), ",").alias("documents"),
        F.array_join(F.transform("extraction_jobs", lambda x: F.concat_ws("/", s(x["id"]), F.coalesce(x["template_code"], F.lit("-")), x["status"])), ",").alias("extraction_jobs"))


@query("r3_dashboard", f"""
  SELECT (SELECT count(*) FROM projects) AS total_projects,
    (SELECT count(*) FROM projects WHERE created_at >= date_trunc('month', TIMESTAMP '{NOW}')) AS projects_created_this_month,
    (SELECT count(*) FROM project_documents WHERE upload_status = 'processed') AS documents_processed,
    (SELECT count(*) FROM project_documents WHERE upload_status = 'processed' AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS documents_processed_this_week,
    (SELECT round(avg(confidence) * 100, 1) FROM extracted_fields) AS extraction_accuracy,
    (SELECT count(*) FROM extracted_fields WHERE validation_status = 'pending') AS pending_validation,
    (SELECT count(*) FROM templates WHERE is_active) AS active_templates""", "projects project_documents extracted_fields templates")
def _(t):
    return R.dashboard(t.projects, t.project_documents, t.extracted_fields, t.templates, F.lit(NOW).cast("timestamp_ntz"))


_REST = """
  SELECT 'projects' AS kept, count(*) AS n, CAST(sum(id) AS BIGINT) AS s FROM projects WHERE id % 5 <> 2
  UNION ALL SELECT 'documents', count(*), CAST(sum(id) AS BIGINT) FROM project_documents WHERE project_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'pages', count(*), CAST(sum(doc_id + page_number) AS BIGINT) FROM document_pages WHERE doc_id NOT IN (SELECT id FROM project_documents WHERE project_id IN (SELECT id FROM gone))
  UNION ALL SELECT 'jobs', count(*), CAST(sum(id) AS BIGINT) FROM jobs WHERE project_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'fields', count(*), CAST(sum(job_id) AS BIGINT) FROM extracted_fields WHERE job_id NOT IN (SELECT id FROM jobs WHERE project_id IN (SELECT id FROM gone))
  UNION ALL SELECT 'references', count(*), CAST(sum(page_number) AS BIGINT) FROM extracted_fields WHERE job_id NOT IN (SELECT id FROM jobs WHERE project_id IN (SELECT id FROM gone))
  UNION ALL SELECT 'files', count(*) * 2, CAST(sum(id) * 2 AS BIGINT) FROM project_documents WHERE project_id IN (SELECT id FROM gone)"""


@query("r4_delete_projects", f"WITH gone AS (SELECT id FROM projects WHERE id % 5 = 2) {_REST}", "projects project_documents document_pages jobs extracted_fields")
def _(t):
    ids = t.projects.where("id % 5 = 2").selectExpr("id AS project_id")
    fields = t.extracted_fields
    refs = fields.select("job_id", "field_id", "page_number")
    rest = R.delete_projects(ids, t.projects, t.project_documents, t.document_pages.withColumnRenamed("doc_id", "document_id"), t.jobs, fields, refs)
    key = {"projects": "id", "documents": "id", "pages": "document_id + page_number", "jobs": "id", "fields": "job_id", "references": "page_number", "files": "document_id"}
    out = None
    for name, df in rest.items():
        part = df.agg(F.count("*").alias("n"), F.sum(F.expr(key[name]).cast("bigint")).alias("s")).select(F.lit(name).alias("kept"), "n", "s")
        out = part if out is None else out.unionByName(part)
    return out


@query("r5_delete_jobs", """
  SELECT job_id, field_id FROM extracted_fields WHERE job_id % 7 <> 3""", "extracted_fields")
def _(t):
    ids = t.jobs.where("id % 7 = 3").selectExpr("id AS job_id")
    f = t.extracted_fields.select("job_id", "field_id")
    return R.delete_jobs(ids, t.jobs, f, f)["fields"]


@query("r6_project_documents", """
  SELECT id, project_id, original_filename, file_size, page_count, upload_status, created_at FROM project_documents""", "project_documents")
def _(t):
    return R.project_documents(t.project_documents)


@query("r7_recent_activity", f"""WITH {_LIST}
  SELECT id, project_name, template_name, document_count, CASE latest_job_status WHEN 'completed' THEN 'Completed' WHEN 'processing' THEN 'Processing' WHEN 'failed' THEN 'Failed'
     WHEN 'pending' THEN 'Pending' ELSE CASE WHEN document_count > 0 THEN 'Awaiting Extraction' ELSE 'Draft' END END AS status_label,
     CASE WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN m // 60 || 'h ago' WHEN m // 1440 = 1 THEN 'Yesterday' WHEN m // 1440 < 7 THEN m // 1440 || 'd ago' ELSE strftime(updated_at, '%-m/%-d/%Y') END AS updated
  FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 60000000) AS BIGINT) AS m FROM listed ORDER BY created_at DESC, id DESC LIMIT 8)""",
       "projects project_documents jobs templates")
def _(t):
    listed = _listed(t).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    return R.recent_activity(listed, F.lit(NOW).cast("timestamp"))
