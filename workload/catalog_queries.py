"""C and S: template catalogue, sources, sinks."""

from pyspark.sql import functions as F

from paperweft.operators import catalog as C, extract as E, parts
from paperweft.operators.cut import written
from paperweft.sources import exports as SX, files as SF

from . import oracle as O
from .registry import query

q = O.q
_CUR_SECTIONS = "'old' || cast(template_key as string)"
_CUR_HTML = "CASE WHEN template_key % 2 = 0 THEN '[\"p\"]' ELSE '[]' END"
_INC_SECTIONS = "CASE WHEN template_key % 8 = 0 THEN 'old' || cast(template_key as string) ELSE 'new' || cast(template_key as string) END"
_INC_HTML = "CASE WHEN template_key % 24 = 9 THEN '[\"q\"]' ELSE '' END"
_INC_VERSION = "CASE WHEN template_key % 5 = 1 THEN '2.0' ELSE version END"


def _current(t):
    return t.templates.where("template_key % 4 <> 3").withColumn("file_name", F.lit("a.docx")).withColumn("schema", F.expr(
        f"map('sections', {_CUR_SECTIONS}, 'page_html', {_CUR_HTML}, 'note', 'n')"))


def _incoming(t):
    return t.templates.where("template_key % 4 <> 1").withColumns({"file_name": F.lit("a.docx"), "version": F.expr(_INC_VERSION)}).withColumn("schema", F.expr(
        f"map('sections', {_INC_SECTIONS}, 'page_html', {_INC_HTML})"))


_SYNC = f"""c AS (SELECT *, {_CUR_SECTIONS} AS s, {_CUR_HTML} AS h FROM templates WHERE template_key % 4 <> 3), n AS (SELECT *, {_INC_VERSION} AS v2, {_INC_SECTIONS} AS s, {_INC_HTML} AS h FROM templates WHERE template_key % 4 <> 1),
  synced AS (SELECT coalesce(c.template_id, n.template_id) AS template_id, CASE WHEN n.template_id IS NULL THEN c.version ELSE v2 END AS version,
    CASE WHEN c.template_id IS NULL THEN false ELSE c.is_active END AS is_active, CASE WHEN c.template_id IS NULL THEN 'pending' ELSE c.status END AS status,
    CASE WHEN n.template_id IS NULL THEN c.s WHEN c.template_id IS NULL AND NOT n.structure_locked AND n.template_key % 2 = 1 THEN 'inferred' ELSE n.s END AS sections,
    CASE WHEN n.template_id IS NULL THEN c.h WHEN c.template_id IS NULL THEN n.h WHEN n.h IN ('', '[]') AND c.h NOT IN ('', '[]') THEN c.h ELSE n.h END AS page_html,
    CASE WHEN c.template_id IS NOT NULL THEN 'n' END AS note,
    CASE WHEN c.template_id IS NULL THEN 'inserted' WHEN n.template_id IS NULL THEN 'absent' WHEN v2 = c.version AND n.s = c.s AND (CASE WHEN n.h IN ('', '[]') AND c.h NOT IN ('', '[]') THEN c.h ELSE n.h END) = c.h THEN 'unchanged' ELSE 'updated' END AS change
    FROM c FULL JOIN n ON c.template_id = n.template_id)"""


@query("c1_sync", f"WITH {_SYNC} SELECT * FROM synced", "templates")
def _(t):
    inferred = t.templates.where("template_key % 2 = 1").select("template_id", F.lit("inferred").alias("sections"))
    s = C.sync(_current(t), _incoming(t), inferred)
    get = lambda k: F.try_element_at("schema", F.lit(k)).alias(k)
    return s.select("template_id", "version", "is_active", "status", get("sections"), get("page_html"), get("note"), "change")


@query("c2_list_active", "SELECT template_id, template_name FROM templates WHERE is_active", "templates")
def _(t):
    return C.list_active(t.templates).select("template_id", "template_name")


@query("c2_list_pending", "SELECT template_id, template_name FROM templates WHERE status = 'pending'", "templates")
def _(t):
    return C.list_pending(t.templates.withColumn("created_at", F.col("template_key"))).select("template_id", "template_name")


@query("c3_template_stats", """SELECT t.template_id, count(DISTINCT section_pos) AS sections, count(field_pos) AS fields FROM templates t LEFT JOIN template_fields f USING (template_id) GROUP BY 1""",
       "templates template_fields")
def _(t):
    return C.template_stats(t.templates, t.template_fields)


_PLAN = """mine AS (SELECT j.id, j.template_key, p.project_name FROM jobs j LEFT JOIN projects p ON p.id = j.project_id WHERE j.template_key % 2 = 0)"""


@query("c4_delete_plan", f"""WITH {_PLAN}
  SELECT t.template_key, count(project_name) > 0 AS blocked, count(project_name) AS live_jobs, count(DISTINCT project_name) AS project_names,
    coalesce(string_agg(DISTINCT '"' || project_name || '"', ', ' ORDER BY '"' || project_name || '"'), '') AS projects
  FROM (SELECT template_key FROM templates WHERE template_key % 2 = 0) t LEFT JOIN mine USING (template_key) GROUP BY 1""", "jobs projects templates")
def _(t):
    return C.delete_plan(t.templates.where("template_key % 2 = 0").select("template_key"), t.jobs, t.projects)[0]


@query("c4_projects_in_use", f"WITH {_PLAN} SELECT DISTINCT template_key, project_name FROM mine WHERE project_name IS NOT NULL", "jobs projects")
def _(t):
    return C.delete_plan(t.templates.where("template_key % 2 = 0").select("template_key"), t.jobs, t.projects)[1]


@query("c4_delete_forced", f"WITH {_PLAN} SELECT id AS job_id, template_key FROM mine", "jobs projects")
def _(t):
    return C.delete_plan(t.templates.where("template_key % 2 = 0").select("template_key"), t.jobs, t.projects, force=True)[2]


_NAMES = "CASE WHEN p_partkey % 5 = 0 THEN p_name || ' ' || cast(p_partkey % 3 + 1 as string) WHEN p_partkey % 5 = 1 THEN upper(p_name) ELSE p_name || ' ' || p_brand || ' ' || cast(p_partkey as string) END"


@query("c5_unique_ids", f"""
  WITH asked AS (SELECT p_partkey AS seq, {O.slug(_NAMES, 'template')} AS base FROM part), roots AS (SELECT *, regexp_replace(base, '(_[0-9]+)+$', '') AS root FROM asked),
  taken AS (SELECT DISTINCT regexp_replace(lower(p_name), ' ', '_', 'g') AS id FROM part WHERE p_partkey % 7 = 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seq) AS k FROM roots),
  f AS (SELECT root, 0::BIGINT AS k, coalesce((SELECT list(id) FROM taken WHERE regexp_replace(id, '(_[0-9]+)+$', '') = root), []) AS used, NULL::BIGINT AS seq, NULL::VARCHAR AS id FROM (SELECT DISTINCT root FROM roots)
    UNION ALL SELECT root, k, list_append(used, nid), seq, nid FROM (SELECT o.root, o.k, o.seq, f.used, CASE WHEN NOT list_contains(f.used, base) THEN base ELSE base || '_' || list_filter(range(2, len(f.used) + 3), lambda n: NOT list_contains(f.used, base || '_' || n))[1] END AS nid
      FROM f JOIN o ON o.root = f.root AND o.k = f.k + 1))
  SELECT seq, id AS template_id FROM f WHERE k > 0""")
def _(t):
    new = t.part.select(F.col("p_partkey").alias("seq"), F.expr(_NAMES).alias("name"))
    existing = t.part.where("p_partkey % 7 = 0").select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("template_id")).distinct()
    return C.unique_ids(new, existing)


@query("c6_approve", """SELECT template_id, CASE WHEN template_key % 11 > 0 THEN true ELSE is_active END AS is_active, CASE WHEN template_key % 11 > 0 THEN 'active' ELSE status END AS status,
  CASE WHEN template_key % 11 = 0 THEN 'Add at least one field before approving this template' END AS error FROM templates WHERE status = 'pending'""", "templates")
def _(t):
    return C.approve(t.templates, t.template_fields).drop("approved_id")


@query("c6_approved_ids", """
  WITH p AS (SELECT template_id, template_key % 11 > 0 AS ok, template_key % 3 = 0 AS disk, 'spec_' || template_key % 7 AS base FROM templates WHERE status = 'pending'),
  r AS (SELECT template_id, base, row_number() OVER (PARTITION BY base ORDER BY template_id) + CASE WHEN base = 'spec_1' THEN 1 ELSE 0 END AS n FROM p WHERE ok AND NOT disk)
  SELECT template_id, CASE WHEN ok THEN coalesce(CASE WHEN n > 1 THEN r.base || '_' || n ELSE r.base END, template_id) END AS approved_id FROM p LEFT JOIN r USING (template_id)""", "templates")
def _(t):
    """Every third template has a folder; one of the names is taken by another template."""
    pending = t.templates.withColumn("template_name", F.concat(F.lit("Spec - "), (F.col("template_key") % 7).cast("string")))
    ids = t.templates.select("template_id").union(t.templates.limit(1).select(F.lit("spec_1").alias("template_id")))
    return C.approve(pending, t.template_fields, t.templates.where("template_key % 3 = 0"), ids).select("template_id", "approved_id")


@query("c7_finalize", f"""SELECT template_id, CASE WHEN template_key % 3 = 0 THEN '' ELSE 'final' END AS note, CASE WHEN template_key % 2 = 0 THEN 'final' ELSE {_CUR_SECTIONS} END AS sections, template_key % 9 AS pages_validated,
  template_key % 7 AS fields_extracted, template_key / 100 AS confidence_average FROM templates WHERE template_key % 4 <> 3""", "templates")
def _(t):
    final = t.templates.withColumn("schema", F.expr("map('note', CASE WHEN template_key % 3 = 0 THEN '' ELSE 'final' END, 'sections', CASE WHEN template_key % 2 = 0 THEN 'final' ELSE '[]' END)"))
    summary = t.templates.selectExpr("template_id", "template_key % 9 AS pages_validated", "template_key % 7 AS fields_extracted", "template_key / 100 AS confidence_average")
    get = lambda k: F.try_element_at("schema", F.lit(k)).alias(k)
    return C.finalize(_current(t), final, summary).select("template_id", get("note"), get("sections"), "pages_validated", "fields_extracted", "confidence_average")


# static blocks of the block table: every block, paragraph index = position
_ST = "(SELECT doc_id, 'static_' || (block_seq + 1) AS block_id, CASE WHEN block_type = 'table' THEN 'table' ELSE 'paragraph' END AS block_type, text, CASE WHEN block_type <> 'table' THEN block_seq END AS paragraph_index, CAST(block_seq // 5 + 1 AS INTEGER) AS page_number, text = '' AS looks_like_blank_field, block_seq FROM blocks)"


def _static(t):
    return t.blocks.select(
        "doc_id", F.concat(F.lit("static_"), (F.col("block_seq") + 1).cast("string")).alias("block_id"),
        F.when(F.col("block_type") == "table", "table").otherwise("paragraph").alias("block_type"), "text",
        F.when(F.col("block_type") != "table", F.col("block_seq")).alias("paragraph_index"),
        (F.floor(F.col("block_seq") / 5) + 1).cast("int").alias("page_number"), (F.col("text") == "").alias("looks_like_blank_field"), "block_seq")


@query("c8_apply_edits", f"""
  SELECT doc_id, block_id, CASE WHEN block_type = 'table' THEN text WHEN block_seq % 3 = 0 THEN 'edited ' || text ELSE text END AS text, block_type <> 'table' AND block_seq % 3 = 0 AND paragraph_index < 30 AS applied
  FROM {_ST} WHERE block_seq % 6 <> 5""", "blocks")
def _(t):
    s = _static(t)
    edits = s.where("block_seq % 6 <> 5").select("doc_id", "block_id", F.when(F.col("block_seq") % 3 == 0, F.concat(F.lit("edited "), "text")).otherwise(F.col("text")).alias("text"))
    return C.apply_edits(s, edits, t.blocks.select("doc_id").distinct().withColumn("n", F.lit(30)))


@query("c9_promote", f"""
  SELECT doc_id, block_id, 'promoted_fields' AS section_id, CASE WHEN t <> '' THEN t ELSE 'Field (page ' || page_number || ')' END AS field_label, page_number,
    CASE WHEN t <> '' THEN 'This was static text in the source document ("' || left(t, 80) || '") - promoted to a dynamic field during template review.' ELSE 'Blank in the source document (page ' || page_number || ') - promoted to a dynamic field during template review; fill it in per-project.' END AS extraction_hint
  FROM (SELECT *, {O.strip('text')} AS t FROM {_ST}) WHERE block_seq % 4 = 1 OR block_seq = 20""", "blocks")
def _(t):
    s = _static(t)
    return C.promote(s, s.where("block_seq % 4 = 1 or block_seq = 20").select("doc_id", "block_id"))[0]


@query("c10_clean_fields", f"""
  SELECT doc_id, block_seq, coalesce(nullif(CASE WHEN block_seq % 2 = 0 THEN 'f' || block_seq ELSE '' END, ''), regexp_replace(lower({O.strip('text')}), '[^a-z0-9]+', '_', 'g')) AS field_id FROM blocks WHERE {O.strip('text')} <> ''""", "blocks")
def _(t):
    f = t.blocks.select("doc_id", "block_seq", F.col("text").alias("field_label"), F.when(F.col("block_seq") % 2 == 0, F.concat(F.lit("f"), F.col("block_seq").cast("string"))).otherwise(" ").alias("field_id"))
    return C.clean_fields(f).drop("field_label")


@query("c11_list_static", f"SELECT doc_id, block_id, CAST(CASE WHEN looks_like_blank_field THEN 0 ELSE 1 END AS INTEGER) AS rank FROM {_ST} WHERE page_number = 5", "blocks")
def _(t):
    return C.list_static(_static(t), 5).select("doc_id", "block_id", "rank")


@query("c12_retire", "SELECT template_key, CASE WHEN template_key % 10 = 3 THEN template_id || '_legacy_20010801T000000' ELSE template_id END AS template_id FROM templates", "templates")
def _(t):
    return C.retire(t.templates, t.templates.where("template_key % 10 = 3").select("template_id"), "20010801T000000").select("template_key", "template_id")


_FB = """fb AS (SELECT template_id, coalesce(page_number, section_page) AS page_number, field_id, CASE WHEN template_key % 5 = field_pos THEN '' ELSE coalesce(CASE WHEN template_key % 3 = 0 THEN 'fixed ' || field_id END, default_value, '') END AS correction,
    template_key % 5 <> field_pos AND template_key % 2 = 0 AS approved FROM template_fields WHERE coalesce(page_number, section_page) IS NOT NULL)"""


def _feedback(t):
    from paperweft.operators.match import fields_by_page

    f = fields_by_page(t.template_fields)
    actions = f.select("template_id", "field_id", F.when(F.col("template_key") % 3 == 0, F.concat(F.lit("fixed "), "field_id")).alias("correction"),
                       (F.col("template_key") % 2 == 0).alias("approved"), (F.col("template_key") % 5 == F.col("field_pos")).alias("removed"))
    return C.page_feedback(f.select("template_id", "page_number", "field_id", F.col("default_value").alias("value")), actions)


@query("c13_page_feedback", f"WITH {_FB} SELECT * FROM fb", "template_fields")
def _(t):
    return _feedback(t)


@query("c13_feedback_per_page", f"""WITH {_FB} SELECT template_id, page_number, string_agg(field_id || '=' || correction, ',' ORDER BY field_id) AS corrections, coalesce(string_agg(field_id, ',' ORDER BY field_id) FILTER (WHERE approved), '') AS approved_fields
  FROM fb GROUP BY 1, 2""", "template_fields")
def _(t):
    return C.feedback_per_page(_feedback(t)).select(
        "template_id", "page_number", F.array_join(F.transform(F.map_entries("corrections"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("corrections"),
        F.array_join("approved_fields", ",").alias("approved_fields"))


# --- sources and sinks -------------------------------------------------------------------------------------

_FILE = """CASE p_partkey % 9 WHEN 0 THEN 'not json' WHEN 1 THEN '[1]' WHEN 2 THEN '{"version":"3"}' WHEN 3 THEN '{"template_id":7}'
  ELSE '{"template_id":"S' || cast(floor(p_partkey / 3) as bigint) || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"version":"2.0","template_name":"' || p_name || '"' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ',"structure_locked":true,"is_active":false' ELSE '' END || '}' END"""


@query("s1_read_templates", f"""
  WITH x AS (SELECT 'd' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path, {_FILE} AS c FROM part), y AS (SELECT path, c FROM x WHERE json_valid(c)),
  z AS (SELECT path, c FROM y WHERE json_type(c) = 'OBJECT' AND json_type(c, '$.template_id') = 'VARCHAR')
  SELECT json_extract_string(c, '$.template_id') AS template_id, path, coalesce(json_extract_string(c, '$.version'), '1.0') AS version, coalesce(json_extract_string(c, '$.template_name'), json_extract_string(c, '$.template_id')) AS template_name,
    coalesce(CAST(json_extract_string(c, '$.is_active') AS BOOLEAN), true) AS is_active, coalesce(CAST(json_extract_string(c, '$.structure_locked') AS BOOLEAN), false) AS structure_locked
  FROM z QUALIFY row_number() OVER (PARTITION BY json_extract_string(c, '$.template_id') ORDER BY path) = 1""")
def _(t):
    files = t.part.select(F.concat(F.lit("d"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"), F.expr(_FILE).alias("content"))
    return SF.parse_templates(files).select("template_id", "path", "version", "template_name", "is_active", "structure_locked")


@query("s2_intake", """
  WITH x AS (SELECT id, original_filename AS n, lower(regexp_extract(original_filename, '.[.]([^.]*)$', 1)) AS e, file_size * CASE WHEN id % 50 = 0 THEN 3 ELSE 1 END AS size FROM project_documents),
  y AS (SELECT *, CASE WHEN e NOT IN ('pdf', 'docx', 'doc', 'png', 'jpg', 'jpeg', 'tiff', 'bmp') THEN 'Unsupported file type' WHEN size > 524288000 THEN 'File too large' END AS r FROM x)
  SELECT id, n AS original_filename, e AS file_type, size, r AS reject_reason, CASE WHEN r IS NULL THEN 'uploaded' END AS upload_status FROM y""", "project_documents")
def _(t):
    files = t.project_documents.select("id", F.concat(F.lit("/in/"), "original_filename").alias("path"), (F.col("file_size") * F.when(F.col("id") % 50 == 0, 3).otherwise(1)).alias("size"))
    return SF.intake(files).drop("path")


@query("s3_pages_of", """
  SELECT doc_id AS document_id, page_number, text, page_number % 2 = 0 AS has_image, page_count AS total_pages FROM document_pages JOIN project_documents d ON d.id = doc_id WHERE page_number <= page_count""",
       "document_pages project_documents")
def _(t):
    pages = t.document_pages.withColumnRenamed("doc_id", "document_id").withColumn("image_path", F.when(F.col("page_number") % 2 == 0, "p.png").otherwise(""))
    return SF.pages_of(t.project_documents, pages)


def _results(t):
    f = written(t.extracted_fields)  # fields and references both read it
    return E.job_results(t.jobs.withColumnRenamed("id", "job_id"), f.drop("page_number", "source_text"), f.select("job_id", "field_id", "page_number", "source_text"), t.templates, part_size=4)


@query("s4_export_jobs", """
  SELECT j.id AS job_id, coalesce(part, 0)::INTEGER AS part_no, original_filename AS document_filename, template_id, coalesce(n, 0) AS n_fields, coalesce(vs, '') AS values_ FROM jobs j LEFT JOIN project_documents d ON d.id = j.document_id LEFT JOIN templates USING (template_key)
  LEFT JOIN (SELECT job_id, part, count(*) AS n, string_agg(coalesce(value, '-'), ',' ORDER BY field_id) AS vs
    FROM (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY field_id) - 1) // 4 AS part FROM extracted_fields) GROUP BY 1, 2) f ON f.job_id = j.id WHERE j.status = 'completed'""",
       "jobs project_documents templates extracted_fields")
def _(t):
    x = SX.export_jobs(_results(t), t.project_documents)
    # read the JSON back, so that the exported text itself is compared
    doc = F.from_json("json", "document_filename string, template_id string, fields array<struct<field_id:string,value:string>>")
    return x.select("job_id", "part_no", doc.alias("d")).select(
        "job_id", "part_no", "d.document_filename", "d.template_id", F.size("d.fields").alias("n_fields"),
        F.array_join(F.transform("d.fields", lambda f: F.coalesce(f["value"], F.lit("-"))), ",").alias("values_"))


@query("s5_export_flat", """
  SELECT job_id, field_label AS field, coalesce(nullif(value, ''), '—') AS value, validation_status AS status, coalesce(CASE WHEN page_number % 5 > 0 THEN CAST(page_number AS VARCHAR) END, '—') AS source_page FROM extracted_fields""", "extracted_fields")
def _(t):
    f = t.extracted_fields
    refs = f.where("page_number % 5 > 0").select("job_id", "field_id", "page_number", F.lit(1).alias("reference_id"))
    return SX.export_flat(f, refs)


@query("s6_export_documents", """
  SELECT conv_id AS doc_id, part::INTEGER AS part_no, 'Conversation ' || conv_id AS title, count(*) AS n_sections, string_agg(role, ',' ORDER BY turn) AS names, CAST(sum(length(text)) AS BIGINT) AS n_chars
  FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS part FROM conversations) GROUP BY conv_id, part""")
def _(t):
    c = t.conversations.withColumnRenamed("conv_id", "doc_id")
    docs = c.select("doc_id").distinct().select("doc_id", F.concat(F.lit("Conversation "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("subtitle"),
                                               F.create_map(F.lit("spec_no"), F.lit("1")).alias("project_meta"))
    sections = parts.with_parts(c.select("doc_id", F.col("turn").alias("section_no"), F.col("role").alias("section_name"), F.col("text").alias("content")), ["doc_id"], ["section_no"], 3)
    doc = F.from_json("json", "title string, sections array<struct<section_number:string,section_name:string,content:string>>")
    return SX.export_documents(docs, sections).select("doc_id", "part_no", doc.alias("d")).select(
        "doc_id", "part_no", "d.title", F.size("d.sections").alias("n_sections"), F.array_join("d.sections.section_name", ",").alias("names"),
        F.aggregate("d.sections", F.lit(0).cast("bigint"), lambda n, s: n + F.length(s["content"])).alias("n_chars"))


@query("s7_static_urls", "SELECT id, '/static/pages/' || id || '.png' AS url FROM project_documents WHERE id % 3 > 0", "project_documents")
def _(t):
    paths = t.project_documents.select("id", F.concat(F.when(F.col("id") % 3 > 0, "/data/store/pages/").otherwise("/data/storeroom/"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    return SF.static_urls(paths, "/data/store").drop("path")


@query("s8_changed_files", """
  SELECT template_id AS directory, CASE WHEN template_key % 5 = 0 THEN 'added' WHEN template_key % 5 = 1 THEN 'removed' ELSE 'modified' END AS change FROM templates WHERE template_key % 5 < 3""", "templates")
def _(t):
    new = t.templates.where("template_key % 5 <> 1").selectExpr("template_id AS directory", "template_key AS modified")
    old = t.templates.where("template_key % 5 <> 0").selectExpr("template_id AS directory", "CASE WHEN template_key % 5 = 2 THEN template_key - 1 ELSE template_key END AS modified")
    return SF.changed_files(new, old)


@query("s9_migrate", "SELECT job_id, field_id, value, value AS original_value, true AS is_dynamic, CAST(NULL AS VARCHAR) AS verification_status FROM extracted_fields", "extracted_fields")
def _(t):
    return SF.migrate(t.extracted_fields.select("job_id", "field_id", "value"), {
        "verification_status": ("string", None), "original_value": ("string", None), "is_dynamic": ("boolean", True)}, {"original_value": "value"})
