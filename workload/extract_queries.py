"""E: extraction results."""

from pyspark.sql import functions as F

from paperweft.operators import extract as E
from paperweft.operators.cut import written

from . import oracle as O
from .registry import query

q = O.q


def _jobs(t):
    return t.jobs.selectExpr("id AS job_id", "template_key", "document_id")


@query("e1_chunk_pages", """
  SELECT doc_id, page_number, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1) // 5 + 1 AS INTEGER) AS chunk_no FROM document_pages""",
       "document_pages")
def _(t):
    return E.chunk_pages(t.document_pages).select("doc_id", "page_number", "chunk_no")


@query("e2_batch_fields", """
  SELECT template_id, section_pos, field_pos, CAST((row_number() OVER (PARTITION BY template_id, section_pos ORDER BY field_pos) - 1) // 2 + 1 AS INTEGER) AS batch_no
  FROM template_fields""", "template_fields")
def _(t):
    return E.batch_fields(t.template_fields, 2).select("template_id", "section_pos", "field_pos", "batch_no")


_TRUNC = lambda c, n: f"CASE WHEN length({c}) > {n} THEN rtrim(left({c}, {n}), {O.WSC}) || chr(10) || '...[truncated]' ELSE {c} END"
_RULES = "[" + ", ".join(q(x) for x in E.PROMPT_RULES) + "]"
_E3 = f"""
  WITH batches AS (SELECT *, (row_number() OVER (PARTITION BY template_id, section_pos ORDER BY field_pos) - 1) // 12 + 1 AS batch_no FROM template_fields),
  heads AS (SELECT template_id, section_pos, batch_no, count(*) AS n_fields,
      list_concat({_RULES}, ['TEMPLATE_ID: ' || template_id, 'TEMPLATE_VERSION: ' || any_value(version), 'FIELDS TO EXTRACT:', 'SECTION: ' || any_value(section_name)],
        list('- field_id=' || field_id || ' label="' || field_label || '" hint="' || coalesce(extraction_hint, '') || '"' ORDER BY field_pos)) AS head,
      any_value(description) AS ref FROM batches JOIN (SELECT template_id, version, description FROM templates) USING (template_id) GROUP BY template_id, section_pos, batch_no),
  heads2 AS (SELECT template_id, section_pos, batch_no, n_fields,
      list_concat(head, CASE WHEN coalesce(ref, '') <> '' THEN [chr(10) || 'REFERENCE TEMPLATE:' || chr(10) || {_TRUNC('ref', 250)}] ELSE [] END, [chr(10) || 'DOCUMENT TEXT:']) AS head FROM heads),
  heads3 AS (SELECT *, list_sum(list_transform(head, lambda x: length(x))) AS len FROM heads2),
  chunks AS (SELECT doc_id, 'T' || (doc_id % 10) AS template_id, page_number, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1) // 5 + 1 AS chunk_no,
      '--- PAGE ' || page_number || ' ---' || chr(10) || {_TRUNC('text', 2000)} AS block FROM document_pages),
  used AS (SELECT c.*, h.* EXCLUDE (template_id), h.len + sum(length(block)) OVER (PARTITION BY doc_id, chunk_no, section_pos, batch_no ORDER BY page_number) AS total
      FROM chunks c JOIN heads3 h USING (template_id))
  SELECT doc_id, template_id, CAST(chunk_no AS INTEGER) AS chunk_no, section_pos, CAST(batch_no AS INTEGER) AS batch_no, CAST(greatest(512, least(4096, 150 + 160 * any_value(n_fields))) AS INTEGER) AS output_tokens,
    left(array_to_string(list_concat(any_value(head), coalesce(list(block ORDER BY page_number) FILTER (WHERE total <= 12000), []), [{q(E.PROMPT_END)}]), chr(10)), 12000) AS prompt
  FROM used GROUP BY doc_id, template_id, chunk_no, section_pos, batch_no"""


@query("e3_prompts", _E3, "document_pages template_fields templates")
def _(t):
    chunks = E.chunk_pages(t.document_pages.withColumn("template_id", F.concat(F.lit("T"), (F.col("doc_id") % 10).cast("string"))))
    return E.prompts(chunks, E.batch_fields(t.template_fields), t.templates.selectExpr("template_id", "version", "description AS reference_text"))


@query("e4_validation_prompts", f"""
  WITH pg AS (SELECT doc_id, 'T' || (doc_id % 10) AS template_id, page_number, text FROM document_pages WHERE doc_id < 50),
  f AS (SELECT template_id, coalesce(page_number, section_page) AS page_number, list('- ' || field_label || ' (type: ' || data_type || ') ' || coalesce(extraction_hint, '') ORDER BY section_pos, field_pos) AS fs
        FROM template_fields WHERE coalesce(page_number, section_page) IS NOT NULL GROUP BY ALL)
  SELECT doc_id, pg.page_number, array_to_string(list_concat([{q(E.VALIDATION_RULES[0])}, 'This is page ' || pg.page_number || ' of the document.', '', 'FIELDS TO EXTRACT AND VALIDATE:'],
    coalesce(fs, []), ['', 'DOCUMENT TEXT:', text], [{', '.join(q(x) for x in E.VALIDATION_STEPS)}]), chr(10)) AS prompt
  FROM (SELECT doc_id, template_id, page_number, text FROM (SELECT doc_id, 'T' || (doc_id % 10) AS template_id, page_number, text FROM document_pages)) pg LEFT JOIN f USING (template_id, page_number)""",
       "document_pages template_fields")
def _(t):
    from paperweft.operators.match import fields_by_page

    pages = t.document_pages.withColumn("template_id", F.concat(F.lit("T"), (F.col("doc_id") % 10).cast("string")))
    fields = fields_by_page(t.template_fields)
    # the page key here is (doc_id, page_number); prompts are built per page row
    out = E.validation_prompts(pages, fields, ["doc_id"])
    return out.select("doc_id", "page_number", "prompt")


_PARSE = """parsed AS (SELECT *, CASE WHEN NOT json_valid(response) THEN CASE WHEN done_reason = 'length' THEN 'truncated' ELSE 'invalid_json' END
      WHEN json_type(response) <> 'OBJECT' OR NOT json_exists(response, '$.fields') THEN 'missing_fields'
      WHEN json_type(response, '$.fields') <> 'ARRAY' THEN 'fields_not_list' END AS error FROM responses),
  items AS (SELECT job_id, chunk_no, batch_no, unnest(fs) AS item, unnest(range(0, len(fs)))::INTEGER AS pos FROM (
     SELECT *, CAST(json_extract(response, '$.fields') AS JSON[]) AS fs FROM parsed WHERE error IS NULL)),
  out_fields AS (SELECT job_id, chunk_no, batch_no, pos, json_extract_string(item, '$.field_id') AS field_id, json_extract_string(item, '$.value') AS value,
     CAST(json_extract_string(item, '$.confidence') AS DOUBLE) AS confidence, CAST(json_extract_string(item, '$.source.page_number') AS INTEGER) AS page_number FROM items)"""
_KEYS = ["job_id", "chunk_no", "batch_no"]


@query("e5_parse_output", f"WITH {_PARSE} SELECT job_id, chunk_no, batch_no, error FROM parsed", "responses")
def _(t):
    return E.parse_output(t.responses).select(*_KEYS, "error")


@query("e5_output_fields", f"WITH {_PARSE} SELECT * FROM out_fields", "responses")
def _(t):
    return E.output_fields(E.parse_output(t.responses), _KEYS).select(*_KEYS, "pos", "field_id", "value", "confidence", "page_number")


@query("e6_known_fields", f"""WITH {_PARSE} SELECT job_id, chunk_no, batch_no, field_id, value FROM out_fields
  WHERE field_id IN (SELECT field_id FROM template_fields WHERE template_id = 'T1')""", "responses template_fields")
def _(t):
    f = E.output_fields(E.parse_output(t.responses), _KEYS).withColumn("template_id", F.lit("T1"))
    return E.known_fields(f, t.template_fields, ["template_id"]).select(*_KEYS, "field_id", "value")


@query("e7_combine_batches", f"""WITH {_PARSE}
  SELECT job_id, chunk_no, count(*) AS batches, CAST(count(error) AS INTEGER) AS n_failed,
         coalesce(string_agg(batch_no || ': ' || error, '; ' ORDER BY batch_no) FILTER (WHERE error IS NOT NULL), '') AS failed_batches FROM parsed GROUP BY 1, 2""", "responses")
def _(t):
    return E.combine_batches(E.parse_output(t.responses), ["job_id", "chunk_no"])


_NOTES = "(SELECT conv_id AS id, turn, role || ' value: ' || replace(text, '. ', chr(10) || 'Found: ') AS text FROM conversations)"


def _notes(t):
    return t.conversations.select(F.col("conv_id").alias("id"), "turn", F.concat(
        "role", F.lit(" value: "), F.replace("text", F.lit(". "), F.lit("\nFound: "))).alias("text"))


@query("e8_suggestions", f"""
  SELECT id, turn, line_no, {O.strip("split_part(line, ':', 1)")} AS field, {O.strip("substr(line, strpos(line, ':') + 1)")} AS value
  FROM (SELECT id, turn, unnest(ls) AS line, unnest(range(0, len(ls)))::INTEGER AS line_no FROM (SELECT id, turn, string_split(text, chr(10)) AS ls FROM {_NOTES}))
  WHERE contains(line, ':') AND (contains(lower(line), 'extract') OR contains(lower(line), 'found') OR contains(lower(line), 'value'))""")
def _(t):
    return E.suggestions(_notes(t))


_SCORE = r"(\w+(?:\s+\w+)*?)[\s:]+(\d+(?:\.\d+)?)\s*%?"


@query("e9_confidence_scores", f"""
  WITH m AS (SELECT p_partkey, unnest(regexp_extract_all(t, {q(_SCORE)}, 1)) AS field, unnest(regexp_extract_all(t, {q(_SCORE)}, 2)) AS x, unnest(range(0, len(regexp_extract_all(t, {q(_SCORE)}, 1)))) AS pos
     FROM (SELECT p_partkey, p_name || ' confidence: ' || p_size || '%, brand 0.' || p_size || ' and ' || p_type || ': ' || p_retailprice || ' ' || p_name || ' confidence ' || (p_size + 1) AS t FROM part))
  SELECT p_partkey, {O.strip('field')} AS field, arg_max(least(1.0::DOUBLE, CASE WHEN CAST(x AS DOUBLE) > 1 THEN CAST(x AS DOUBLE) / 100 ELSE CAST(x AS DOUBLE) END), pos) AS score FROM m GROUP BY 1, 2""")
def _(t):
    text = F.expr("""p_name || ' confidence: ' || cast(p_size as string) || '%, brand 0.' || cast(p_size as string) || ' and ' || p_type || ': '
                     || cast(p_retailprice as string) || ' ' || p_name || ' confidence ' || cast(p_size + 1 as string)""")
    return E.confidence_scores(t.part.select("p_partkey", text.alias("text")), ["p_partkey"])


_HEADERS = """headers AS (SELECT DISTINCT job_id, chunk_no, 'T' || (job_id % 10) AS expected_id, '1.0' AS expected_version,
      CASE WHEN chunk_no = 5 THEN 'T99' ELSE 'T' || (job_id % 10) END AS template_id, CASE WHEN job_id % 50 = 7 THEN '0.9' ELSE '1.0' END AS template_version FROM responses),
  flds AS (SELECT job_id, chunk_no, CAST(batch_no * 10 + pos AS INTEGER) AS pos, field_id, value, confidence, page_number FROM out_fields WHERE field_id <> 'scope_label' OR job_id % 3 = 0),
  checked AS (SELECT f.*, h.expected_id, tf.field_label AS label, row_number() OVER (PARTITION BY f.job_id, f.chunk_no, f.field_id ORDER BY f.pos) AS nth
      FROM flds f JOIN headers h USING (job_id, chunk_no) LEFT JOIN template_fields tf ON tf.template_id = h.expected_id AND tf.field_id = f.field_id),
  worst AS (SELECT job_id, chunk_no, arg_min(CASE WHEN label IS NULL THEN 'Unknown field: ' || field_id ELSE 'Duplicate field: ' || field_id END, pos) AS p FROM checked WHERE label IS NULL OR nth > 1 GROUP BY 1, 2),
  judged AS (SELECT h.job_id, h.chunk_no, h.expected_id, CASE WHEN template_id <> expected_id THEN 'Template ID mismatch' WHEN template_version <> expected_version THEN 'Template version mismatch' ELSE p END AS error
      FROM headers h LEFT JOIN worst USING (job_id, chunk_no))"""


def _validated(t):
    parsed = E.parse_output(t.responses)
    fields = E.output_fields(parsed, _KEYS).where("field_id <> 'scope_label' or job_id % 3 = 0")
    fields = fields.withColumn("pos", (F.col("batch_no") * 10 + F.col("pos")).cast("int")).drop("batch_no")
    own = F.concat(F.lit("T"), (F.col("job_id") % 10).cast("string"))
    headers = t.responses.select(
        "job_id", "chunk_no", own.alias("expected_id"), F.lit("1.0").alias("expected_version"),
        F.when(F.col("chunk_no") == 5, "T99").otherwise(own).alias("template_id"),
        F.when(F.col("job_id") % 50 == 7, "0.9").otherwise("1.0").alias("template_version")).distinct()
    return E.validate_output(headers, fields, t.template_fields, ["job_id", "chunk_no"])


@query("e10_validate_errors", f"WITH {_PARSE}, {_HEADERS} SELECT job_id, chunk_no, error FROM judged WHERE error IS NOT NULL", "responses template_fields")
def _(t):
    return _validated(t)[1]


@query("e10_validate_accepted", f"""WITH {_PARSE}, {_HEADERS}
  SELECT j.job_id, j.chunk_no, tf.field_id, tf.field_label AS field_name, f.value, CASE WHEN f.field_id IS NULL THEN 0.0 ELSE f.confidence END AS confidence, f.page_number
  FROM judged j JOIN template_fields tf ON tf.template_id = j.expected_id LEFT JOIN flds f ON f.job_id = j.job_id AND f.chunk_no = j.chunk_no AND f.field_id = tf.field_id WHERE error IS NULL""",
       "responses template_fields")
def _(t):
    return _validated(t)[0].drop("source_text")


@query("e11_merge_chunks", "SELECT job_id, field_id, value, confidence, page_number FROM extracted_fields", "extracted_fields")
def _(t):
    return E.merge_chunks(t.chunk_fields).select("job_id", "field_id", "value", "confidence", "page_number")


_CHUNKS = """chunks AS (SELECT job_id, chunk_no, min(page_number) AS first_page, max(page_number) AS last_page, min(tie) % 5 > 0 OR job_id % 2 = 0 AS done,
    CASE WHEN (min(tie) % 5 > 0 OR job_id % 2 = 0) AND max(tie) % 3 = 0 THEN 'timed out' END AS error FROM chunk_fields WHERE job_id % 11 > 0 GROUP BY job_id, chunk_no)"""


@query("e12_job_status", f"""WITH {_CHUNKS},
  a AS (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE done) AS d, count(error) AS f,
       string_agg('pages ' || first_page || '-' || last_page || ': ' || error, '; ' ORDER BY chunk_no) FILTER (WHERE error IS NOT NULL) AS m FROM chunks GROUP BY 1)
  SELECT j.id AS job_id, CASE WHEN total IS NULL THEN 'failed' WHEN d < total THEN 'processing' WHEN f = total THEN 'failed' ELSE 'completed' END AS status,
    CAST(CASE WHEN total IS NULL THEN 0 WHEN d = total AND f < total THEN 100 ELSE least(99, floor(d / total * 100)) END AS INTEGER) AS progress,
    CASE WHEN total IS NULL THEN 'No document pages available' WHEN d = total AND f = total THEN 'Extraction failed for every page chunk: ' || m
      WHEN d = total AND f > 0 THEN 'Completed with ' || f || '/' || total || ' page chunk(s) unresolved after retries (fields from those pages need manual entry): ' || m END AS error_message
  FROM jobs j LEFT JOIN a ON a.job_id = j.id""", "chunk_fields jobs")
def _(t):
    done = F.expr("min(tie) % 5 > 0 or job_id % 2 = 0")
    chunks = t.chunk_fields.where("job_id % 11 > 0").groupBy("job_id", "chunk_no").agg(
        F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.min("tie").alias("lo"), F.max("tie").alias("hi"))
    done = (F.col("lo") % 5 > 0) | (F.col("job_id") % 2 == 0)
    chunks = chunks.select("job_id", "chunk_no", "first_page", "last_page", done.alias("done"), F.when(done & (F.col("hi") % 3 == 0), "timed out").alias("error"))
    return E.job_status(t.jobs.selectExpr("id AS job_id"), chunks)


_MISSING = """missing AS (SELECT j.id AS job_id, field_id FROM jobs j JOIN template_fields USING (template_key) WHERE required
    AND (j.id, field_id) NOT IN (SELECT (job_id, field_id) FROM extracted_fields WHERE trim(coalesce(value, '')) <> ''))"""


@query("e13_required_missing", f"WITH {_MISSING} SELECT * FROM missing", "extracted_fields jobs template_fields")
def _(t):
    return E.required_missing(t.extracted_fields, _jobs(t), t.template_fields)


def _stored(t):
    merged = t.extracted_fields.withColumnRenamed("field_label", "field_name")
    return E.store_fields(merged, E.required_missing(merged, _jobs(t), t.template_fields), _jobs(t))


@query("e14_store_fields", f"""WITH {_MISSING} SELECT job_id, field_id, field_label, value, value AS original_value, confidence,
  CASE WHEN (job_id, field_id) IN (SELECT (job_id, field_id) FROM missing) THEN 'missing' ELSE 'pending' END AS validation_status, true AS is_dynamic FROM extracted_fields""",
       "extracted_fields jobs template_fields")
def _(t):
    return _stored(t)[0]


@query("e14_source_references", """SELECT job_id, field_id, document_id, page_number, source_text FROM extracted_fields JOIN jobs j ON j.id = job_id""",
       "extracted_fields jobs")
def _(t):
    return _stored(t)[1]


@query("e15_seed_static", """
  SELECT j.id AS job_id, field_id, field_label, default_value AS value, default_value AS original_value, CAST(NULL AS DOUBLE) AS confidence, 'verified' AS validation_status, false AS is_dynamic
  FROM jobs j JOIN template_fields USING (template_key) WHERE NOT is_dynamic AND default_value IS NOT NULL AND (j.id, field_id) NOT IN (SELECT (job_id, field_id) FROM extracted_fields)""",
       "extracted_fields jobs template_fields")
def _(t):
    return E.seed_static(t.extracted_fields, _jobs(t).drop("document_id"), t.template_fields)


@query("e16_create_jobs", """
  WITH r AS (SELECT event_id AS request_id, user_id AS project_id, event_id % 2000 AS document_id, CASE event_id % 3 WHEN 0 THEN 'T' || (event_id % 120) WHEN 1 THEN '' END AS template_id FROM events
    UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'T' || (o_orderkey % 120) WHEN 1 THEN '' END FROM orders),
  x AS (SELECT r.*, p.id AS pid, p.template_key AS own, d.project_id AS owner, d.page_count, t.template_key AS asked,
    CASE WHEN p.id IS NULL THEN 'Project not found' WHEN d.id IS NULL OR d.project_id <> r.project_id THEN 'Document not found for this project'
      WHEN coalesce(r.template_id, '') <> '' AND t.template_id IS NULL THEN 'Template not found' WHEN coalesce(r.template_id, '') = '' AND p.template_key IS NULL THEN 'template_id is required' END AS error
    FROM r LEFT JOIN projects p ON p.id = r.project_id LEFT JOIN project_documents d ON d.id = r.document_id LEFT JOIN templates t ON t.template_id = r.template_id AND t.is_active)
  SELECT request_id, project_id, document_id, CASE WHEN error IS NULL THEN coalesce(asked, own) END AS template_key, CASE WHEN error IS NULL THEN 'pending' END AS status,
    CASE WHEN error IS NULL THEN 0 END AS progress, CASE WHEN error IS NULL THEN coalesce(page_count, 0) END AS total_pages, error FROM x""", "projects project_documents templates")
def _(t):
    r = t.events.selectExpr("event_id AS request_id", "user_id AS project_id", "event_id % 2000 AS document_id",
                            "CASE event_id % 3 WHEN 0 THEN 'T' || cast(event_id % 120 as string) WHEN 1 THEN '' END AS template_id")
    r = r.unionByName(t.orders.selectExpr("o_orderkey + 1000000 AS request_id", "o_custkey AS project_id", "o_orderkey AS document_id",
                                          "CASE o_orderkey % 3 WHEN 0 THEN 'T' || cast(o_orderkey % 120 as string) WHEN 1 THEN '' END AS template_id"))
    return E.create_jobs(r, t.projects, t.project_documents, t.templates)


@query("e17_recover_orphans", f"""
  SELECT id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' THEN {q(E.INTERRUPTED)} ELSE error_message END AS error_message FROM jobs""", "jobs")
def _(t):
    return E.recover_orphans(t.jobs).select("id", "status", "error_message")


EDITED = """edited AS (SELECT job_id, field_id, coalesce(nv, value) AS value, coalesce(ns, validation_status) AS validation_status,
      CASE WHEN ns IS NULL THEN verification_status END AS verification_status
    FROM (SELECT *, CASE WHEN job_id % 2 = 0 THEN 'match' END AS verification_status FROM extracted_fields) LEFT JOIN (
      SELECT job_id, field_id, arg_max(validation_status, (ts, edit_id)) AS ns, arg_max(value, (ts, edit_id)) FILTER (WHERE value IS NOT NULL) AS nv FROM field_edits
      WHERE validation_status IN ('pending', 'verified', 'missing', 'review', 'rejected') GROUP BY 1, 2) USING (job_id, field_id))"""


def with_verification(t):
    return t.extracted_fields.withColumn("verification_status", F.expr("case when job_id % 2 = 0 then 'match' end"))


@query("e18_apply_field_edits", f"WITH {EDITED} SELECT * FROM edited", "extracted_fields field_edits")
def _(t):
    return E.apply_field_edits(with_verification(t), t.field_edits).select("job_id", "field_id", "value", "validation_status", "verification_status")


@query("e19_job_results", """
  SELECT j.id AS job_id, coalesce(part, 0)::INTEGER AS part_no, template_id AS template_code, j.status, coalesce(fs, '') AS extracted_fields FROM jobs j LEFT JOIN templates USING (template_key) LEFT JOIN (
    SELECT job_id, part, string_agg(field_id || '=' || coalesce(value, '-') || '@' || page_number || ':' || coalesce(source_text, '-'), ',' ORDER BY field_id) AS fs
    FROM (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY field_id) - 1) // 3 AS part FROM extracted_fields) GROUP BY 1, 2) f ON f.job_id = j.id""",
       "jobs templates extracted_fields")
def _(t):
    f = written(t.extracted_fields)  # fields and references both read it
    r = E.job_results(t.jobs.withColumnRenamed("id", "job_id"), f.drop("page_number", "source_text"), f.select("job_id", "field_id", "page_number", "source_text"), t.templates, part_size=3)
    dash = lambda c: F.coalesce(c, F.lit("-"))
    item = lambda x: F.concat(x["field_id"], F.lit("="), dash(x["value"]), F.lit("@"), F.get(x["source_references"], F.lit(0))["page_number"].cast("string"),
                              F.lit(":"), dash(F.get(x["source_references"], F.lit(0))["source_text"]))
    return r.select("job_id", "part_no", "template_code", "status", F.array_join(F.transform("extracted_fields", item), ",").alias("extracted_fields"))


@query("e20_fill_counts", "SELECT job_id, count(*) AS total, count(*) FILTER (WHERE coalesce(value, '') <> '') AS filled FROM extracted_fields GROUP BY 1", "extracted_fields")
def _(t):
    return E.fill_counts(t.extracted_fields)


@query("e21_display_values", """
  SELECT j.id AS job_id, section_pos, field_pos, tf.field_id, tf.field_label, coalesce(nullif(e.value, ''), default_value, '') AS shown
  FROM jobs j JOIN template_fields tf USING (template_key) LEFT JOIN extracted_fields e ON e.job_id = j.id AND e.field_id = tf.field_id""",
       "jobs template_fields extracted_fields")
def _(t):
    return E.display_values(_jobs(t).drop("document_id"), t.template_fields, t.extracted_fields)
