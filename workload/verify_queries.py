"""V: verification and review."""

from pyspark.sql import functions as F

from paperweft.operators import verify as V
from paperweft.operators.extract import merge_chunks

from .extract_queries import with_verification
from .registry import query

_VERIFY = """vf AS (SELECT e.job_id, e.field_id, e.value, e.confidence, e.validation_status, trim(coalesce(e.value, '')) AS v, coalesce(required, false) AS required, extraction_hint, pattern, min_length, message
    FROM extracted_fields e JOIN jobs j ON j.id = e.job_id LEFT JOIN template_fields tf ON tf.template_key = j.template_key AND tf.field_id = e.field_id),
  rule AS (SELECT *, CASE WHEN pattern = '[0-9' THEN NULL WHEN pattern IS NOT NULL AND NOT regexp_matches(v, '^[0-9]+$') THEN coalesce(message, 'Value does not match the pattern this template requires.')
       WHEN length(v) < min_length THEN coalesce(message, 'Value is shorter than the required ' || min_length || ' characters.') END AS failure FROM vf),
  verdicts AS (SELECT job_id, field_id, CASE WHEN validation_status = 'rejected' THEN 'mismatch' WHEN v = '' THEN CASE WHEN required THEN 'not_found' ELSE 'review' END
       WHEN confidence < 0.5 THEN 'review' WHEN failure IS NOT NULL THEN 'mismatch' ELSE 'match' END AS status, required, extraction_hint AS expected_hint,
     CASE WHEN validation_status = 'rejected' THEN 'This value was rejected during review.' WHEN v = '' THEN CASE WHEN required THEN 'Required' ELSE 'Optional' END || ' value was not found in the source document.'
       WHEN confidence < 0.5 THEN 'Low extraction confidence (' || CAST(round_even(confidence * 100, 0) AS INTEGER) || '%) — please double-check.' ELSE failure END AS reason FROM rule)"""
_USES = "extracted_fields jobs template_fields"


def _verdicts(t):
    schema = t.template_fields.withColumn("rules", F.when(F.col("pattern").isNotNull() | F.col("min_length").isNotNull(),
                                                          F.array(F.struct("pattern", "min_length", "message"))).otherwise(F.array()))
    fields = t.extracted_fields.join(t.jobs.selectExpr("id AS job_id", "template_key"), "job_id")
    return V.verify(fields, schema)


@query("v1_verify", f"WITH {_VERIFY} SELECT * FROM verdicts", _USES)
def _(t):
    return _verdicts(t)


@query("v2_first_rule_failure", f"WITH {_VERIFY} SELECT job_id, field_id, failure FROM rule WHERE v <> ''", _USES)
def _(t):
    schema = t.template_fields.select("template_key", "field_id", F.array(F.struct("pattern", "min_length", "message")).alias("rules"))
    fields = merge_chunks(t.chunk_fields.select("job_id", "field_id", "value", "chunk_no"))  # a merge can't prune what it carries
    f = fields.join(t.jobs.selectExpr("id AS job_id", "template_key"), "job_id").join(schema, ["template_key", "field_id"], "left")
    f = f.withColumn("v", F.trim(F.coalesce("value", F.lit("")))).where("v <> ''")
    f = f.withColumn("found", V._searches("v", "rules.pattern"))
    return f.select("job_id", "field_id", V.first_rule_failure(F.col("rules"), F.col("found"), F.col("v")).alias("failure"))


@query("v3_store_verdicts", f"""WITH {_VERIFY} SELECT e.job_id, e.field_id, coalesce(status, CASE WHEN e.job_id % 2 = 0 THEN 'match' END) AS verification_status
  FROM extracted_fields e LEFT JOIN (SELECT * FROM verdicts WHERE field_id <> 'f3') v USING (job_id, field_id)""", _USES)
def _(t):
    return V.store_verdicts(with_verification(t), _verdicts(t).where("field_id <> 'f3'")).select("job_id", "field_id", "verification_status")


@query("v4_verdict_summary", f"""WITH {_VERIFY} SELECT job_id, count(*) FILTER (WHERE status = 'match') AS match, count(*) FILTER (WHERE status = 'mismatch') AS mismatch,
  count(*) FILTER (WHERE status = 'not_found') AS not_found, count(*) FILTER (WHERE status = 'review') AS review FROM verdicts GROUP BY 1""", _USES)
def _(t):
    return V.verdict_summary(_verdicts(t))


_ATT = f"""{_VERIFY}, att AS (SELECT job_id, field_id, value, st AS status, required, CAST(CASE WHEN st = 'not_found' AND required THEN 0 WHEN st = 'not_found' THEN 1 WHEN st = 'mismatch' THEN 2 WHEN st = 'review' THEN 3 ELSE 4 END AS INTEGER) AS priority
    FROM (SELECT e.job_id, e.field_id, e.value, v.status IS NULL AS unseen, trim(coalesce(e.value, '')) = '' AS blank, coalesce(v.required, false) AS required,
          coalesce(v.status, CASE WHEN trim(coalesce(e.value, '')) = '' THEN 'not_found' ELSE 'match' END) AS st
          FROM extracted_fields e LEFT JOIN (SELECT * FROM verdicts WHERE field_id <> 'f3') v USING (job_id, field_id))
    WHERE CASE WHEN unseen THEN blank ELSE st <> 'match' END)"""


@query("v5_attention", f"WITH {_ATT} SELECT * FROM att", _USES)
def _(t):
    return V.attention(t.extracted_fields, _verdicts(t).where("field_id <> 'f3'"))


@query("v5_required_missing_counts", f"WITH {_ATT} SELECT job_id, count(*) FILTER (WHERE required AND status = 'not_found') AS required_missing FROM att GROUP BY 1", _USES)
def _(t):
    return V.required_missing_counts(V.attention(t.extracted_fields, _verdicts(t).where("field_id <> 'f3'")))
