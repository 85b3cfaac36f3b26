"""U: population."""

from pyspark.sql import functions as F

from paperweft.operators import populate as U

from .registry import query

_TEXT = """CASE o_orderkey % 3 WHEN 0 THEN 'Spec {{f1}} by {f2}, [f3] and {{{f4}}} not f5' WHEN 1 THEN 'line 5: old value' || chr(10) || 'next {f1} line 1: x' ELSE o_orderpriority || ' {f7}{f6}' END"""
_VALUE = "CASE WHEN field_id = 'f1' THEN '[f3]' ELSE coalesce(value, '') END"


def _fold_sql(labels: bool) -> str:
    """Text and number of replacements after fields f1..f7 in order, as nested sub-selects."""
    sql = "SELECT b.job_id, b.text AS x, 0 AS n, v FROM (SELECT o_orderkey AS job_id, {text} AS text FROM orders) b LEFT JOIN vals USING (job_id)".format(text=_TEXT)
    for i in range(1, 8):
        v, there = f"v['f{i}'].v", f"v['f{i}'] IS NOT NULL"
        for p in (f"{{{{f{i}}}}}", f"{{f{i}}}", f"[f{i}]"):
            sql = f"SELECT job_id, v, CASE WHEN {there} AND contains(x, '{p}') THEN replace(x, '{p}', {v}) ELSE x END AS x, n + CASE WHEN {there} AND contains(x, '{p}') THEN 1 ELSE 0 END AS n FROM ({sql})"
        if labels:
            lab = f"(v['f{i}'].l || ':')"
            after = f"substr(x, strpos(x, {lab}) + length({lab}))"
            sql = f"""SELECT job_id, v, CASE WHEN {there} AND contains(x, {lab}) THEN left(x, strpos(x, {lab}) + length({lab}) - 1) || ' ' || {v} || CASE WHEN contains({after}, chr(10)) THEN substr({after}, strpos({after}, chr(10))) ELSE '' END ELSE x END AS x,
              n + CASE WHEN {there} AND contains(x, {lab}) THEN 1 ELSE 0 END AS n FROM ({sql})"""
    return sql


_VALS = f"vals AS (SELECT job_id, map_from_entries(list((field_id, {{'v': {_VALUE}, 'l': field_label}}))) AS v FROM extracted_fields GROUP BY 1)"


def _blocks(t):
    return t.orders.select(F.col("o_orderkey").alias("job_id"), F.expr(_TEXT).alias("text"))


def _values(t):
    return t.extracted_fields.withColumn("value", F.expr(_VALUE))


def _filled(t, labels=True):
    return U.populate(_blocks(t), U.value_lists(_values(t), ["job_id"], ["field_id"]), ["job_id"], labels)


@query("u1_replaceable", "SELECT template_id, field_id FROM template_fields WHERE is_dynamic OR default_value IS NOT NULL", "template_fields")
def _(t):
    return U.replaceable(t.template_fields).select("template_id", "field_id")


@query("u2_populate", f"WITH {_VALS} SELECT job_id, x AS text, n FROM ({_fold_sql(False)})", "extracted_fields")
def _(t):
    return _filled(t, False).select("job_id", "text", F.size("ops").alias("n"))


@query("u3_populate_labels", f"WITH {_VALS} SELECT job_id, x AS text, n FROM ({_fold_sql(True)})", "extracted_fields")
def _(t):
    return _filled(t).select("job_id", "text", F.size("ops").alias("n"))


@query("u4_populate_cells", f"""WITH vals2 AS (SELECT p_brand AS b, min(p_name) AS v FROM part GROUP BY 1)
  SELECT doc_id, table_index, row_no, pos, coalesce(replace(c.text, '[' || r.tok || ']', 'done'), c.text) AS text FROM (SELECT *, text || ' [' || (pos + 1) || ']' AS t2 FROM cells) c0
  JOIN LATERAL (SELECT c0.t2 AS text) c ON true JOIN LATERAL (SELECT CASE WHEN c0.doc_id % 2 = 0 THEN '1' END AS tok) r ON true""".replace("vals2 AS (SELECT p_brand AS b, min(p_name) AS v FROM part GROUP BY 1)", "one AS (SELECT 1)"), "cells")
def _(t):
    cells = t.cells.withColumn("text", F.concat("text", F.lit(" ["), (F.col("pos") + 1).cast("string"), F.lit("]")))
    docs = t.blocks.select("doc_id").distinct().where("doc_id % 2 = 0")
    values = docs.select("doc_id", F.lit("1").alias("field_id"), F.lit("one").alias("field_label"), F.lit("done").alias("value"))
    return U.populate(cells, U.value_lists(values, ["doc_id"], ["field_id"]), ["doc_id"], labels=False).select("doc_id", "table_index", "row_no", "pos", "text")


_WANTED = "wanted AS (SELECT j.id AS job_id, field_id FROM jobs j JOIN template_fields USING (template_key) WHERE is_dynamic OR default_value IS NOT NULL)"
_MISSING = "SELECT * FROM wanted WHERE (job_id, field_id) NOT IN (SELECT (job_id, field_id) FROM extracted_fields)"


def _wanted(t):
    return t.jobs.selectExpr("id AS job_id", "template_key").join(U.replaceable(t.template_fields).select("template_key", "field_id"), "template_key").drop("template_key")


@query("u5_population_report", f"""WITH {_VALS}, done AS (SELECT job_id, n FROM ({_fold_sql(True)})), {_WANTED}, miss AS (SELECT job_id, count(*) AS u, string_agg(field_id, ',' ORDER BY field_id) AS names FROM ({_MISSING}) GROUP BY 1)
  SELECT w.job_id, w.n AS fields_processed, coalesce(d.n, 0) AS replacements_made, coalesce(u, 0) AS fields_unfilled, coalesce(names, '') AS unfilled FROM (SELECT job_id, count(*) AS n FROM wanted GROUP BY 1) w LEFT JOIN done d USING (job_id) LEFT JOIN miss USING (job_id)""",
       "extracted_fields jobs template_fields")
def _(t):
    return U.population_report(_filled(t), _wanted(t), t.extracted_fields, ["job_id"])


@query("u5_unfilled_fields", f"WITH {_WANTED} {_MISSING}", "extracted_fields jobs template_fields")
def _(t):
    return U.unfilled_fields(_wanted(t), t.extracted_fields, ["job_id"])


@query("u6_export_route", "SELECT id AS job_id, CASE WHEN id % 2 = 0 AND id % 3 > 0 THEN 'template' ELSE 'flat' END AS route FROM jobs", "jobs")
def _(t):
    report = t.jobs.selectExpr("id AS job_id", "id % 2 = 0 AS populated")
    return U.export_route(report, t.jobs.where("id % 7 < 7").selectExpr("id AS job_id", "id % 3 > 0 AS is_valid"), ["job_id"])
