"""Derived test tables, each defined twice: as a DataFrame and as a common table expression.

Every table is a deterministic function of the given tables and grows with them. The scalar
expressions are shared text, valid in both dialects; only explode / ordered-concatenation steps are
written separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperweft.functions import text as X

from . import oracle as O

GIVEN = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()
NOW = "2001-08-01 00:00:00"
SPEC_BASE = 1_000_000_000
#: The references that the SQL resolves in pages, each with its semicolon; the operators resolve all of HTML5 by default.
ENTITIES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}

# --- specification-like documents out of `part`, 40 blocks each -----------------------------
_R = "(p_partkey * 7 + cast(floor(p_partkey / 40) as bigint)) % 12"
SPEC_LINE = f"""
  CASE WHEN p_partkey % 40 = 0 THEN 'PROJECT ' || upper(p_name)
       WHEN p_partkey % 40 = 1 THEN 'IP009-' || cast(p_size as string)
       WHEN p_partkey % 40 = 2 THEN upper(p_type)
       WHEN p_partkey % 40 BETWEEN 20 AND 22 THEN ''
       ELSE CASE {_R}
         WHEN 0 THEN p_name || ': ' || p_brand
         WHEN 1 THEN cast(p_size as string) || '.' || cast(p_partkey % 9 + 1 as string) || ' ' || p_name || ' - ' || p_type || ' - V'
         WHEN 2 THEN 'b) ' || p_name || ' ______'
         WHEN 3 THEN upper(p_name)
         WHEN 4 THEN cast(p_size as string) || ' ' || p_name
         WHEN 5 THEN p_name || ' | ' || p_brand || ' | ' || p_type
         WHEN 6 THEN p_name || chr(9) || p_brand
         WHEN 7 THEN '{chr(0x2022)} ' || p_name || ' : ' || p_type || ' ' || cast(p_size as string)
         WHEN 8 THEN ''
         WHEN 9 THEN p_name || ' ' || cast(p_size as string)
         WHEN 10 THEN 'The ' || p_name || ' shall be rated for ' || cast(p_size as string) || ' kV, and the relay must carry out a check of IEC ' || cast(p_size as string) || '. Make sure it is good!'
         ELSE 'Note: see ' || p_name END END"""
SPEC_STYLE = f"""CASE WHEN p_partkey % 40 = 0 THEN 'Title' WHEN {_R} = 9 AND p_size % 3 = 0 THEN 'Heading 1'
                 WHEN {_R} = 3 AND p_size % 2 = 0 THEN 'Heading 2' ELSE 'Normal' END"""
SPEC_COLUMNS = [
    ("doc_id", f"{SPEC_BASE} + cast(floor(p_partkey / 40) as bigint)"),
    ("block_seq", "cast(p_partkey % 40 as int)"),
    ("block_type", f"CASE WHEN p_partkey % 40 > 2 AND p_partkey % 40 NOT BETWEEN 20 AND 22 AND {_R} IN (5, 6) THEN 'table' ELSE 'para' END"),
    ("text", SPEC_LINE),
    ("style", SPEC_STYLE),
    ("level", f"CASE WHEN {SPEC_STYLE} LIKE 'Heading%' THEN cast(substr({SPEC_STYLE}, 9, 1) as int) END"),
    ("alignment", "CASE WHEN p_size % 5 = 0 THEN 'CENTER' END"),
    ("run_count", "cast(1 + p_size % 3 as int)"),
    ("has_page_break", "(p_partkey % 40 % 10 = 9)"),
    ("rendered_breaks", "cast(CASE WHEN p_partkey % 40 = 15 THEN 1 ELSE 0 END as int)"),
]
_SPEC_SQL = ", ".join(f"{e} AS {n}" for n, e in SPEC_COLUMNS)

# --- table cells of the specification-like documents: (kind, row, pos, text, colspan, vmerge, top, bottom)
CELL_ROWS = [
    (5, 0, 0, "'Item'", 1, "NULL", "NULL", "NULL"),
    (5, 0, 1, "'Brand'", 1, "NULL", "NULL", "NULL"),
    (5, 0, 2, "'Kind'", 1, "NULL", "NULL", "NULL"),
    (5, 0, 3, "CASE WHEN p_size % 2 = 0 THEN 'Qty' ELSE '' END", 1, "NULL", "NULL", "NULL"),
    (5, 1, 0, "p_name", 1, "NULL", "NULL", "NULL"),
    (5, 1, 1, "p_brand", 1, "CASE WHEN p_size % 2 = 0 THEN 'restart' END", "NULL", "NULL"),
    (5, 1, 2, "p_type", 1, "NULL", "NULL", "'none'"),
    (5, 1, 3, "''", 1, "NULL", "NULL", "NULL"),
    (5, 2, 0, "p_name || ' spare'", 1, "NULL", "NULL", "NULL"),
    (5, 2, 1, "CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END", 1, "CASE WHEN p_size % 2 = 0 THEN 'continue' END", "NULL", "NULL"),
    (5, 2, 2, "''", 1, "NULL", "'none'", "CASE WHEN p_size % 3 = 0 THEN 'none' END"),
    (5, 2, 3, "cast(p_size as string)", 1, "NULL", "NULL", "NULL"),
    (5, 3, 0, "'Total ' || p_brand", 1, "NULL", "NULL", "NULL"),
    (5, 3, 1, "p_type", 1, "CASE WHEN p_size % 4 = 0 THEN 'continue' END", "NULL", "NULL"),
    (5, 3, 2, "CASE WHEN p_size % 6 = 0 THEN '' ELSE 'n/a' END", 1, "NULL", "'none'", "NULL"),
    (5, 3, 3, "'units'", 1, "NULL", "NULL", "NULL"),
    (6, 0, 0, "p_name || ': ' || p_brand", 1, "NULL", "NULL", "NULL"),
    (6, 0, 1, "CASE WHEN p_size % 2 = 0 THEN 'Rated size: ' || cast(p_size as string) ELSE '' END", 1, "NULL", "NULL", "NULL"),
    (6, 1, 0, "'Supplier ' || p_brand", 2, "NULL", "NULL", "NULL"),
    (6, 1, 1, "'#' || p_type", 1, "NULL", "NULL", "NULL"),
    (6, 1, 2, "'Unit size'", 1, "NULL", "NULL", "NULL"),
    (6, 1, 3, "'#' || cast(p_size as string)", 1, "NULL", "NULL", "NULL"),
    (6, 2, 0, "'#' || cast(p_size as string) || '-' || cast(p_partkey as string)", 2, "NULL", "NULL", "NULL"),
    (6, 2, 1, "'Serial no'", 1, "NULL", "NULL", "NULL"),
    (6, 3, 0, "'Approved by:'", 1, "NULL", "NULL", "NULL"),
    (6, 3, 1, "CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END", 1, "NULL", "NULL", "NULL"),
    (6, 4, 0, "'Checked by:'", 1, "NULL", "NULL", "NULL"),
    (6, 4, 1, "'Dated:'", 1, "NULL", "NULL", "NULL"),
    (6, 4, 2, "'Place:'", 1, "NULL", "NULL", "NULL"),
    (6, 4, 3, "p_brand", 1, "NULL", "NULL", "NULL"),
]

# --- relational core ------------------------------------------------------------------------------
_US = f"(996624000000000 - c_custkey * 10800000000)"
PROJECT_COLUMNS = [
    ("id", "c_custkey"),
    ("project_name", "c_name"),
    ("project_code", "CASE WHEN c_custkey % 6 > 0 THEN 'P' || cast(c_custkey as string) END"),
    ("template_key", "CASE WHEN c_custkey % 8 > 0 THEN c_custkey % 10 END"),
    ("status", "CASE WHEN c_custkey % 4 = 0 THEN 'archived' ELSE 'active' END"),
]
DOCUMENT_COLUMNS = [
    ("id", "o_orderkey"),
    ("project_id", "o_custkey"),
    ("original_filename", "CASE WHEN o_orderkey % 11 = 0 THEN 'notes' ELSE 'bid_set-' || cast(o_orderkey as string) || '.v' || cast(o_orderkey % 3 as string) END || CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN '.PDF' WHEN 2 THEN '.exe' WHEN 3 THEN '.docx' WHEN 4 THEN '.png' WHEN 5 THEN '.tiff' WHEN 6 THEN '.doc' ELSE '.pdf' END"),
    ("file_size", "cast(floor(o_totalprice * 1200) as bigint)"),
    ("page_count", "cast(o_orderkey % 7 as int)"),
    ("upload_status", "CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'uploaded' ELSE 'failed' END"),
    ("created_at", "o_orderdate"),
]
JOB_COLUMNS = [
    ("id", "o_orderkey"),
    ("project_id", "CASE WHEN o_orderkey % 97 = 0 THEN -1 - o_custkey ELSE o_custkey END"),
    ("document_id", "o_orderkey"),
    ("template_key", "o_custkey % 10"),
    ("status", "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END"),
    ("progress", "cast(CASE o_orderstatus WHEN 'F' THEN 100 ELSE o_orderkey % 100 END as int)"),
    ("error_message", "CASE WHEN o_orderstatus = 'P' THEN 'Document not found' END"),
    ("created_at", "o_orderdate"),
]
FIELD_VALUE = ("CASE WHEN l_discount < 0.02 THEN NULL WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN ' ' "
               "ELSE cast(l_partkey as string) END")
CHUNK_COLUMNS = [
    ("job_id", "l_orderkey"),
    ("field_id", "'f' || cast(l_linenumber as string)"),
    ("field_name", "'line ' || cast(l_linenumber as string)"),
    ("value", FIELD_VALUE),
    ("confidence", "l_discount * 10"),
    ("page_number", "cast(l_quantity as int)"),
    ("source_text", "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'row ' || cast(l_suppkey as string) END"),
    ("validation_status", "CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'verified' ELSE 'pending' END"),
    ("tie", "l_suppkey"),
]
EDIT_COLUMNS = [
    ("edit_id", "event_id"),
    ("ts", "ts"),
    ("job_id", "user_id"),
    ("field_id", "'f' || cast(event_id % 7 + 1 as string)"),
    ("value", "CASE WHEN event_id % 3 > 0 THEN cast(value as string) END"),
    ("validation_status", "CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'review' WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'missing' ELSE 'unknown' END"),
]
TEMPLATE_COLUMNS = [
    ("template_key", "s_suppkey"),
    ("template_id", "'T' || cast(s_suppkey as string)"),
    ("template_name", "CASE WHEN s_suppkey % 7 = 0 THEN 'Specification ' || cast(s_suppkey as string) ELSE s_name END"),
    ("specification_number", "CASE WHEN s_suppkey % 4 > 0 THEN 'IP009-' || cast(s_suppkey as string) END"),
    ("version", "'1.' || cast(s_suppkey % 3 as string)"),
    ("description", "CASE WHEN s_suppkey % 5 > 0 THEN 'nation ' || cast(s_nationkey as string) END"),
    ("status", "CASE WHEN s_suppkey % 9 = 5 THEN 'pending' ELSE 'active' END"),
    ("is_active", "(s_suppkey % 9 <> 5)"),
    ("structure_locked", "(s_suppkey % 3 = 0)"),
]
# (n, section_pos, section_id, section_name, section_page, label, required, dynamic, default, page, clause, hint, pattern, min_length, message)
FIELD_SPECS = [
    (1, 0, "general", "General", 1, "Spec. No", True, True, None, 1, "cover", "Spec number", None, None, None),
    (2, 0, "general", "General", 1, "Project Name", True, True, "PROJECT", None, "0.0", None, None, None, None),
    (3, 1, "technical", "Technical Data", 2, "Rated Voltage", True, True, None, 2, "4.5.1", "kV", None, None, None),
    (4, 1, "technical", "Technical Data", 2, "Part Number", False, True, "1", None, "4.5.2", "digits", "^[0-9]+$", None, "digits only"),
    (5, 1, "technical", "Technical Data", 2, "Supplier Code", False, True, "sch", 3, None, None, "[0-9", 9, None),
    (6, 1, "technical", "Technical Data", 2, "Standard", False, False, "IEC 60364", None, "4.5.30", None, None, None, None),
    (7, 2, "closing", "Closing", None, "this", False, True, "the", None, None, "remarks", None, 4, None),
]


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


FIELD_NAMES = ("n section_pos section_id section_name section_page field_label required is_dynamic "
               "default_value page_number clause_ref extraction_hint pattern min_length message").split()
FIELD_TYPES = ("int int string string int string boolean boolean string int string string string int string").split()
_FIELD_ROWS = ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in FIELD_SPECS)


def _sel(columns) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns]


def _csel(columns) -> str:
    return ", ".join(_sel(columns))


CTES: dict[str, tuple[str, str]] = {
    "blocks": ("", f"""
      SELECT {_SPEC_SQL} FROM part
      UNION ALL
      SELECT doc_id, CAST(i - 1 AS INTEGER), CASE WHEN contains(l, '|') THEN 'table' ELSE 'para' END, {O.strip('l')},
             'Normal', CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), 1, i > 1 AND (i - 1) % 5 = 0, 0
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"""),
    "document_pages": ("blocks", """
      SELECT doc_id, CAST(block_seq // 5 + 1 AS INTEGER) AS page_number, string_agg(text, chr(10) ORDER BY block_seq) AS text
      FROM blocks GROUP BY ALL"""),
    "table_blocks": ("blocks", """
      SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) - 1 AS INTEGER) AS table_index
      FROM blocks WHERE block_type = 'table'"""),
    "cells": ("table_blocks", " UNION ALL ".join(
        f"""SELECT t.doc_id, t.table_index, {r} AS row_no, {p} AS pos, {x} AS text, {cs} AS colspan, CAST({vm} AS VARCHAR) AS vmerge,
            CAST({bt} AS VARCHAR) AS border_top, CAST({bb} AS VARCHAR) AS border_bottom
            FROM table_blocks t JOIN part ON t.doc_id = {SPEC_BASE} + p_partkey // 40 AND t.block_seq = p_partkey % 40 WHERE {_R} = {k}"""
        for k, r, p, x, cs, vm, bt, bb in CELL_ROWS) + f"""
        UNION ALL SELECT doc_id, table_index, 0, unnest(range(0, len(cs)))::INTEGER, unnest(cs), 1, NULL, NULL, NULL
        FROM (SELECT doc_id, table_index, {O.row_cells('text')} AS cs FROM table_blocks WHERE doc_id < {SPEC_BASE})"""),
    "spec_signals": ("", f"""
      SELECT 't' || item_id AS template_id, array_to_string(w[1:6], ' ') AS title, array_to_string(w[7:9], ' ') AS number,
             list_distinct(list_filter(w[10:40], lambda x: length(x) >= 4)) AS labels
      FROM (SELECT item_id, string_split({O.norm('text')}, ' ') AS w FROM benchmark)"""),
    "projects": ("", f"SELECT {_csel(PROJECT_COLUMNS)}, make_timestamp(996624000000000 - c_custkey * 10800000000) AS created_at, "
                     "make_timestamp(996624000000000 - c_custkey * 10800000000 + c_custkey % 50 * 60000000) AS updated_at FROM customer"),
    "project_documents": ("", f"SELECT {_csel(DOCUMENT_COLUMNS)} FROM orders"),
    "jobs": ("", f"SELECT {_csel(JOB_COLUMNS)} FROM orders"),
    "chunk_fields": ("", f"""SELECT {_csel(CHUNK_COLUMNS)}, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INTEGER) AS chunk_no FROM lineitem"""),
    "extracted_fields": ("chunk_fields", """
      SELECT job_id, field_id, field_name AS field_label, value, confidence, page_number, source_text, validation_status
      FROM (SELECT *, row_number() OVER (PARTITION BY job_id, field_id ORDER BY value IS NULL, chunk_no) AS rn FROM chunk_fields) WHERE rn = 1"""),
    "field_edits": ("", f"SELECT {_csel(EDIT_COLUMNS)} FROM events"),
    "templates": ("", f"SELECT {_csel(TEMPLATE_COLUMNS)} FROM supplier"),
    "template_fields": ("templates", f"""
      SELECT template_key, template_id, structure_locked, 'f' || n AS field_id, n AS field_pos, 'string' AS data_type, f.* EXCLUDE (n)
      FROM templates, (VALUES {_FIELD_ROWS}) f({', '.join(FIELD_NAMES)})
      WHERE NOT (template_key % 11 = 0)"""),
    "page_html": ("", """
      SELECT page_id, 'T' || (page_id // 5) AS template_id, CAST(page_id % 5 + 1 AS INTEGER) AS page_number,
        replace(replace(html, '<article>', '<article><p>Clause (4.5.' || (page_id % 9) || ') Spec. No: <span data-field-id="f' || (page_id % 7 + 1) || '">' || page_id || '</span></p>'),
                '<li>', '<li data-field-id="f' || (page_id % 3 + 1) || '">') AS html FROM pages"""),
    "turn_lines": ("", """
      SELECT conv_id, turn, unnest(string_split(role || ': ' || text, chr(10))) AS line FROM conversations"""),
    "responses": ("chunk_fields", """
      SELECT job_id, chunk_no, CAST(substr(field_id, 2) AS INTEGER) AS batch_no,
        CASE WHEN tie % 11 = 1 THEN 'length' ELSE 'stop' END AS done_reason,
        CASE tie % 11 WHEN 1 THEN '{"template_id":"T1","fields":[{"field_id":"' || field_id || '","val'
             WHEN 2 THEN '[1,2]' WHEN 3 THEN '{"template_id":"T1"}' WHEN 4 THEN '{"fields":"none"}' WHEN 5 THEN 'plain text'
             ELSE '{"template_id":"T1","template_version":"1.0","fields":[{"field_id":"' || field_id || '","field_name":"x","value":'
               || CASE WHEN value IS NULL THEN 'null' ELSE '"' || value || '"' END
               || ',"confidence":0.' || CAST(tie % 10 AS VARCHAR) || ',"source":{"page_number":' || CAST(page_number AS VARCHAR)
               || ',"source_text":"s"}},{"field_id":"scope_label","value":"x"}]}' END AS response
      FROM chunk_fields"""),
}


def with_ctes(uses: list[str], sql: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for d in CTES[name][0].split():
            need(d)
        if name not in order:
            order.append(name)

    for u in uses:
        need(u)
    ctes = [f"{n} AS ({CTES[n][1]})" for n in order]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH RECURSIVE " + ", ".join(ctes + [body[5:]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


class Tables:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @property
    def blocks(self) -> DataFrame:
        spec = self.part.selectExpr(*_sel(SPEC_COLUMNS))
        prose = self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_seq", "l")).select(
            "doc_id", "block_seq",
            F.when(F.contains("l", F.lit("|")), "table").otherwise("para").alias("block_type"),
            X.strip("l").alias("text"), F.lit("Normal").alias("style"), F.lit(None).cast("int").alias("level"),
            F.lit(None).cast("string").alias("alignment"), F.lit(1).alias("run_count"),
            ((F.col("block_seq") > 0) & (F.col("block_seq") % 5 == 0)).alias("has_page_break"), F.lit(0).alias("rendered_breaks"))
        return spec.unionByName(prose)

    @property
    def document_pages(self) -> DataFrame:
        return (
            self.blocks.groupBy("doc_id", (F.floor(F.col("block_seq") / 5) + 1).cast("int").alias("page_number"))
            .agg(F.array_sort(F.collect_list(F.struct("block_seq", "text"))).alias("b"))
            .select("doc_id", "page_number", F.array_join("b.text", "\n").alias("text"))
        )

    @property
    def cells(self) -> DataFrame:
        from paperweft.operators.tables import number_tables

        tables = number_tables(self.blocks)
        part = self.part.withColumn("kind", F.expr(_R)).withColumn("doc_id", F.expr(SPEC_COLUMNS[0][1])).withColumn(
            "block_seq", F.expr("cast(p_partkey % 40 as int)"))
        kind = lambda k: F.array(*[
            F.struct(F.lit(r).alias("row_no"), F.lit(p).alias("pos"), F.expr(x).alias("text"), F.lit(cs).alias("colspan"),
                     F.expr(f"cast({vm} as string)").alias("vmerge"), F.expr(f"cast({bt} as string)").alias("border_top"),
                     F.expr(f"cast({bb} as string)").alias("border_bottom"))
            for kk, r, p, x, cs, vm, bt, bb in CELL_ROWS if kk == k])
        spec = part.where("kind in (5, 6)").select(
            "doc_id", "block_seq", F.inline(F.when(F.col("kind") == 5, kind(5)).otherwise(kind(6))))
        # merged: by the size of its files a side may seem small enough to pass through the driver
        spec = spec.join(tables.select("doc_id", "block_seq", "table_index").hint("merge"), ["doc_id", "block_seq"]).drop("block_seq")
        cells = F.filter(F.transform(F.split("text", "[|\t]"), X.strip), lambda p: p != "")
        none = F.lit(None).cast("string")
        prose = tables.where(F.col("doc_id") < SPEC_BASE).select("doc_id", "table_index", F.posexplode(cells).alias("pos", "text")).select(
            "doc_id", "table_index", F.lit(0).alias("row_no"), "pos", "text", F.lit(1).alias("colspan"),
            none.alias("vmerge"), none.alias("border_top"), none.alias("border_bottom"))
        return spec.unionByName(prose)

    @property
    def spec_signals(self) -> DataFrame:
        """One row per template: title, number, distinct labels."""
        w = F.split(X.normalize("text"), " ")
        return self.benchmark.select(
            F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("template_id"), w.alias("w")
        ).select(
            "template_id", F.array_join(F.slice("w", 1, 6), " ").alias("title"), F.array_join(F.slice("w", 7, 3), " ").alias("number"),
            F.array_distinct(F.filter(F.slice("w", 10, 31), lambda x: F.length(x) >= 4)).alias("labels"))

    @property
    def projects(self) -> DataFrame:
        us = F.expr(_US)
        return self.customer.select(
            *[F.expr(e).alias(n) for n, e in PROJECT_COLUMNS],
            F.timestamp_micros(us).cast("timestamp_ntz").alias("created_at"),
            F.timestamp_micros(us + F.expr("c_custkey % 50 * 60000000")).cast("timestamp_ntz").alias("updated_at"))

    @property
    def project_documents(self) -> DataFrame:
        return self.orders.selectExpr(*_sel(DOCUMENT_COLUMNS))

    @property
    def jobs(self) -> DataFrame:
        return self.orders.selectExpr(*_sel(JOB_COLUMNS))

    @property
    def chunk_fields(self) -> DataFrame:
        return self.lineitem.withColumn("chunk_no", F.expr(
            "row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)"
        )).selectExpr(*_sel(CHUNK_COLUMNS), "chunk_no")

    @property
    def extracted_fields(self) -> DataFrame:
        from paperweft.operators.extract import merge_chunks

        return merge_chunks(self.chunk_fields.drop("tie")).selectExpr(
            "job_id", "field_id", "field_name AS field_label", "value", "confidence", "page_number", "source_text", "validation_status")

    @property
    def field_edits(self) -> DataFrame:
        return self.events.selectExpr(*_sel(EDIT_COLUMNS))

    @property
    def templates(self) -> DataFrame:
        return self.supplier.selectExpr(*_sel(TEMPLATE_COLUMNS))

    @property
    def template_fields(self) -> DataFrame:
        rows = F.array(*[
            F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(FIELD_NAMES, FIELD_TYPES, row)]) for row in FIELD_SPECS])
        return (
            self.templates.where("not (template_key % 11 = 0)")
            .select("template_key", "template_id", "structure_locked", F.inline(rows))
            .withColumn("field_id", F.concat(F.lit("f"), F.col("n").cast("string")))
            .withColumn("data_type", F.lit("string")).withColumnRenamed("n", "field_pos"))

    @property
    def page_html(self) -> DataFrame:
        pid = F.col("page_id")
        s = lambda c: c.cast("string")
        lead = F.concat(F.lit("<article><p>Clause (4.5."), s(pid % 9), F.lit(') Spec. No: <span data-field-id="f'), s(pid % 7 + 1),
                        F.lit('">'), s(pid), F.lit("</span></p>"))
        item = F.concat(F.lit('<li data-field-id="f'), s(pid % 3 + 1), F.lit('">'))
        return self.pages.select(
            "page_id", F.concat(F.lit("T"), s(F.floor(pid / 5))).alias("template_id"), (pid % 5 + 1).cast("int").alias("page_number"),
            F.replace(F.replace("html", F.lit("<article>"), lead), F.lit("<li>"), item).alias("html"))

    @property
    def turn_lines(self) -> DataFrame:
        return self.conversations.select("conv_id", "turn", F.explode(F.split(F.concat("role", F.lit(": "), "text"), "\n")).alias("line"))

    @property
    def responses(self) -> DataFrame:
        valid = F.expr("""'{"template_id":"T1","template_version":"1.0","fields":[{"field_id":"' || field_id || '","field_name":"x","value":'
          || CASE WHEN value IS NULL THEN 'null' ELSE '"' || value || '"' END || ',"confidence":0.' || cast(tie % 10 as string)
          || ',"source":{"page_number":' || cast(page_number as string) || ',"source_text":"s"}},{"field_id":"scope_label","value":"x"}]}'""")
        k = F.col("tie") % 11
        cut = F.concat(F.lit('{"template_id":"T1","fields":[{"field_id":"'), F.col("field_id"), F.lit('","val'))
        return self.chunk_fields.select(
            "job_id", "chunk_no", F.substring("field_id", 2, 9).cast("int").alias("batch_no"),
            F.when(k == 1, "length").otherwise("stop").alias("done_reason"),
            F.when(k == 1, cut).when(k == 2, "[1,2]").when(k == 3, '{"template_id":"T1"}').when(k == 4, '{"fields":"none"}')
            .when(k == 5, "plain text").otherwise(valid).alias("response"))
