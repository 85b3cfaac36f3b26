"""D: document structure."""

from pyspark.sql import functions as F

from paperweft.operators import pages as P, schema as S, signature as G, structure as D, tables as T

from . import oracle as O
from .registry import query

q = O.q
_TXT = O.strip("text")

PC = """pc AS (SELECT doc_id, CAST(1 + sum(CASE WHEN block_type <> 'table' THEN has_page_break::INT + rendered_breaks ELSE 0 END) AS INTEGER) AS page_count,
    CAST(1 + sum(CASE WHEN block_type <> 'table' THEN has_page_break::INT ELSE 0 END) AS INTEGER) AS signature_pages FROM blocks GROUP BY 1)"""
STATS = f"""{PC}, stats AS (SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE block_type <> 'table' AND {_TXT} <> '') AS n_texts, any_value(page_count) AS total
    FROM blocks JOIN pc USING (doc_id) GROUP BY 1)"""
BOUNDS = f"""{STATS},
  ev0 AS (SELECT doc_id, block_seq, block_type, has_page_break, block_type <> 'table' AND {_TXT} = '' AS blank, {O.heading('style', 'text')} AS h FROM blocks),
  ev1 AS (SELECT *, last_value(CASE WHEN NOT blank THEN block_seq END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_seq ROWS UNBOUNDED PRECEDING) AS solid FROM ev0),
  ev AS (SELECT doc_id, block_seq, total, CASE WHEN block_type = 'table' THEN 1 + block_seq * total // (n_blocks + 1) END AS guess,
      row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) AS k FROM ev1 JOIN stats USING (doc_id)
    WHERE block_seq > 0 AND total > 1 AND (block_type = 'table' OR has_page_break OR (blank AND (block_seq - coalesce(solid, -1)) % 3 = 0) OR (NOT blank AND h))),
  fold AS (SELECT doc_id, 0::BIGINT AS k, []::BIGINT[] AS taken, 0::BIGINT AS n, NULL::INTEGER AS block_seq, NULL::BIGINT AS page FROM (SELECT DISTINCT doc_id FROM ev)
    UNION ALL SELECT e.doc_id, e.k, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, n + (p IS NOT NULL)::INT, e.block_seq, p
    FROM (SELECT f.taken, f.n, e.*, CASE WHEN e.guess IS NULL THEN least(e.total, 1 + f.n) WHEN list_contains(f.taken, e.guess) OR e.guess > e.total THEN NULL ELSE e.guess END AS p
          FROM fold f JOIN ev e ON e.doc_id = f.doc_id AND e.k = f.k + 1) e),
  bd AS (SELECT doc_id, block_seq, CAST(page AS INTEGER) AS page FROM fold WHERE page IS NOT NULL)"""
PAGED = f"""{BOUNDS},
  bp0 AS (SELECT b.*, last_value(bd.page IGNORE NULLS) OVER (PARTITION BY b.doc_id ORDER BY b.block_seq ROWS UNBOUNDED PRECEDING) AS lastp, count(bd.page) OVER (PARTITION BY b.doc_id) > 0 AS has
     FROM blocks b LEFT JOIN bd USING (doc_id, block_seq)),
  bp AS (SELECT bp0.* EXCLUDE (lastp, has), CAST(least(total, greatest(1, CASE WHEN has THEN coalesce(lastp, 1) ELSE 1 + block_seq // greatest(1, n_texts // greatest(1, total)) END)) AS INTEGER) AS page
     FROM bp0 JOIN stats USING (doc_id))"""
COVERS = f"""{PAGED},
  hd AS (SELECT *, {_TXT} AS t, block_type <> 'table' AND {O.heading('style', 'text')} AS h, block_type <> 'table' AND {O.numbered('text')} AS num FROM bp),
  cv0 AS (SELECT *, coalesce(bool_or(num AND t <> '') OVER (PARTITION BY doc_id ORDER BY block_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM hd),
  cv1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) AS n FROM cv0 WHERE t <> '' AND h AND NOT num AND page = 1 AND NOT seen),
  covers AS (SELECT doc_id, block_seq, t, CASE WHEN contains(upper(t), 'PROJECT') THEN 'Project Name' WHEN regexp_matches(t, {q(D.CODE_LINE)}) AND regexp_matches(t, '[0-9]') THEN 'Document Code'
      WHEN n >= 3 AND regexp_matches(t, {q(D.PLACE_LINE)}) THEN 'Location' ELSE 'Cover Title Line ' || n END AS label FROM cv1)"""
TABLES = f"""
  g1 AS (SELECT *, CAST(coalesce(sum(greatest(colspan, 1)) OVER (PARTITION BY doc_id, table_index, row_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS col,
      coalesce(vmerge <> 'restart', false) AS cont FROM cells),
  g2 AS (SELECT *, last_value(CASE WHEN NOT cont THEN row_no END IGNORE NULLS) OVER w AS owner, last_value(CASE WHEN NOT cont THEN vmerge IS NOT NULL END IGNORE NULLS) OVER w AS opened
      FROM g1 WINDOW w AS (PARTITION BY doc_id, table_index, col ORDER BY row_no ROWS UNBOUNDED PRECEDING)),
  g3 AS (SELECT g2.* EXCLUDE (cont, owner, opened), CAST(1 + coalesce(m, 0) AS INTEGER) AS rowspan FROM g2 LEFT JOIN (
      SELECT doc_id, table_index, col, owner AS row_no, count(*) AS m FROM g2 WHERE cont AND opened GROUP BY ALL) USING (doc_id, table_index, col, row_no) WHERE NOT cont),
  v1 AS (SELECT * REPLACE (CAST(coalesce(sum(greatest(colspan, 1)) OVER (PARTITION BY doc_id, table_index, row_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS col) FROM g3),
  v2 AS (SELECT *, colspan = 1 AND text = '' AND coalesce(border_top, '') = 'none' AND coalesce(lag(coalesce(border_bottom, '')) OVER (PARTITION BY doc_id, table_index, col, colspan = 1 ORDER BY row_no), '') = 'none' AS gone FROM v1),
  v3 AS (SELECT *, last_value(CASE WHEN NOT gone THEN row_no END IGNORE NULLS) OVER (PARTITION BY doc_id, table_index, col, colspan = 1 ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS anchor FROM v2),
  c2 AS (SELECT v3.* REPLACE (CAST(rowspan + CASE WHEN colspan = 1 THEN coalesce(m, 0) ELSE 0 END AS INTEGER) AS rowspan) FROM v3 LEFT JOIN (
      SELECT doc_id, table_index, col, anchor AS row_no, count(*) AS m FROM v3 WHERE gone GROUP BY ALL) USING (doc_id, table_index, col, row_no) WHERE NOT gone)"""


def _labelish(x: str) -> str:
    return (f"({x} <> '' AND length({x}) <= 60 AND {O.words(O.squeeze(x))} <= 8 AND lower({x}) NOT IN {O.stop()} AND {O.norm_label(x)} <> '' "
            f"AND NOT regexp_matches({O.norm_label(x)}, {q('^(?:[a-zA-Z]|[ivxlcdm]+|[0-9]+)[.)]?$')}))")


FORMS = f"""{TABLES},
  k1 AS (SELECT doc_id, table_index, row_no, CAST(row_number() OVER (PARTITION BY doc_id, table_index, row_no ORDER BY pos) - 1 AS INTEGER) AS cn, text, label,
      coalesce(kind <> 'label' AND value <> '', false) AS tagged, coalesce(kind <> 'label' AND value = '', false) AS pending, value FROM {O.candidates('c2', 'text')}),
  k2 AS (SELECT *, cn - 1 - coalesce(max(CASE WHEN NOT pending THEN cn END) OVER (PARTITION BY doc_id, table_index, row_no ORDER BY cn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS run,
      lag(label) OVER (PARTITION BY doc_id, table_index, row_no ORDER BY cn) AS lbl FROM k1),
  k3 AS (SELECT *, NOT tagged AND text <> '' AND run % 2 = 1 AS took FROM k2),
  k4 AS (SELECT *, tagged OR took OR coalesce(lead(took) OVER (PARTITION BY doc_id, table_index, row_no ORDER BY cn), false) AS used FROM k3),
  r1 AS (SELECT doc_id, table_index, row_no, list({{i: cn, t: text, l: coalesce(label, text)}} ORDER BY cn) FILTER (WHERE NOT used) AS fr,
      list({{i: cn, t: text, l: coalesce(label, text)}} ORDER BY cn) FILTER (WHERE NOT used AND text <> '') AS fu FROM k4 GROUP BY ALL),
  r2 AS (SELECT *, CASE WHEN len(fu) = 2 THEN fu WHEN len(fr) = 2 AND len(fu) = 1 THEN fr END AS pair FROM r1),
  r3 AS (SELECT doc_id, table_index, row_no, pair[1] AS a, pair[2] AS b, {_labelish('pair[1].t')} AS la, {_labelish('pair[2].t')} AS lb FROM r2 WHERE pair IS NOT NULL),
  r4 AS (SELECT doc_id, table_index, row_no, CASE WHEN NOT la AND lb THEN b ELSE a END AS lc, CASE WHEN NOT la AND lb THEN a ELSE b END AS vc FROM r3 WHERE la OR lb),
  r5 AS (SELECT doc_id, table_index, row_no, vc.i AS cn, lc.l AS label, vc.t AS value FROM r4 WHERE NOT {O.is_code('lc.t')}),
  h1 AS (SELECT doc_id, table_index, list(text ORDER BY cn) AS hs, list(text ORDER BY cn) FILTER (WHERE text <> '') AS hf, bool_or(contains(text, ':') OR pending) AS bad FROM k4 WHERE row_no = 0 GROUP BY ALL),
  h2 AS (SELECT doc_id, table_index, hs FROM h1 WHERE NOT bad AND len(hf) >= 3 AND len(list_filter(hf, lambda x: length(x) > 24 OR {O.words(O.squeeze('x'))} > 4 OR {O.is_code('x')})) = 0),
  h3 AS (SELECT k.doc_id, k.table_index, k.row_no, k.cn, hs[k.cn + 1] || ' (row ' || k.row_no || ')' AS label, k.text AS value FROM k4 k JOIN h2 USING (doc_id, table_index)
      LEFT JOIN r5 ON r5.doc_id = k.doc_id AND r5.table_index = k.table_index AND r5.row_no = k.row_no AND r5.cn = k.cn
      WHERE k.row_no > 0 AND NOT k.used AND r5.cn IS NULL AND coalesce(hs[k.cn + 1], '') <> ''),
  forms AS (SELECT doc_id, table_index, 0 AS phase, row_no, cn AS cell_no, label, value FROM k4 WHERE tagged
    UNION ALL SELECT doc_id, table_index, 1, row_no, cn, lbl, text FROM k4 WHERE took
    UNION ALL SELECT doc_id, table_index, 2, row_no, cn, label, value FROM r5
    UNION ALL SELECT doc_id, table_index, 3, row_no, cn, label, value FROM h3)"""


def register_sql(source: str) -> str:
    """``source`` has doc_id, ord (sortable), label, explicit_id, value and more."""
    return f"""
  rg0 AS (SELECT *, {O.squeeze("coalesce(label, '')")} AS field_label FROM {source}),
  rg1 AS (SELECT *, coalesce(explicit_id, {O.slug('field_label')}) AS base, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM (
      SELECT * FROM rg0 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(field_label) ORDER BY ord) = 1)),
  rg AS (SELECT doc_id, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS field_id FROM (SELECT DISTINCT doc_id FROM rg1)
    UNION ALL SELECT doc_id, k, list_append(used, fid), fid FROM (
      SELECT s.doc_id, s.k, r.used, CASE WHEN NOT list_contains(r.used, base) THEN base ELSE base || '_' || list_filter(range(2, len(r.used) + 3), lambda n: NOT list_contains(r.used, base || '_' || n))[1] END AS fid
      FROM rg r JOIN rg1 s ON s.doc_id = r.doc_id AND s.k = r.k + 1)),
  registered AS (SELECT rg1.*, rg.field_id, 'Extract the ' || lower(field_label) || ' from the source document.' || CASE WHEN coalesce(value, '') <> '' THEN ' Example from source: "' || left(value, 120) || '".' ELSE '' END AS extraction_hint,
      coalesce(value, '') AS default_value FROM rg1 JOIN rg USING (doc_id, k))"""


INFER = f"""{COVERS}, {FORMS},
  mk0 AS (SELECT hd.*, covers.label AS cover, hd.h AND hd.t <> '' AND covers.label IS NULL AS starts FROM hd LEFT JOIN covers USING (doc_id, block_seq)),
  mk AS (SELECT *, CAST(coalesce(sum(starts::INT) OVER w, 0) AS INTEGER) AS section_no, coalesce(last_value(CASE WHEN t <> '' OR block_type = 'table' THEN page END IGNORE NULLS) OVER w, 1) AS reached,
      CASE WHEN block_type <> 'table' THEN CAST(sum((block_type <> 'table')::INT) OVER w - 1 AS INTEGER) END AS paragraph_index,
      coalesce(lag(h AND t <> '') OVER (PARTITION BY doc_id ORDER BY block_seq), false) AS after_heading
    FROM mk0 WINDOW w AS (PARTITION BY doc_id ORDER BY block_seq ROWS UNBOUNDED PRECEDING)),
  lines AS (SELECT * FROM mk WHERE block_type <> 'table' AND NOT h AND t <> ''),
  cands AS (
    SELECT doc_id, block_seq, (block_seq, 0, 0, 0, 0) AS ord, cover AS label, NULL::VARCHAR AS explicit_id, t AS value, reached AS page_number, section_no, 'cover' AS origin FROM mk WHERE cover IS NOT NULL
    UNION ALL SELECT doc_id, block_seq, (block_seq, 0, 0, 0, 0), label, NULL, value, reached, section_no, 'line' FROM {O.candidates('lines', 't')} WHERE kind IS NOT NULL
    UNION ALL SELECT f.doc_id, m.block_seq, (m.block_seq, CASE phase WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END, row_no, phase, cell_no), label, {O.slug('label')} || '_table_' || (table_index + 1), value, reached, section_no, 'table'
      FROM forms f JOIN table_blocks tb USING (doc_id, table_index) JOIN mk m ON m.doc_id = tb.doc_id AND m.block_seq = tb.block_seq),
  {register_sql('cands')},
  secs AS (SELECT doc_id, section_no, {O.slug('t')} || '_' || section_no AS section_id, CASE WHEN upper(t) = t THEN {O.title_case('t')} ELSE t END AS section_name, reached AS section_page FROM mk WHERE starts),
  inferred AS (SELECT r.doc_id, r.section_no, coalesce(section_id, 'general') AS section_id, coalesce(section_name, 'General') AS section_name, coalesce(section_page, 1) AS section_page, block_seq, field_id, field_label,
      page_number, extraction_hint, default_value, origin FROM registered r LEFT JOIN secs USING (doc_id, section_no))"""
_USES = "blocks cells table_blocks"


@query("d1_page_count", f"WITH {PC} SELECT * FROM pc", "blocks")
def _(t):
    return D.page_count(t.blocks)


@query("d2_page_boundaries", f"WITH {BOUNDS} SELECT * FROM bd", "blocks")
def _(t):
    return D.page_boundaries(t.blocks, D.document_stats(t.blocks))


@query("d3_block_pages", f"WITH {PAGED} SELECT doc_id, block_seq, page FROM bp", "blocks")
def _(t):
    return D.estimate_pages(t.blocks).select("doc_id", "block_seq", "page")


_NEEDLES = """nd AS (SELECT doc_id, block_seq AS seq, CASE block_seq % 7 WHEN 3 THEN reverse(text) ELSE text END AS text, 2 AS fallback FROM blocks WHERE block_type <> 'table')"""


@query("d4_locate", f"""WITH {_NEEDLES},
  nk AS (SELECT doc_id, seq, fallback, {O.norm('text')} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM nd),
  pg AS (SELECT doc_id, page_number, {O.norm('text')} AS norm, count(*) OVER (PARTITION BY doc_id) AS n FROM document_pages),
  np AS (SELECT doc_id, max(n) AS n FROM pg GROUP BY 1),
  lc AS (SELECT doc_id, 0::BIGINT AS k, 1::BIGINT AS cursor_, NULL::INTEGER AS seq, NULL::BIGINT AS page FROM np
    UNION ALL SELECT doc_id, k, CASE WHEN key <> '' AND hit IS NOT NULL THEN hit ELSE cursor_ END, seq, CASE WHEN key = '' THEN greatest(1, least(fallback, n)) ELSE coalesce(hit, cursor_) END FROM (
      SELECT nk.doc_id, nk.k, lc.cursor_, nk.seq, nk.key, nk.fallback, np.n, min(pg.page_number) FILTER (WHERE pg.page_number >= lc.cursor_ AND contains(pg.norm, nk.key)) AS hit
      FROM lc JOIN nk ON nk.doc_id = lc.doc_id AND nk.k = lc.k + 1 JOIN np ON np.doc_id = nk.doc_id JOIN pg ON pg.doc_id = nk.doc_id GROUP BY ALL))
  SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(page AS INTEGER) AS page FROM lc WHERE k > 0""", "blocks document_pages")
def _(t):
    text = F.expr("CASE block_seq % 7 WHEN 3 THEN reverse(text) ELSE text END")
    needles = t.blocks.where("block_type <> 'table'").select("doc_id", F.col("block_seq").alias("seq"), text.alias("text"), F.lit(2).alias("fallback"))
    return D.locate(needles, t.document_pages)


_PIECES = f"pieces AS (SELECT doc_id, page + CASE WHEN block_seq % 13 = 12 THEN 3 ELSE 0 END AS page, block_seq AS seq, {_TXT} AS text FROM bp WHERE {_TXT} <> '')"


def _pieces(t):
    from paperweft.functions.text import strip

    b = D.estimate_pages(t.blocks).withColumn("text", strip("text")).where("text <> ''")
    return b.select("doc_id", (F.col("page") + F.when(F.col("block_seq") % 13 == 12, 3).otherwise(0)).alias("page"), F.col("block_seq").alias("seq"), "text")


@query("d5_assemble_pages", f"""WITH {PAGED}, {_PIECES},
  on_ AS (SELECT doc_id, least(page, page_count) AS page_number, string_agg(text, chr(10) ORDER BY page, seq) AS text, bool_or(page > page_count) AS over FROM pieces JOIN pc USING (doc_id) GROUP BY ALL)
  SELECT doc_id, page_number, coalesce(CASE WHEN over THEN {O.strip('text')} ELSE text END, '') AS text
  FROM (SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS page_number FROM pc) LEFT JOIN on_ USING (doc_id, page_number)""", "blocks")
def _(t):
    return D.assemble_pages(_pieces(t), D.page_count(t.blocks))


@query("d6_sections", f"""
  WITH one AS (SELECT doc_id, block_seq, any_value(c.text) AS hx FROM cells c JOIN table_blocks USING (doc_id, table_index) GROUP BY doc_id, block_seq HAVING count(*) = 1 AND bool_and({O.numbered('c.text')})),
  s0 AS (SELECT b.*, {O.strip('b.text')} AS t, hx, CASE WHEN block_type = 'table' THEN hx IS NOT NULL ELSE {O.heading('style', 'text')} END AS h FROM blocks b LEFT JOIN one USING (doc_id, block_seq)),
  s1 AS (SELECT *, CAST(sum((h AND block_seq > 0)::INT) OVER (PARTITION BY doc_id ORDER BY block_seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section_no FROM s0)
  SELECT doc_id, section_no, 0 AS part_no, CASE WHEN section_no = 0 THEN 'cover' ELSE 'section_' || section_no END AS section_id,
    CASE WHEN section_no = 0 THEN 'Cover' ELSE coalesce(nullif(arg_min(coalesce(hx, t), block_seq), ''), 'Section ' || section_no) END AS section_name,
    CAST(count(*) AS INTEGER) AS n_blocks, coalesce(string_agg(t, chr(10) ORDER BY block_seq) FILTER (WHERE t <> ''), '') AS content FROM s1 GROUP BY doc_id, section_no""", _USES)
def _(t):
    return D.sections(t.blocks, t.cells)


@query("d7_cover_titles", f"WITH {COVERS} SELECT doc_id, block_seq, label, t AS text FROM covers", "blocks")
def _(t):
    return D.cover_titles(D.estimate_pages(t.blocks))


_D8 = """CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '.' WHEN 2 THEN p_name || ' ' || cast(p_partkey % 3 + 1 as string)
   WHEN 3 THEN p_name || '_2' WHEN 4 THEN p_name || ' 2 2' ELSE p_name || '!' END"""


@query("d8_register_fields", f"""WITH src AS (SELECT p_partkey // 200 AS doc_id, (p_partkey % 200) AS ord, {_D8} AS label, NULL::VARCHAR AS explicit_id, p_brand AS value FROM part), {register_sql('src')}
  SELECT doc_id, CAST(ord AS INTEGER) AS ord_, field_id, field_label, extraction_hint, default_value FROM registered""")
def _(t):
    c = t.part.select(F.floor(F.col("p_partkey") / 200).alias("doc_id"), (F.col("p_partkey") % 200).cast("int").alias("ord_"), F.expr(_D8).alias("label"),
                      F.lit(None).cast("string").alias("explicit_id"), F.col("p_brand").alias("value"))
    return S.register_fields(c, ["ord_"])


@query("d9_infer_fields", f"WITH {INFER} SELECT * FROM inferred", _USES)
def _(t):
    return S.infer_fields(D.estimate_pages(t.blocks), t.cells).drop("stage", "row_no", "phase", "cell_no", "data_type", "required")


@query("d9_inferred_sections", f"""WITH {INFER}
  SELECT doc_id, section_no, section_id, section_name, section_page, CAST(count(*) AS INTEGER) AS field_count FROM inferred GROUP BY ALL
  UNION ALL SELECT doc_id, 0, 'general', 'General', 1, 0 FROM pc WHERE doc_id NOT IN (SELECT doc_id FROM inferred)""", _USES)
def _(t):
    return S.infer_sections(D.estimate_pages(t.blocks), t.cells)


@query("d10_static_blocks", f"""WITH {INFER},
  tt AS (SELECT doc_id, table_index, string_agg(line, chr(10) ORDER BY row_no) AS tx FROM (SELECT doc_id, table_index, row_no, string_agg({_TXT}, ' | ' ORDER BY pos) FILTER (WHERE {_TXT} <> '') AS line FROM cells GROUP BY doc_id, table_index, row_no)
      WHERE coalesce(line, '') <> '' GROUP BY ALL),
  st AS (
    SELECT doc_id, block_seq, reached AS page_number, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS block_type, t AS text, false AS looks_like_blank_field, paragraph_index FROM mk
      WHERE block_type <> 'table' AND t <> '' AND (doc_id, block_seq) NOT IN (SELECT (doc_id, block_seq) FROM cands WHERE origin <> 'table')
    UNION ALL SELECT doc_id, block_seq, reached, 'paragraph', '', true, paragraph_index FROM mk WHERE block_type <> 'table' AND t = '' AND after_heading
    UNION ALL SELECT m.doc_id, m.block_seq, reached, 'table', tx, false, NULL FROM mk m JOIN table_blocks tb USING (doc_id, block_seq) JOIN tt ON tt.doc_id = tb.doc_id AND tt.table_index = tb.table_index
      WHERE (m.doc_id, m.block_seq) NOT IN (SELECT (doc_id, block_seq) FROM registered WHERE origin = 'table'))
  SELECT doc_id, block_seq, page_number, block_type, text, looks_like_blank_field, paragraph_index, 'static_' || row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) AS block_id FROM st""", _USES)
def _(t):
    return S.static_blocks(D.estimate_pages(t.blocks), t.cells)


_NL = lambda x: O.norm_label(x)
_D11 = f"""
  WITH e0 AS (SELECT * FROM {O.candidates('cells', 'text')}),
  e1 AS MATERIALIZED (SELECT doc_id, table_index, row_no, pos, {_NL('text')} AS nt, CASE WHEN kind IS NOT NULL THEN nullif({_NL('label')}, '') END AS el, value AS ev,
      lead(text) OVER (r ORDER BY pos) AS nx, lag(text) OVER (r ORDER BY pos) AS pv, count(*) OVER r AS w, bool_or(text <> '') OVER r AS filled
    FROM e0 WINDOW r AS (PARTITION BY doc_id, table_index, row_no)),
  e2 AS MATERIALIZED (SELECT *, count(el) OVER (PARTITION BY doc_id, table_index, row_no) AS ne, nt <> '' AND {O.table_label('nt')} AS tl FROM e1),
  e3 AS MATERIALIZED (SELECT *, ne = 0 AND pos % 2 = 0 AND pos < w - 1 AND tl AND filled AS left_label FROM e2),
  e4 AS MATERIALIZED (SELECT *, bool_or(left_label OR el IS NOT NULL) OVER (PARTITION BY doc_id, table_index, row_no) AS found FROM e3),
  f1 AS (SELECT doc_id, table_index, row_no, pos AS cell_index, el AS label, ev AS value FROM e4 WHERE el IS NOT NULL
    UNION ALL SELECT doc_id, table_index, row_no, pos, nt, {O.strip('nx')} FROM e4 WHERE left_label),
  rv AS (SELECT doc_id, table_index, row_no, nt AS label, pv FROM e4 WHERE w = 2 AND pos = 1 AND tl AND NOT found),
  ff AS (SELECT doc_id, table_index, min(row_no) AS r FROM f1 GROUP BY ALL), rr AS (SELECT doc_id, table_index, min(row_no) AS r FROM rv GROUP BY ALL),
  al AS (SELECT * FROM f1 UNION ALL SELECT rv.doc_id, rv.table_index, rv.row_no, 1, rv.label, rv.pv FROM rv JOIN rr ON rr.doc_id = rv.doc_id AND rr.table_index = rv.table_index AND rr.r = rv.row_no
      LEFT JOIN ff ON ff.doc_id = rv.doc_id AND ff.table_index = rv.table_index WHERE ff.r IS NULL OR rr.r < ff.r)
  SELECT doc_id, table_index, row_no, cell_index, label, value, {O.slug('label')} || '_table_' || (table_index + 1) || '_row_' || (row_no + 1) || '_cell_' || (cell_index + 1) AS field_id FROM al"""


@query("d11_table_fields", _D11, "cells")
def _(t):
    return T.table_fields(t.cells)


@query("d12_pair_cells", f"WITH {FORMS} SELECT * FROM forms WHERE phase IN (1, 2)", "cells")
def _(t):
    return T.pair_cells(t.cells)


@query("d13_header_fields", f"WITH {FORMS} SELECT doc_id, table_index, row_no, cell_no, label, value FROM forms WHERE phase = 3", "cells")
def _(t):
    return T.header_fields(t.cells)


@query("d14_table_structure", f"""WITH {TABLES},
  grid AS (SELECT doc_id, table_index, list(1000 + 500 * c ORDER BY c) AS ws FROM (SELECT DISTINCT doc_id, table_index, unnest(range(0, 4)) AS c FROM table_blocks) GROUP BY ALL),
  k AS (SELECT * FROM {O.candidates('g3', 'text')})
  SELECT doc_id, table_index, row_no, pos, col, rowspan, colspan, text, CASE WHEN col < 4 THEN round(list_sum(ws[col + 1 : col + colspan]) / list_sum(ws) * 100, 2) END AS width_pct,
    coalesce(kind <> 'label', false) AS is_editable,
    CASE WHEN kind <> 'label' THEN {O.slug('label')} || '_table_' || (table_index + 1) || '_row_' || (row_no + 1) || '_cell_' || (col + 1) END AS field_id
  FROM k JOIN grid USING (doc_id, table_index)""", "cells table_blocks")
def _(t):
    grid = T.number_tables(t.blocks).select("doc_id", "table_index", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col"))
    return T.table_structure(t.cells, grid.withColumn("width", 1000 + 500 * F.col("col")))


@query("d15_collapse_merges", f"WITH {TABLES} SELECT doc_id, table_index, row_no, pos, col, rowspan, text FROM c2", "cells")
def _(t):
    return T.collapse_merges(t.cells).select("doc_id", "table_index", "row_no", "pos", "col", "rowspan", "text")


@query("d16_page_structure", f"""WITH {PAGED}, {TABLES},
  tx AS (SELECT *, {_TXT} AS t FROM bp WHERE block_type <> 'table' AND {_TXT} <> ''),
  ln AS (SELECT doc_id, page, block_seq, t, {O.heading('style', 'text')} AS h, kind, label, value FROM {O.candidates('tx', 't')}),
  pr AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY block_seq) AS ps, count(*) AS n, count(*) FILTER (WHERE h) AS nh FROM ln WHERE h OR kind IS NULL GROUP BY ALL),
  fm AS (SELECT doc_id, page, string_agg(label || ': ' || value, chr(10) ORDER BY block_seq) AS fs, string_agg({O.slug('label')} || '_p' || block_seq, ',' ORDER BY block_seq) AS ids FROM ln WHERE NOT h AND kind IS NOT NULL GROUP BY ALL),
  rw AS (SELECT doc_id, table_index, row_no, string_agg(text, ' | ' ORDER BY col) FILTER (WHERE text <> '') AS rt FROM g3 GROUP BY ALL),
  tb AS (SELECT b.doc_id, b.page, string_agg(rt, chr(10) ORDER BY table_index, row_no) AS ts, count(DISTINCT table_index) AS n FROM bp b JOIN table_blocks t USING (doc_id, block_seq) LEFT JOIN rw USING (doc_id, table_index) GROUP BY b.doc_id, b.page),
  ev2 AS (SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS page FROM pc)
  SELECT doc_id, page AS page_number, CASE WHEN page = 1 THEN 'first ' ELSE 'other ' END || doc_id AS header, CAST(coalesce(pr.n, 0) AS INTEGER) AS n_paragraphs, CAST(coalesce(nh, 0) AS INTEGER) AS n_headings,
    CAST(coalesce(tb.n, 0) AS INTEGER) AS n_tables, coalesce(ids, '') AS form_ids, concat_ws(chr(10), ps, ts, fs) AS text
  FROM ev2 LEFT JOIN pr USING (doc_id, page) LEFT JOIN fm USING (doc_id, page) LEFT JOIN tb USING (doc_id, page)""", _USES)
def _(t):
    s = F.col("doc_id").cast("string")
    heads = t.blocks.select("doc_id").distinct().select("doc_id", F.concat(F.lit("first "), s).alias("header_first"), F.concat(F.lit("other "), s).alias("header"))
    p = S.page_structure(D.estimate_pages(t.blocks), t.cells, D.page_count(t.blocks), heads)
    return p.select(
        "doc_id", "page_number", "header", F.size("paragraphs").alias("n_paragraphs"), F.size(F.filter("paragraphs", lambda x: x["is_heading"])).alias("n_headings"),
        F.size("tables").alias("n_tables"), F.array_join("forms.field_id", ",").alias("form_ids"), "text")


@query("d17_page_fragments", f"""WITH {PAGED}, {_PIECES},
  on_ AS (SELECT doc_id, least(page, page_count) AS p, string_agg(text, '' ORDER BY page, seq) FILTER (WHERE page <= page_count) AS a, string_agg(text, '' ORDER BY page, seq) FILTER (WHERE page > page_count) AS o FROM pieces JOIN pc USING (doc_id) GROUP BY ALL)
  SELECT doc_id, p AS page_number, CASE WHEN p = 1 THEN '<1>' ELSE '<n>' END || coalesce(a, '') || CASE WHEN p = 1 THEN '</1>' ELSE '</n>' END || coalesce(o, '') AS content
  FROM (SELECT doc_id, unnest(range(1, page_count + 1))::INTEGER AS p FROM pc) LEFT JOIN on_ USING (doc_id, p)""", "blocks")
def _(t):
    frames = t.blocks.select("doc_id").distinct().selectExpr("doc_id", "'<1>' AS header_first", "'<n>' AS header", "'</1>' AS footer_first", "'</n>' AS footer")
    return D.page_fragments(_pieces(t).withColumnRenamed("text", "fragment"), frames, D.page_count(t.blocks))


DIMS = """dims AS (SELECT doc_id, table_index, CAST(count(*) AS INTEGER) AS row_count, CAST(max(w) AS INTEGER) AS col_count, CAST(count(*) * arg_min(n, row_no) AS INTEGER) AS cell_count
    FROM (SELECT doc_id, table_index, row_no, count(*) AS n, sum(colspan) AS w FROM cells GROUP BY ALL) GROUP BY ALL)"""


def _dims(t):
    return G.table_dims(t.cells).join(T.number_tables(t.blocks).select("doc_id", "table_index", "block_seq"), ["doc_id", "table_index"])


@query("d18_block_hashes", f"""WITH {DIMS}
  SELECT b.doc_id, b.block_seq, CASE WHEN block_type = 'table' THEN 'table' ELSE 'para' END AS kind, left(sha256(CASE WHEN block_type = 'table'
     THEN '{{"cells": ' || coalesce(cell_count, 0) || ', "cols": ' || coalesce(col_count, 0) || ', "rows": ' || coalesce(row_count, 0) || '}}'
     ELSE '{{"alignment": "' || coalesce(alignment, 'None') || '", "level": ' || coalesce(level::VARCHAR, 'null') || ', "run_count": ' || run_count || ', "style": "' || style || '"}}' END), 16) AS hash
  FROM blocks b LEFT JOIN (SELECT d.*, t.block_seq FROM dims d JOIN table_blocks t USING (doc_id, table_index)) x USING (doc_id, block_seq)""", _USES)
def _(t):
    return G.block_hashes(t.blocks, _dims(t).drop("table_index"))


SIG = f"""{PC},
  sig0 AS (SELECT doc_id, signature_pages AS page_count, CAST(count(*) FILTER (WHERE block_type = 'table') AS INTEGER) AS table_count, CAST(count(*) FILTER (WHERE block_type <> 'table') AS INTEGER) AS paragraph_count, count(*) AS nb,
     doc_id % 2 = 0 AS has_headers, doc_id % 3 = 0 AS has_footers, true AS has_sections FROM blocks JOIN pc USING (doc_id) GROUP BY ALL),
  sig AS (SELECT * EXCLUDE (nb), left(sha256('{{"block_sequence_length": ' || nb || ', "footers": ' || has_footers || ', "hashes_count": ' || nb || ', "headers": ' || has_headers || ', "pages": ' || page_count || ', "paragraphs": ' || paragraph_count
     || ', "sections": ' || has_sections || ', "tables": ' || table_count || '}}'), 16) AS overall_hash FROM sig0)"""


def _signatures(t):
    frames = t.blocks.select("doc_id").distinct().selectExpr("doc_id", "doc_id % 2 = 0 AS has_headers", "doc_id % 3 = 0 AS has_footers", "true AS has_sections")
    return G.signatures(t.blocks, frames).drop("block_count")


@query("d18_signatures", f"WITH {SIG} SELECT * FROM sig", "blocks")
def _(t):
    return _signatures(t)


# pairs: every document against the next one; the specification-like ones are alike by construction
CMP = f"""{SIG}, {DIMS},
  sa AS (SELECT doc_id AS pair_id, * EXCLUDE (doc_id) FROM sig), sb AS (SELECT doc_id - 1 AS pair_id, * EXCLUDE (doc_id) FROM sig),
  qa AS (SELECT doc_id AS pair_id, block_seq, CASE WHEN block_type = 'table' THEN 't' ELSE 'p' END AS kind FROM blocks), qb AS (SELECT doc_id - 1 AS pair_id, block_seq, CASE WHEN block_type = 'table' THEN 't' ELSE 'p' END AS kind FROM blocks),
  dq AS (SELECT DISTINCT coalesce(qa.pair_id, qb.pair_id) AS pair_id FROM qa FULL JOIN qb ON qa.pair_id = qb.pair_id AND qa.block_seq = qb.block_seq WHERE qa.kind IS DISTINCT FROM qb.kind),
  cmp AS (SELECT a.pair_id, a, b, list_filter([
      CASE WHEN a.page_count <> b.page_count THEN 'Page count mismatch: ' || a.page_count || ' vs ' || b.page_count END, CASE WHEN a.table_count <> b.table_count THEN 'Table count mismatch: ' || a.table_count || ' vs ' || b.table_count END,
      CASE WHEN abs(a.paragraph_count - b.paragraph_count) > 5 THEN 'Paragraph count variance: ' || a.paragraph_count || ' vs ' || b.paragraph_count END,
      CASE WHEN a.has_headers <> b.has_headers THEN 'Header presence mismatch: ' || CASE WHEN a.has_headers THEN 'True' ELSE 'False' END || ' vs ' || CASE WHEN b.has_headers THEN 'True' ELSE 'False' END END,
      CASE WHEN a.has_footers <> b.has_footers THEN 'Footer presence mismatch: ' || CASE WHEN a.has_footers THEN 'True' ELSE 'False' END || ' vs ' || CASE WHEN b.has_footers THEN 'True' ELSE 'False' END END,
      CASE WHEN dq.pair_id IS NOT NULL THEN 'Block sequence mismatch (layout structure changed)' END], lambda x: x IS NOT NULL) AS diffs
    FROM sa a JOIN sb b USING (pair_id) LEFT JOIN dq ON dq.pair_id = a.pair_id)"""


def _compared(t):
    sig = _signatures(t)
    kind = F.when(F.col("block_type") == "table", "t").otherwise("p").alias("kind")
    a = t.blocks.select(F.col("doc_id").alias("pair_id"), "block_seq", kind)
    b = t.blocks.select((F.col("doc_id") - 1).alias("pair_id"), "block_seq", kind)
    return G.compare_signatures(sig.withColumnRenamed("doc_id", "pair_id"), sig.withColumn("pair_id", F.col("doc_id") - 1).drop("doc_id"), G.sequence_differences(a, b))


@query("d19_compare_signatures", f"WITH {CMP} SELECT pair_id, len(diffs) = 0 AS is_identical, array_to_string(diffs, '#') AS differences FROM cmp", "blocks cells")
def _(t):
    return _compared(t).select("pair_id", "is_identical", F.array_join("differences", "#").alias("differences"))


_DE = """de AS (SELECT a.doc_id AS pair_id, a.table_index, 0 AS pos, 'Table ' || a.table_index || ' row count mismatch: ' || a.row_count || ' vs ' || b.row_count AS error FROM dims a JOIN dims b ON b.doc_id = a.doc_id + 1 AND b.table_index = a.table_index WHERE a.row_count <> b.row_count
    UNION ALL SELECT a.doc_id, a.table_index, 1, 'Table ' || a.table_index || ' column count mismatch: ' || a.col_count || ' vs ' || b.col_count FROM dims a JOIN dims b ON b.doc_id = a.doc_id + 1 AND b.table_index = a.table_index WHERE a.col_count <> b.col_count)"""
_RS = """rs AS (SELECT pair_id, string_agg(style, ', ' ORDER BY style) AS removed FROM (SELECT DISTINCT doc_id AS pair_id, style FROM blocks EXCEPT SELECT doc_id - 1, style FROM blocks) GROUP BY 1)"""


def _dim_errors(t):
    d = G.table_dims(t.cells)
    return G.dimension_errors(d.withColumnRenamed("doc_id", "pair_id"), d.withColumn("pair_id", F.col("doc_id") - 1))


def _removed(t):
    return G.removed_styles(t.blocks.selectExpr("doc_id AS pair_id", "style"), t.blocks.selectExpr("doc_id - 1 AS pair_id", "style"))


@query("d20_integrity_report", f"""WITH {CMP}, {_DE}, {_RS}, da AS (SELECT pair_id, list(error ORDER BY table_index, pos) AS es FROM de GROUP BY 1),
  rp AS (SELECT pair_id, a, b, diffs, removed, list_concat(CASE WHEN len(diffs) > 0 THEN ['Document structure changed'] ELSE [] END, CASE WHEN a.page_count <> b.page_count THEN ['Page count mismatch: ' || a.page_count || ' vs ' || b.page_count] ELSE [] END,
      CASE WHEN a.table_count <> b.table_count THEN ['Table count mismatch: ' || a.table_count || ' vs ' || b.table_count, 'Table count mismatch'] ELSE coalesce(es, []) END) AS errors FROM cmp LEFT JOIN da USING (pair_id) LEFT JOIN rs USING (pair_id))
  SELECT pair_id, len(errors) = 0 AS is_valid, array_to_string(errors, '#') AS errors,
    array_to_string(list_concat(list_transform(diffs, lambda x: 'Structural difference: ' || x), CASE WHEN removed IS NOT NULL THEN ['Styles removed: ' || removed] ELSE [] END,
      CASE WHEN abs(a.paragraph_count - b.paragraph_count) > 10 THEN ['Paragraph count variance: ' || a.paragraph_count || ' vs ' || b.paragraph_count] ELSE [] END), '#') AS warnings,
    len(diffs) = 0 AND a.table_count = b.table_count AS structure_preserved, a.page_count = b.page_count AS layout_preserved,
    CASE WHEN a.table_count = b.table_count THEN 8 ELSE 7 END AS n_checks FROM rp""", "blocks cells")
def _(t):
    r = G.integrity_report(_compared(t), _dim_errors(t), _removed(t))
    return r.withColumns({"errors": F.array_join("errors", "#"), "warnings": F.array_join("warnings", "#"), "n_checks": F.size("checks")}).drop("checks")


@query("d21_dimension_errors", f"WITH {DIMS}, {_DE} SELECT * FROM de", "cells")
def _(t):
    return _dim_errors(t)


@query("d22_removed_styles", f"WITH {_RS} SELECT * FROM rs", "blocks")
def _(t):
    return _removed(t)


@query("d23_replacement_only", f"""WITH {CMP} SELECT pair_id, len(diffs) = 0 AS is_valid, array_to_string(list_transform(diffs, lambda x: 'Structure changed: ' || x), '#') AS errors, coalesce(n, 0) AS dynamic_fields
  FROM cmp LEFT JOIN (SELECT template_key AS pair_id, count(DISTINCT field_id) AS n FROM template_fields WHERE is_dynamic GROUP BY 1) USING (pair_id)""", "blocks cells template_fields")
def _(t):
    r = G.replacement_only(_compared(t), t.template_fields.selectExpr("template_key AS pair_id", "field_id", "is_dynamic"))
    return r.withColumn("errors", F.array_join("errors", "#"))


def _sum_sql(text: str) -> str:
    return " || ':' || ".join(f"CAST(sum(('0x' || substr(md5({text}), {at}, 15))::BIGINT) AS VARCHAR)" for at in (1, 17))


def _sig_sql(name: str, source: str) -> str:
    line = "'FIELD:' || field_id || ':' || field_label || ':' || data_type || ':' || CASE WHEN required THEN 'True' ELSE 'False' END"
    return f"""{name}_f AS (SELECT template_id, section_pos, section_id, section_name, (row_number() OVER (PARTITION BY template_id, section_pos ORDER BY field_pos) - 1) || '|' || {line} AS l FROM {source}),
  {name}_s AS (SELECT template_id, section_pos, min(section_id) AS section_id, min(section_name) AS section_name, count(*) AS n_fields, {_sum_sql('l')} AS digest FROM {name}_f GROUP BY 1, 2),
  {name}_r AS (SELECT *, (row_number() OVER (PARTITION BY template_id ORDER BY section_pos) - 1) || '|' || section_id || '|' || section_name || '|' || n_fields || '|' || digest AS l FROM {name}_s),
  {name} AS (SELECT template_id, count(*) AS n_sections, sum(n_fields)::BIGINT AS n_fields, {_sum_sql('l')} AS digest FROM {name}_r GROUP BY 1)"""


@query("d24_schema_signature", f"""WITH {_sig_sql('sg', 'template_fields')},
  st0 AS (SELECT template_id, section_pos, 'SECTION:' || any_value(section_id) || ':' || any_value(section_name) || '|' || string_agg('FIELD:' || field_id || ':' || field_label || ':' || data_type || ':' || CASE WHEN required THEN 'True' ELSE 'False' END, '|' ORDER BY field_pos) AS l FROM template_fields GROUP BY 1, 2),
  st AS (SELECT template_id, string_agg(l, '|' ORDER BY section_pos) AS signature FROM st0 GROUP BY 1)
  SELECT * FROM sg JOIN st USING (template_id)""", "template_fields")
def _(t):
    return G.schema_signature(t.template_fields).join(G.signature_text(t.template_fields), "template_id")


@query("d24_signature_lines", """
  SELECT template_id, section_pos, field_pos, 'FIELD:' || field_id || ':' || field_label || ':' || data_type || ':' || CASE WHEN required THEN 'True' ELSE 'False' END AS line FROM template_fields
  UNION ALL SELECT DISTINCT template_id, section_pos, NULL, 'SECTION:' || section_id || ':' || section_name FROM template_fields""", "template_fields")
def _(t):
    return G.signature_lines(t.template_fields)


_CHANGED = """SELECT * REPLACE (CASE WHEN template_key % 4 = 1 AND field_pos = 3 THEN field_label || ' (new)' ELSE field_label END AS field_label) FROM template_fields WHERE NOT (template_key % 6 = 0 AND field_pos = 7)"""


@query("d25_validate_locked", f"""WITH changed AS ({_CHANGED}), {_sig_sql('so', 'template_fields')}, {_sig_sql('sn', 'changed')}
  SELECT template_id, NOT structure_locked OR coalesce(so.digest, '') = coalesce(sn.digest, '') AS is_valid,
    CASE WHEN NOT structure_locked OR coalesce(so.digest, '') = coalesce(sn.digest, '') THEN '' ELSE {q(G.LOCKED[0])} END AS message
  FROM templates LEFT JOIN so USING (template_id) LEFT JOIN sn USING (template_id)""", "templates template_fields")
def _(t):
    new = t.template_fields.where("not (template_key % 6 = 0 and field_pos = 7)").withColumn(
        "field_label", F.expr("CASE WHEN template_key % 4 = 1 AND field_pos = 3 THEN field_label || ' (new)' ELSE field_label END"))
    return G.validate_locked(t.templates, t.template_fields, new)


@query("d25_changed_sections", f"""WITH changed AS ({_CHANGED}), {_sig_sql('so', 'template_fields')}, {_sig_sql('sn', 'changed')}
  SELECT template_id, section_pos, CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM so_s o FULL JOIN sn_s n USING (template_id, section_pos) WHERE o.digest IS DISTINCT FROM n.digest""", "template_fields")
def _(t):
    new = t.template_fields.where("not (template_key % 6 = 0 and field_pos = 7)").withColumn(
        "field_label", F.expr("CASE WHEN template_key % 4 = 1 AND field_pos = 3 THEN field_label || ' (new)' ELSE field_label END"))
    return G.changed_sections(t.template_fields, new)


@query("p11_rows_by_page", f"""
  WITH rt0 AS (SELECT doc_id, table_index, row_no, list({_TXT} ORDER BY pos) AS a FROM cells GROUP BY ALL),
  rt AS (SELECT doc_id, table_index, row_no, array_to_string(list_filter(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]), lambda x: x <> ''), chr(9)) AS row_text FROM rt0),
  nd AS (SELECT doc_id, block_seq::BIGINT * 2147483648 AS seq, {_TXT} AS text, false AS is_row FROM blocks WHERE block_type <> 'table' AND {_TXT} <> ''
     UNION ALL SELECT doc_id, block_seq::BIGINT * 2147483648 + row_no, row_text, true FROM rt JOIN table_blocks USING (doc_id, table_index) WHERE row_text <> ''),
  nk AS (SELECT doc_id, seq, text, is_row, {O.norm('text')} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM nd),
  pg AS (SELECT doc_id, page_number, {O.norm('text')} AS norm FROM document_pages),
  lc AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, 1::BIGINT AS cursor_, NULL::BIGINT AS seq, NULL::VARCHAR AS text, false AS is_row FROM pg
    UNION ALL SELECT doc_id, k, coalesce(hit, cursor_), seq, text, is_row FROM (
      SELECT nk.doc_id, nk.k, lc.cursor_, nk.seq, nk.text, nk.is_row, min(pg.page_number) FILTER (WHERE pg.page_number >= lc.cursor_ AND contains(pg.norm, nk.key)) AS hit
      FROM lc JOIN nk ON nk.doc_id = lc.doc_id AND nk.k = lc.k + 1 JOIN pg ON pg.doc_id = nk.doc_id GROUP BY ALL))
  SELECT doc_id, CAST(cursor_ AS INTEGER) AS page_number, seq, text AS row_text FROM lc WHERE is_row""", "blocks cells table_blocks document_pages")
def _(t):
    return D.rows_by_page(t.blocks, P.table_row_texts(t.cells), T.number_tables(t.blocks), t.document_pages)
