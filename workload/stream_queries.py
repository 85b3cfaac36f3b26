"""T: streams, drained to completion and compared with the batch result."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from paperweft.streaming import flows as W

from . import oracle as O
from .derived import EDIT_COLUMNS, _sel
from .registry import query


def _stream(t, table):
    """Stream of the files of a table, which is one file or a folder of files; a stream reads a lone file by pattern only."""
    given = getattr(t, table)
    return t.spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{t.sf_dir}/{table}.parque[t]")


def _scratch(t):
    """Stream output goes next to the shared checkpoints; a local session without any uses /tmp."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/streams-{uuid.uuid4().hex}"


def _in_files(t, df, base, n):
    """Stream of ``df``, which arrives in ``n`` micro-batches, in any order. A batch has more files, so more tasks, the larger ``df`` is."""
    each = max(1, -(-df.rdd.getNumPartitions() // n))
    df.repartition(n * each).write.parquet(f"{base}/in")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(f"{base}/in")


def _arrivals(t, df, base, n, ts):
    """Yields a stream ``n`` times, after the next range of ``ts`` has been written: what comes later is never older.

    Files that are written together may be read in any order, so a range only arrives once the stream has read all before it.
    """
    cuts = df.agg(F.percentile_approx(F.unix_micros(ts), [i / n for i in range(1, n)], 10_000)).first()[0] or []
    turn = sum((F.when(F.unix_micros(ts) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(n):
        df.where(turn == i).write.mode("append").parquet(f"{base}/in")
        yield t.spark.readStream.schema(df.schema).parquet(f"{base}/in")


def _drain(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("t1_page_summaries", f"""
  SELECT doc_id, CAST(len(ls) AS INTEGER) AS line_count, CAST(len(list_filter(ls, lambda l: len({O.row_cells('l')}) >= 2)) AS INTEGER) AS table_count FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {O.strip('l')}), lambda l: l <> '') AS ls FROM documents)""")
def _(t):
    base = _scratch(t)
    pages = _stream(t, "documents").select("doc_id", "text")
    _drain(W.page_summaries(pages, os.path.join(base, "out"), os.path.join(base, "cp")))
    return t.spark.read.parquet(os.path.join(base, "out")).select("doc_id", "line_count", "table_count")


FILE_COLUMNS = [
    ("path", "'/in/' || coalesce(source, 'none') || '/' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' WHEN 3 THEN 'tiff' ELSE 'tar.gz' END"),
    ("size", "CASE WHEN doc_id % 7 = 0 THEN 524288001 ELSE 524288000 - doc_id % 1000 END"),
    ("content", "encode(coalesce(text, ''), 'utf-8')"),
]


@query("t1_stream_intake", f"""
  WITH f AS (SELECT {FILE_COLUMNS[0][1]} AS path, {FILE_COLUMNS[1][1]} AS size, coalesce(text, '') AS text, doc_id % 5 IN (0, 1, 3) AS known FROM documents),
  p AS (SELECT path, unnest(string_split(text, chr(10))) AS text FROM f WHERE known AND size <= 524288000),
  n AS (SELECT path, count(*) AS pages, CAST(sum(CASE WHEN {O.strip('text')} <> '' THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM p GROUP BY 1)
  SELECT path, CASE WHEN known AND size <= 524288000 THEN lower(regexp_extract(path, '[^.]*$')) END AS file_type,
    CASE WHEN NOT known THEN 'Unsupported file type' WHEN size > 524288000 THEN 'File too large' END AS reject_reason, pages, lines
  FROM f LEFT JOIN n USING (path)""")
def _(t):
    """Documents as files of several types and sizes arrive in five micro-batches; a page is a line here."""
    base = _scratch(t)
    files = t.documents.selectExpr(*[f"{e} AS {n}" for n, e in FILE_COLUMNS], "timestamp'2024-01-01' AS modified")
    _drain(W.intake_stream(_in_files(t, files, base, 5), f"{base}/out", f"{base}/cp", page_break="\n"))
    documents, rejects, pages = (t.spark.read.parquet(f"{base}/out/{x}") for x in ("documents", "rejects", "pages"))
    n = pages.groupBy("path").agg(F.count("*").alias("pages"), F.sum("line_count").alias("lines"))
    kept = documents.join(n, "path", "left").select("path", "file_type", F.lit(None).cast("string").alias("reject_reason"), "pages", "lines")
    none = F.lit(None).cast("long")
    return kept.unionByName(rejects.select("path", F.lit(None).cast("string").alias("file_type"), "reject_reason", none.alias("pages"), none.alias("lines")))


@query("t2_fold_edit_stream", """
  SELECT job_id, field_id, arg_max(validation_status, (ts, edit_id)) AS validation_status, arg_max(value, (ts, edit_id)) FILTER (WHERE value IS NOT NULL) AS value FROM field_edits
  WHERE validation_status IN ('pending', 'verified', 'missing', 'review', 'rejected') GROUP BY 1, 2""", "field_edits")
def _(t):
    base = _scratch(t)
    edits = t.events.selectExpr(*_sel(EDIT_COLUMNS))
    _drain(W.fold_edit_stream(_in_files(t, edits, base, 4), f"{base}/state", f"{base}/cp"))
    return W.edit_state(f"{base}/state").current(t.spark).select("job_id", "field_id", "validation_status", "value")


@query("t3_activity_counts", "SELECT epoch_us(date_trunc('day', ts)) // 86400000000 AS day_no, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    base = _scratch(t)
    events = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    _drain(W.write_counts(W.activity_counts(events, "event_type"), f"{base}/counts", f"{base}/cp", "complete"))
    counts = t.spark.read.parquet(f"{base}/counts")
    newest = counts.agg(F.max("version").alias("version"))
    return counts.join(newest, "version").select(F.floor(F.unix_seconds("window_start") / 86400).alias("day_no"), "event_type", "n")


@query("t3_sliding_counts", """
  WITH late AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
  days AS (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) - INTERVAL 6 DAY FROM events), (SELECT max(ts) FROM events), INTERVAL 1 DAY)) AS day),
  w AS (SELECT day, event_type, count(*) AS n FROM days JOIN events ON ts >= day AND ts < day + INTERVAL 7 DAY GROUP BY 1, 2)
  SELECT epoch_us(day) // 86400000000 AS day_no, event_type, n FROM w, late WHERE day + INTERVAL 7 DAY <= mark""")
def _(t):
    """Seven-day windows, one a day, each written once its end is an hour behind the newest event."""
    base = _scratch(t)
    events = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for arrived in _arrivals(t, events, base, 4, "ts"):
        counts = W.activity_counts(arrived, "event_type", "7 days", "1 day")
        _drain(W.write_counts(counts, f"{base}/counts", f"{base}/cp"))
    return t.spark.read.parquet(f"{base}/counts").select(F.floor(F.unix_seconds("window_start") / 86400).alias("day_no"), "event_type", "n")


_REPORTS = [
    ("ts", "ts"), ("report_id", "event_id"), ("job_id", "user_id"), ("chunk_no", "cast(event_id % 6 + 1 as int)"), ("first_page", "cast(event_id % 6 * 5 + 1 as int)"),
    ("last_page", "cast(event_id % 6 * 5 + 5 as int)"), ("done", "event_type <> 'view' OR user_id % 3 = 0"),
    ("error", "CASE WHEN event_type = 'error' OR user_id % 10 = 9 THEN 'attempt ' || event_id END"),
]


@query("t3_job_progress", f"""
  WITH r AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _REPORTS)} FROM events),
  c AS (SELECT job_id, chunk_no, unnest(arg_max({{'first_page': first_page, 'last_page': last_page, 'done': done, 'error': error}}, (ts, report_id))) FROM r GROUP BY 1, 2),
  a AS (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE done) AS d, count(error) AS f,
    string_agg('pages ' || first_page || '-' || last_page || ': ' || error, '; ' ORDER BY chunk_no) FILTER (WHERE error IS NOT NULL) AS m FROM c GROUP BY 1)
  SELECT job_id, CASE WHEN d < total THEN 'processing' WHEN f = total THEN 'failed' ELSE 'completed' END AS status,
    CAST(CASE WHEN d = total AND f < total THEN 100 ELSE least(99, floor(d / total * 100)) END AS INTEGER) AS progress,
    CASE WHEN d = total AND f = total THEN 'Extraction failed for every page chunk: ' || m
      WHEN d = total AND f > 0 THEN 'Completed with ' || f || '/' || total || ' page chunk(s) unresolved after retries (fields from those pages need manual entry): ' || m END AS error_message
  FROM a""")
def _(t):
    base = _scratch(t)
    reports = t.events.selectExpr(*[f"{e} AS {n}" for n, e in _REPORTS])
    _drain(W.progress_stream(_in_files(t, reports, base, 3), f"{base}/state", f"{base}/cp"))
    return W.job_progress(reports.select("job_id").distinct(), f"{base}/state")
