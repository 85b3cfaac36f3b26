"""Incremental flows: intake and page analytics of arriving documents, edit log to state, job progress, rolling counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed as K
from ..operators.extract import job_status
from ..operators.pages import page_summary
from ..sources.files import intake
from .state import BUCKETS, BucketedState

PAGE_BREAK = "\f"


def incoming_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (path, size, modified, content) of files that land below ``folder``. Files without a byte are not seen."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def intake_stream(files: DataFrame, folder: str, checkpoint: str, page_break: str = PAGE_BREAK) -> StreamingQuery:
    """Accepted files, refused files and the pages of the accepted ones, below ``folder`` in ``documents``, ``rejects``, ``pages``.

    ``files``: a stream of path, size, modified, content (text). Each micro-batch feeds all three and has a sub-folder of
    its own in each, which a repeated micro-batch overwrites: every file counts once. The content of a refused file is
    not read. Pages end at ``page_break``; their summary columns come along.
    """
    def land(batch: DataFrame, number: int) -> None:
        seen = intake(batch.select("path", "size", "modified"))
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/version={number}")
        put(seen.where("reject_reason is null").drop("reject_reason"), "documents")
        put(seen.where("reject_reason is not null"), "rejects")
        accepted = intake(batch.where(F.col("size") <= K.MAX_UPLOAD_BYTES)).where("reject_reason is null")
        text = F.split(F.make_valid_utf8(F.col("content").cast("string")), page_break)
        pages = accepted.select("path", F.posexplode(text).alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)
        put(page_summary(pages), "pages")

    return files.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_summaries(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a summary per arriving page. ``pages`` is a stream with ``text``; the file sink and
    the checkpoint make each page appear exactly once."""
    return page_summary(pages).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def _net(log: DataFrame) -> DataFrame:
    """Last status and last given value with their positions, per (job_id, field_id)."""
    return log.groupBy("job_id", "field_id").agg(
        F.max("status_at").alias("status_at"), F.max_by("validation_status", "status_at").alias("validation_status"),
        F.max("value_at").alias("value_at"), F.max_by("value", "value_at").alias("value"))


def edit_state(folder: str, buckets: int = BUCKETS) -> BucketedState:
    """Net edits by (job_id, field_id), see ``fold_edit_stream``."""
    return BucketedState(folder, ["job_id", "field_id"], _net, buckets)


def fold_edit_stream(edits: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Reduce an edit log to net edits, kept as ``edit_state(folder)``.

    Every micro-batch is reduced on its own first; the state it meets has one row per edited field, and only the
    buckets that hold an edited field are rewritten. The last edit by (ts, edit_id) wins, however late it arrives.
    """
    at = F.struct("ts", "edit_id")
    log = edits.where(F.col("validation_status").isin(K.VALIDATION_STATUSES)).select(
        "job_id", "field_id", "validation_status", at.alias("status_at"), "value", F.when(F.col("value").isNotNull(), at).alias("value_at"))
    state = edit_state(folder, buckets)
    return log.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _last_chunk(rows: DataFrame) -> DataFrame:
    """Last report of every chunk, by its position ``at``."""
    return rows.groupBy("job_id", "chunk_no").agg(F.max_by(F.struct("first_page", "last_page", "done", "error", "at"), "at").alias("r")).select("job_id", "chunk_no", "r.*")


def progress_state(folder: str, buckets: int = BUCKETS) -> BucketedState:
    """Last report of every chunk, see ``progress_stream``; the buckets go by job."""
    state = BucketedState(folder, ["job_id"], _last_chunk, buckets)
    return state


def progress_stream(reports: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Follow chunk reports (ts, report_id, job_id, chunk_no, first_page, last_page, done, error), kept as ``progress_state(folder)``."""
    rows = reports.select("job_id", "chunk_no", "first_page", "last_page", "done", "error", F.struct("ts", "report_id").alias("at"))
    return rows.writeStream.foreachBatch(progress_state(folder, buckets).apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_progress(jobs: DataFrame, folder: str) -> DataFrame:
    """Status, progress and message of every job (job_id) as of the last micro-batch."""
    return job_status(jobs, progress_state(folder).current(jobs.sparkSession).drop("at"))


def activity_counts(events: DataFrame, key: str, width: str = "1 day", slide: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts per window and key. Rows later than ``late`` behind the newest are dropped by a stream."""
    window: Column = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def write_counts(counts: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Counts below ``folder``, one sub-folder a micro-batch: in ``append`` mode all of them together are the
    result, in ``complete`` mode the newest. A repeated micro-batch overwrites its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return counts.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
