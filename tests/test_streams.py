"""Streams over several micro-batches, with late rows, restarts and repeated micro-batches."""

import glob
import os

from pyspark.sql import functions as F

from paperweft.operators import extract as E
from paperweft.sources import files as S
from paperweft.streaming import flows as W

EDITS = "ts timestamp, edit_id long, job_id int, field_id string, value string, validation_status string"


def drain(q):
    q.awaitTermination()
    assert q.exception() is None


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).selectExpr("timestamp_seconds(ts) as ts", "* except (ts)").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def versions(folder):
    return {tuple(p.split(os.sep)[-2:]) for p in glob.glob(f"{folder}/data/version=*/bucket=*")}


def test_edits_over_micro_batches_restart_and_replay(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = EDITS.replace("timestamp", "long")
    log = [[(10 * i + 1, i, 1, "a", f"v{i}", "verified"), (10 * i + 2, 100 + i, i, "b", None, "review")] for i in range(3)]
    for rows in log:
        arrive(spark, src, rows, schema)
    drain(W.fold_edit_stream(stream(spark, src), out, cp, buckets=8))
    late = [(5, 900, 1, "a", "late", "rejected"), (5, 901, 7, "z", "first", "pending"), (99, 902, 7, "z", None, "bogus")]
    arrive(spark, src, late, schema)  # an edit older than the state's, after a restart
    before = versions(out)
    drain(W.fold_edit_stream(stream(spark, src), out, cp, buckets=8))

    def same():
        fields = lambda df: sorted(map(tuple, df.select("job_id", "field_id", "validation_status", "value").collect()), key=str)
        batch = E.fold_edits(spark.read.parquet(src).withColumn("ts", F.col("ts"))).select("job_id", "field_id", F.col("new_status").alias("validation_status"), F.col("new_value").alias("value"))
        return fields(W.edit_state(out, 8).current(spark)) == fields(batch)

    assert same()
    assert W.edit_state(out, 8).current(spark).where("job_id = 1 and field_id = 'a'").first().value == "v2"
    new = {b for v, b in versions(out) if v == "version=3"}
    assert 1 <= len(new) <= 2 and before - versions(out) != before  # only the buckets of (1, a) and (7, z) were written again
    state = W.edit_state(out, 8)
    again = spark.read.schema(state.current(spark).schema).parquet(f"{out}/batch/version=3")
    rows = spark.createDataFrame(again.collect(), again.schema)
    state.apply(rows, 3)
    state.apply(rows, 3)
    assert same()
    drain(W.fold_edit_stream(stream(spark, src), out, cp, buckets=8))  # nothing new
    assert same()


def test_replaced_files_go(spark, tmp_path):
    out = str(tmp_path / "state")
    state = W.progress_state(out, 2)
    row = lambda i: spark.createDataFrame([(1, 1, 1, 5, i > 3, None, (i, i))], "job_id int, chunk_no int, first_page int, last_page int, done boolean, error string, at struct<ts: int, id: int>")
    for i in range(6):
        state.apply(row(i), i)
    assert state.current(spark).first().done and len(versions(out)) <= 2
    state.apply(row(0).where("false"), 6)
    assert state.current(spark).count() == 1


def test_progress_of_jobs(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "ts long, report_id long, job_id int, chunk_no int, first_page int, last_page int, done boolean, error string"
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id int")
    seen = lambda: {r.job_id: (r.status, r.progress) for r in W.job_progress(jobs, out).collect()}
    arrive(spark, src, [(1, 1, 1, 1, 1, 5, False, None), (1, 2, 1, 2, 6, 9, False, None), (1, 3, 2, 1, 1, 5, False, None)], schema)
    drain(W.progress_stream(stream(spark, src), out, cp))
    assert seen() == {1: ("processing", 0), 2: ("processing", 0), 3: ("failed", 0)}
    arrive(spark, src, [(2, 4, 1, 1, 1, 5, True, None), (2, 5, 2, 1, 1, 5, True, "timed out")], schema)
    drain(W.progress_stream(stream(spark, src), out, cp))
    assert seen() == {1: ("processing", 50), 2: ("failed", 99), 3: ("failed", 0)}
    arrive(spark, src, [(3, 6, 1, 2, 6, 9, True, "lost"), (1, 0, 1, 1, 1, 5, False, "too late")], schema)
    drain(W.progress_stream(stream(spark, src), out, cp))
    assert seen()[1] == ("completed", 100)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    day = 86_400
    schema = "ts long, kind string"
    arrive(spark, src, [(1 * day + 5, "a"), (2 * day + 5, "a")], schema)
    run = lambda: drain(W.write_counts(W.activity_counts(stream(spark, src), "kind", "2 days", "1 day", "1 hour"), out, cp))
    run()
    arrive(spark, src, [(2 * day - 5, "a"), (6 * day, "b")], schema)  # the first is older than the newest by more than an hour, but its windows are open
    run()
    arrive(spark, src, [(1 * day + 9, "late"), (9 * day, "b")], schema)  # every window of the first is closed
    run()
    got = {(int(r.window_start.timestamp()) // day, r.kind): r.n for r in spark.read.parquet(out).collect()}
    assert got == {(0, "a"): 2, (1, "a"): 3, (2, "a"): 1, (5, "b"): 1, (6, "b"): 1}


def test_intake_of_files(spark, tmp_path, monkeypatch):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    os.makedirs(f"{src}/deep")

    def put(name, data):
        with open(f"{src}/{name}", "wb") as f:
            f.write(data)

    monkeypatch.setattr(W.K, "MAX_UPLOAD_BYTES", 40)
    put("a.PDF", b"one\ntwo\fthree")
    put("deep/b.docx", b" ")
    put("c.exe", b"xx")
    put("d.pdf", b"y" * 41)
    run = lambda: drain(W.intake_stream(W.incoming_files(spark, src, 2), out, cp))
    run()
    run()  # nothing new: no file counts twice
    put("e.png", b"late\xff")
    run()
    name = F.regexp_extract("path", "[^/]*$", 0).alias("n")
    got = lambda x, *c: sorted(map(tuple, spark.read.parquet(f"{out}/{x}").select(name, *c).collect()))
    assert got("documents", "file_type", "upload_status") == [("a.PDF", "pdf", "uploaded"), ("b.docx", "docx", "uploaded"), ("e.png", "png", "uploaded")]
    assert got("rejects", "reject_reason") == [("c.exe", "Unsupported file type"), ("d.pdf", "File too large")]
    assert [(n, p, c) for n, p, c in got("pages", "page_number", "line_count")] == [("a.PDF", 1, 2), ("a.PDF", 2, 1), ("b.docx", 1, 0), ("e.png", 1, 1)]
    once = S.intake(S.read_incoming(spark, src))
    assert once.where("reject_reason is null").count() == 3 and once.count() == 5


def test_files_of_a_batch_grow_with_the_table(spark, tmp_path):
    from types import SimpleNamespace

    from workload.stream_queries import _in_files

    for parts, files in ((20, 20), (1, 5)):
        _in_files(SimpleNamespace(spark=spark), spark.range(0, 1000, 1, parts), f"{tmp_path}/{parts}", 5)
        assert len(list((tmp_path / str(parts) / "in").glob("*.parquet"))) == files
