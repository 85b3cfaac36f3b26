"""Queries over small made tables, compared with their SQL: what the given data at the small sizes doesn't hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_queries import FOLDER, norm
from workload import stream_queries


@pytest.fixture
def agree(spark, tmp_path):
    """``agree(names, table=DataFrame, ...)``: the queries equal their SQL over these tables, each a folder of files."""
    def run(names, **tables):
        con = duckdb.connect()
        for n, df in tables.items():
            df.write.parquet(f"{tmp_path}/{n}.parquet")
            con.execute(f"create view {n} as select * from '{tmp_path}/{n}.parquet/*.parquet'")
        for name in names.split():
            df = entry.queries()[name](spark, str(tmp_path))
            got = sorted("|".join(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
            cur = con.execute(entry.oracle_sql()[name])
            at = sorted((d[0], i) for i, d in enumerate(cur.description))
            assert [c for c, _ in at] == sorted(df.columns)
            assert got == sorted("|".join(norm(r[i]) for _, i in at) for r in cur.fetchall()) and got
    return run


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_streams_read_tables_of_several_files(spark, agree):
    """a table that is a folder of files."""
    agree("t1_page_summaries", documents=docs(spark, "a: 1\nb | c", "", "x").repartition(3))


def test_a_range_arrives_after_all_before_it(spark, tmp_path):
    """what isn't written yet cannot be read too early, whatever the times of the files."""
    t = type("T", (), {"spark": spark})
    events = spark.range(400).select(F.timestamp_seconds(F.col("id") * 7919 % 400 * 60).alias("ts"))
    seen = [spark.read.parquet(f"{tmp_path}/in").agg(F.count("*"), F.max("ts")).first() for _ in stream_queries._arrivals(t, events, tmp_path, 4, "ts")]
    assert [n for n, _ in seen] == [100, 200, 300, 400] and [int(m.timestamp()) // 60 for _, m in seen] == [99, 199, 299, 399]


def test_preview_keeps_a_line_break_at_its_limit(spark, agree):
    """F8: a piece of limit - 1 characters, with one after it."""
    agree("p9_text_preview", documents=docs(spark, "x" * 1999 + "\ny", "x" * 2000 + "\ny", "x" * 1998 + "\ny"), part=spark.read.parquet(f"{FOLDER}/part.parquet"))


def test_references_in_pages_as_in_sql(spark, agree):
    """references cut off before their semicolon, others than the four, one resolved only once."""
    body = ["a &amp", "&amp;&amp;&amp x &lt;b&gt;", "&amp;quot; &quot;q&quot; &copy; &nbsp;", "k: v &middot &middot;"]
    html = "<article>" + "".join(f"<p>{b}</p><li>{b} {i}</li>" for i, b in enumerate(body)) + "</article>"
    pages = spark.createDataFrame([(i, "u", html) for i in range(1, 12)], "page_id long, url string, html string")
    agree("x15_html_plain p6_html_fields m6_fields_in_html m7_sections_for m8_page_preview", pages=pages, supplier=spark.read.parquet(f"{FOLDER}/supplier.parquet"))


def test_reports_name_what_they_count(spark, agree):
    """the signature's text, the projects' names and the unfilled fields are part of the result."""
    given = {n: spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("supplier", "orders", "customer", "lineitem")}
    agree("d24_schema_signature c4_delete_plan u5_population_report", **given)
    for name, column in (("d24_schema_signature", "signature"), ("c4_delete_plan", "projects"), ("u5_population_report", "unfilled")):
        assert entry.queries()[name](spark, FOLDER).where(F.col(column) != "").count()


def test_only_labels_are_broadcast(spark):
    """outputs and their rows grow with the input; none of them goes through the driver."""
    for name, labels in (("e10_validate_errors", 1), ("e10_validate_accepted", 2)):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
        assert len(joins) == plan.count("BroadcastExchange") == labels and all("BuildRight" in x and "expected_id" in x for x in joins)


def test_short_needles_by_the_ends_of_words(spark):
    """needles of one and two words, by their scope, against comparing every pair."""
    from paperweft.operators.substring import substring_hits

    texts = [(1, 1, "the relay xab cdy x"), (1, 2, "ab cd abc"), (2, 1, "relay"), (3, 1, "b c")]
    needles = [(s, n) for s in (1, 2) for n in ("ab cd", "b c", "relay", "ela", "x", "y x", "lay xa", "the relay xab", "q")]
    got = substring_hits(spark.createDataFrame(texts, "s int, p int, text string"), ["p"], spark.createDataFrame(needles, "s int, needle string"), ["s"])
    assert sorted((r.s, r.p, r.needle) for r in got.collect()) == sorted((s, p, n) for s, p, t in texts for z, n in needles if s == z and n in t)
