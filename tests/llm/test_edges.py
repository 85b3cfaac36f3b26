"""Every operator with SQL against it on a table of edge cases; empty tables; held-out accuracy of the languages."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperweft.llm import decontaminate, digests, language, lines, mixing, queries, repeats
from paperweft.llm.store import stored

SQL = queries.ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}
RUN = queries.QUERIES | {"pipeline": corpus_pipeline.run}


def table(name):
    return pq.read_table(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return made(tmp_path_factory, False)


@pytest.fixture(scope="module")
def odd_ids(tmp_path_factory):
    return made(tmp_path_factory, True)


def made(tmp_path_factory, ids):
    """Documents with nulls, blank, repeated and very long texts, all-null rows and columns named like the operators' own."""
    path = tmp_path_factory.mktemp("edges")
    docs, items = table("documents"), table("benchmark")
    rows = docs.slice(0, 60).to_pylist()
    blank = dict.fromkeys(docs.column_names)
    item = next(x["text"] for x in items.to_pylist() if len((x["text"] or "").split()) > 20)
    longest = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
    line = "worker failed with code 17 after retry\n"
    texts = [None, "", " \t\n", "x", "One  two", "one two", "1 2 3", rows[0]["text"], (rows[1]["text"] or "") + " tail", "q " * 700, longest, longest + " end",
             "before " + item + " after", item.upper(), line + "é ü", line * 3, "other\n" + line.replace("17", "18"), " ", "ab" * 300]
    rows += [blank | {"doc_id": 10_000 + i, "text": t, "source": [None, "a", "b"][i % 3]} for i, t in enumerate(texts)]
    if ids:  # rows without an id, repeated rows, two texts under one id
        alone = "a text that no other row of this table holds, whichever row comes first"
        rows += [blank | {"text": alone, "source": "a"}, blank | {"text": rows[2]["text"]}, rows[3], rows[3], blank | {"text": item.lower()}, blank | {"text": None}]
        rows += [blank | {"doc_id": 20_000, "text": f"the {w} text under one and the same number, told apart by its words alone"} for w in ("first", "second")]
    edge = pa.Table.from_pylist(rows, docs.schema)
    for extra in ("key", "n", "size", "component_id", "digest", "line_no", "match", "_match", "_language", "row_key", "row", "r"):
        edge = edge.append_column(extra, pa.array([None if i % 2 else "z" for i in range(len(rows))]))
    pq.write_table(edge, path / "documents.parquet")
    none = dict.fromkeys(items.column_names)
    more = [none | {"item_id": items["item_id"][0].as_py()}, none | {"item_id": items["item_id"][1].as_py(), "text": ""}]
    pq.write_table(pa.Table.from_pylist(items.to_pylist() + more, items.schema), path / "benchmark.parquet")
    vectors = table("embeddings").slice(0, 120)
    bad = [None, [], [0.5], [None] * 64, [float("nan")] * 64, [0.25] * 63 + [float("inf")], [0.25] * 64, [0.25] * 64, [0.25] * 64]
    more = [{"vec_id": i, "embedding": x, "label": None} for i, x in zip((1000, 1050, 1100, 1150, 1200, 1250, 1300, 1300, None), bad)]
    more += [{"vec_id": 2000 + i, "embedding": [0.5, -0.5] * 32, "label": i} for i in range(60)]
    every = pa.concat_tables([vectors, pa.Table.from_pylist(more, vectors.schema)])
    pq.write_table(every.append_column("rank", pa.nulls(len(every), pa.int32())).append_column("x", pa.nulls(len(every), pa.int32())), path / "embeddings.parquet")
    return str(path)


def normal(rows):
    return sorted(repr([(k, round(v, 6) if isinstance(v, float) else v) for k, v in sorted(r.items())]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_edge_cases_equal_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"create view {t} as from '{folder}/{t}.parquet'")
    want = db.execute(SQL[name])
    names = [c[0] for c in want.description]
    expected = [dict(zip(names, r)) for r in want.fetchall()]
    got = [r.asDict() for r in RUN[name](spark, folder).select(*names).collect()]
    assert expected and normal(got) == normal(expected)


def test_pipeline_with_odd_ids(spark, odd_ids):
    test_edge_cases_equal_sql(spark, odd_ids, "pipeline")
    docs = spark.read.parquet(f"{odd_ids}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), odd_ids)
        assert empty.count() == 0 and (name == "mixing_weights" or empty.columns == docs.columns)
    for stage in (corpus_pipeline.language_id, corpus_pipeline.exact_dedup, corpus_pipeline.decontamination):
        docs = stored(stage(spark, docs, odd_ids))
        texts = [r.text for r in docs.where("doc_id is null").collect()]
        assert any("no other row" in (t or "") for t in texts) and docs.where("doc_id = 20000").count() == 2
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), odd_ids).count() == docs.count()


def test_spans_are_cut_by_length_and_coverage(spark):
    items = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(14))), (2, "only four words here"), (3, None)], "item_id long, text string")
    inside = "One, two.  " + " ".join(f"T{i}" for i in range(14)) + "!  Three"
    rows = [(1, inside, "z"), (2, "keep, only four WORDS here; and seven more words that are clean", "z"), (3, inside.replace("One", "x " * 40), "z"), (4, None, "z"), (None, "", "z"),
            (5, " ".join(f"t{i}" for i in range(14)), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, match string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items, size=10, min_span=10, max_coverage=0.9).collect()}
    assert set(got) == {1, 2, 3, 4, None} and got[1].match == "z"
    assert got[1].text == "One, two.  !  Three" and got[2].text == rows[1][1] and got[3].text == ("x " * 40 + ", two.  !  Three") and got[4].text is None
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items, max_coverage=0.5).collect()} == {2, 3, 4, None}
    short = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, min_span=4, max_coverage=0.5).collect()}
    assert short[2] == "keep, ; and seven more words that are clean"


def test_empty_tables(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    none = docs.where("false")
    assert language.identify(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert lines.drop_templates(none).count() == 0
    assert repeats.remove(none, repeats.Unit("byte", 100, 32)).count() == 0 and repeats.remove(none, repeats.Unit("word", 20, 8)).count() == 0
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.matches(docs, items.where("false")).where("match.n_hit > 0").count() == 0
    assert digests.dedup(none, digests.DigestIndex(spark, "edges_empty")).count() == 0


def test_index_persists(spark):
    index = digests.DigestIndex(spark, "edges_index", buckets=4)
    first = spark.createDataFrame([(5, "a  b"), (6, None), (7, "c")], "doc_id long, text string")
    later = spark.createDataFrame([(1, "a b"), (2, ""), (3, "new"), (4, "new")], "doc_id long, text string")
    assert digests.dedup(first, index).where("kept").count() == 3
    index.compact()
    spark.sql("ALTER TABLE edges_index RENAME TO edges_index_old")  # as if a compaction had died
    index.recover()
    got = {r.doc_id: (r.keep_id, r.kept) for r in digests.dedup(later, index).collect()}
    assert got == {1: (5, False), 2: (6, False), 3: (3, True), 4: (3, False)}
    assert index.rows().count() == 4


def test_language_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op1_language_mixture"](spark, path).join(docs, "doc_id").where("held_out and lang is not null")
    share = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert share >= 0.9, share


def line_docs(spark, n, kinds):
    """``n`` documents with one line of a template with two variable fields, a short line, numbers and a line of their own."""
    rows = [(i, f"worker failed on host h{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x{'uvwxyz'[i // 100 % 6]}{i // 600 * 'z'} in region r{'abcdefghij'[i % kinds]} after retry\n"
             f"All rights reserved.\n{i + 10_000} {i}\n7 7\nown {'abcdefghij'[i % 10]} line {'abcdefghij'[i // 10 % 10]} of {i} {'q' * (i + 1)} kind", None) for i in range(n)]
    return spark.createDataFrame(rows + [(None, "All rights reserved.", None), (n, "\n \n", None), (n + 1, None, None)], "doc_id long, text string, template string")


@pytest.mark.parametrize("n", [40, 2000])
def test_templates_at_two_sizes(spark, n):
    got = {r.doc_id: r for r in lines.drop_templates(line_docs(spark, n, 4)).collect()}
    assert len(got) == n + 3
    for i in range(n):
        kept = got[i].kept.split("\n")
        assert len(kept) == 2 and kept[0] == f"{i + 10_000} {i}" and kept[1].startswith("own "), kept
    assert (got[None].n_dropped, got[n].n_dropped, got[n + 1].n_lines) == (0, 0, 1)
