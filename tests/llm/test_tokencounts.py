"""Rollup: repeated batches, deletes, moves between sources, a run that dies half-way, empty tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from paperweft.llm import tokencounts

SCHEMA = "doc_id long, source string, lang string, tokenizer string, tokens long"


@pytest.fixture
def rollup(spark):
    return tokencounts.Rollup(spark, f"rollup_{uuid.uuid4().hex}")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_changes(spark, rollup):
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert totals(rollup) == {}
    assert rollup.commit("1", df((1, "a", "x", "t", 5), (2, "a", "x", "t", 7), (3, None, None, "t", 1), (None, "a", "x", "t", 2), (None, "a", "x", "t", 4)))
    assert totals(rollup) == {("a", "x", "t"): (3, 16), (None, None, "t"): (1, 1)}
    assert not rollup.commit("1", df((1, "a", "x", "t", 500)))
    assert rollup.commit("2", df((1, "b", "x", "t", 6), (3, None, None, "t", None), (9, "a", "x", "t", None)))  # moves, delete, delete of an absent one
    assert totals(rollup) == {("a", "x", "t"): (2, 11), ("b", "x", "t"): (1, 6)}
    assert rollup.commit("3", df((1, "b", "x", "t", 2), (1, "b", "x", "t", 8), (3, "c", "y", "t", 0)))  # the greatest of two, insert again
    assert totals(rollup) == {("a", "x", "t"): (2, 11), ("b", "x", "t"): (1, 8), ("c", "y", "t"): (1, 0)}
    assert rollup.commit("4", spark.createDataFrame([], SCHEMA)) and rollup.commit("5", df((1, "b", "x", "u", 3)))
    assert totals(rollup)[("b", "x", "u")] == (1, 3) and rollup.entries().count() == 5


def test_run_that_dies_between_entries_and_rollup(spark, rollup, monkeypatch):
    first = spark.createDataFrame([(1, "a", "x", "t", 5)], SCHEMA)
    rollup.commit("1", first)
    second = spark.createDataFrame([(1, "a", "x", "t", 9), (2, "a", "x", "t", 1)], SCHEMA)
    write = tokencounts.Rollup._write

    def dies(self, kind, rows, batch):
        if kind == "deltas":
            raise RuntimeError("lost")
        write(self, kind, rows, batch)

    monkeypatch.setattr(tokencounts.Rollup, "_write", dies)
    with pytest.raises(RuntimeError):
        rollup.commit("2", second)
    monkeypatch.undo()
    assert totals(rollup) == {("a", "x", "t"): (1, 5)} and rollup.entries().count() == 1
    assert rollup.commit("2", second) and totals(rollup) == {("a", "x", "t"): (2, 10)}
    assert rollup.entries().agg(F.sum("tokens")).first()[0] == 10
