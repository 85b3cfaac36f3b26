"""A training-data pipeline over the documents table: each stage calls one operator of paperweft.llm.

Language ID, exact dedup, near-duplicate dedup, benchmark decontamination, source mixing. Every stage
but the last returns the columns of documents; each is written and read again before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperweft.llm import decontaminate, digests, jaccard, language, mixing
from paperweft.llm.queries import MIX_SQL
from paperweft.llm.store import stored, with_row_key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go: NULL and empty texts, and texts without a letter.

    Where no row has a label and text to learn from, every text with a letter stays. Rows are judged each, so repeated rows and
    rows without an id share their text's fate; an empty table stays empty. All columns are kept, whatever their names.
    """
    model = language.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(language.predictor(docs, model)(F.col("text"))["lang_pred"] != language.UNKNOWN)


def _first_rows(rows: DataFrame, key: str, group: str, members: DataFrame) -> DataFrame:
    """Rows of ``rows`` that come first in their group: smallest doc_id, NULL last, then the row key. ``members``: key, doc_id, group."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("at")))
    first = members.groupBy(group).agg(best.alias("best")).select(F.col("best.at").alias(key))
    return rows.join(first, key, "left_semi").drop(key)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white-space runs count as one space, NULL as empty) one row stays: the smallest doc_id, NULL last.

    Rows are told apart by a key of their own, so a row without an id stays if its text is unique, of repeated rows one stays,
    and two texts under one doc_id are two documents. An empty table stays empty.
    """
    rows, key = with_row_key(docs)
    index = digests.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}")
    found = digests.dedup(rows, index, carry=(key,))
    return _first_rows(rows, key, "text_sha256", found.select("doc_id", "text_sha256", key))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: the smallest doc_id, NULL last.

    Groups are those of rows (a row key stands for the id), so rows without an id and repeated rows take part like
    others. NULL and blank texts have no shingles and stay. An empty table stays empty.
    """
    rows, key = with_row_key(docs)
    groups = jaccard.near_duplicates(rows, size=5, percent=80, doc_id=key)
    members = groups.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, "doc_id"), key)
    return _first_rows(rows, key, "component_id", members)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any hit of a benchmark window go: the coverage limit is 0.

    NULL and blank texts hold no words and stay; rows are judged each. An empty table stays empty, an empty benchmark removes nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_coverage=0.0)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document.

    NULL text has size 0, a NULL source is a source, repeated rows count each; an empty table gives no rows.
    """
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("mixing_weights", mixing_weights)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
with recursive a as materialized (
  select doc_id as given, row_number() over (order by doc_id nulls last) as doc_id, text, lang, source from documents where regexp_matches(text, '\p{{L}}')),
b as materialized (select * from a where doc_id in (select min(doc_id) from a group by regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))),
text_words as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from b),
grams as (
  select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from text_words),
sizes as (select doc_id, count(*) as size from grams group by 1),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as both_have from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * both_have >= 80 * (x.size + y.size - both_have)),
e as materialized (select a, b from links union select b, a from links),
r(doc_id, c) as (select doc_id, doc_id from b union select r.doc_id, e.b from r join e on e.a = r.c),
c as (select * from b where doc_id in (select doc_id from r group by doc_id having min(c) = doc_id)),
words as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from c),
items as (select regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
windows as (
  select distinct unnest(case when len(w) = 0 then [] when len(w) < 10 then [w] else list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) end) as s from items),
lengths as (select distinct len(s) as k from windows),
hit as (
  select distinct doc_id from (select doc_id, w[i:i + k - 1] as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, lengths))
  join windows using (s)),
documents_left as (select given as doc_id, source, text from c where doc_id not in (select doc_id from hit)),
""" + MIX_SQL.replace("{documents}", "documents_left")
