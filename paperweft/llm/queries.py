"""Queries of the subpackage and, where SQL can express them, their oracle (DuckDB)."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, digests, jaccard, language, lines, mixing, periodic, pii, repeats, suffixes, tokencounts, topk, whitening
from .store import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Mixing of a table {documents} as common table expressions and a query.
MIX_SQL = r"""d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, md5('0:' || coalesce(doc_id::varchar, '')) as key from {documents}),
s as (select source, sum(size)::bigint as source_size, [3, 1, 2][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as weight from d group by source),
o as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as stop_level from s),
l as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level from o
  window before as (order by stop_level, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
w as (select *, max(case when level <= stop_level then level end) over () as water from l),
t as (select source, source_size, case when stop_level < water then cap else coalesce(water * weight, cap) end as target from w),
p as (
  select d.*, source_size, target, floor(target)::bigint as budget,
    coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
  (case when source_size > 0 then budget // source_size * size + greatest(0, least(size, budget % source_size - before)) else 0 end)::bigint as taken
from p
"""


@query("op1_language_mixture")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; held-out accuracy is tested in tests/llm."""
    return language.identify(table(spark, sf_dir, "documents")).drop("proportions")


_BYTES = repeats.Unit("byte", 100, 32)
_WORDS_OF = repeats.Unit("word", 20, 8)


@query("op2_byte_repeats", r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, md5(substr(h, (2 * i + 1)::int, 200)) as k from (select doc_id, h, unnest(range(n - 99)) as i from d)),
later as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as r from w) where r > 1),
runs as (
  select doc_id, min(i) as a, max(i) + 100 as b
  from (select *, sum(fresh) over (partition by doc_id order by i) as run
    from (select *, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as fresh from later))
  group by doc_id, run),
pieces as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as f, a as t from runs
  union all select d.doc_id, coalesce(max(b), 0), any_value(n) from d left join runs using (doc_id) group by 1),
kept as (select p.doc_id, string_agg(substr(h, (2 * f + 1)::int, (2 * (t - f))::int), '' order by f) as h from pieces p join d using (doc_id) group by 1),
cut as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from runs group by 1)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept.h)) as kept_sha256
from d join kept using (doc_id) left join cut using (doc_id)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside 100-byte strings that start earlier."""
    return repeats.remove(table(spark, sf_dir, "documents"), _BYTES, suffixes.context_bytes, suffixes.judge_suffixes).withColumnRenamed("n_items", "n_bytes")


@query("op3_exact_dedup", r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a fresh index, which it fills."""
    index = digests.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return digests.dedup(table(spark, sf_dir, "documents"), index)


@query("op4_word_repeats", r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
p as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
later as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as r from p) where r > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from later),
words as (select doc_id, unnest(range(1, len(w) + 1)) as j, unnest(w) as word from d),
kept as (select doc_id, string_agg(word, ' ' order by j) as text from words anti join gone using (doc_id, j) group by 1),
n as (select doc_id, count(*) as n_removed from gone group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id) left join n using (doc_id)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside 20-word windows that start earlier."""
    return repeats.remove(table(spark, sf_dir, "documents"), _WORDS_OF).withColumnRenamed("n_items", "n_words").drop("n_spans")


@query("op5_token_counts", r"""
with d as (
  select source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words,
    len(regexp_extract_all(coalesce(text, ''), '[0-9]+|[^\x00-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) as pieces from documents)
select source, lang, 'words-1' as tokenizer, count(*) as n_docs, sum(words)::bigint as n_tokens from d group by all
union all
select source, lang, 'pieces-1', count(*), sum(pieces)::bigint from d group by all
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents under two tokenizers, reached by inserts, revised counts, deletes and a repeated delivery.

    Documents with certain signs first get a provisional count, from the text without them, and then the right one;
    short documents are withdrawn and inserted again. The revision is delivered twice; the second changes nothing.
    """
    docs = table(spark, sf_dir, "documents")
    rollup = tokencounts.Rollup(spark, f"token_counts_{uuid.uuid4().hex}")
    signs = r"[|*%&#!]+"
    words = tokencounts.counted(docs, "words-1", F.regexp_replace("text", signs, " "))
    rollup.commit("insert", words.union(tokencounts.counted(docs, "pieces-1", F.col("text"))))
    revised = tokencounts.counted(docs.where(F.col("text").rlike(signs)), "words-1", F.col("text"))
    rollup.commit("revise", revised)
    short = stored(rollup.entries().join(rollup.entries().where("tokenizer = 'words-1' and tokens < 20").select("doc_id"), "doc_id", "left_semi"))
    rollup.commit("delete", short.withColumn("tokens", F.lit(None).cast("long")))
    rollup.commit("again", short)
    rollup.commit("revise", revised)
    return rollup.totals()


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op6_decontamination", rf"""
with d as (select doc_id, case when text is null then [] else {_WORDS} end as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where text is not null),
windows as (
  select item_id, unnest(case when len(w) = 0 then [] when len(w) < 10 then [w] else list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) end) as s from b),
lengths as (select distinct len(s) as n from windows),
places as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, lengths),
found as (select p.doc_id, p.i, p.n, x.item_id from places p join windows x on x.s = p.w[p.i:p.i + p.n - 1]),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from found) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from found) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words streamed through the automaton of all items."""
    m = F.col("match")
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", m.n_words.alias("n_words"), m.n_hit.alias("n_hit"), F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ",").cast("binary"), 256).alias("items_sha256"), (m.n_hit > 0).alias("contaminated"))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; base columns are tested against brute force in tests/llm."""
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.as_text(F.col("all")).alias("spans"))


@query("op8_jaccard_components", r"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g from d),
n as (select doc_id, count(*) as n_shingles from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as both_have from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_have >= 90 * (x.n_shingles + y.n_shingles - both_have)),
e as materialized (select a, b from l union select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from d union select r.doc_id, e.b from r join e on e.a = r.c)
select r.doc_id, coalesce(any_value(n_shingles), 0) as n_shingles, min(c) as component_id from r left join n using (doc_id) group by 1
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the join of all documents with themselves at a similarity of 0.9 on 3-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)


@query("op9_source_mix", "with " + MIX_SQL.replace("{documents}", "documents"))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_line_templates", r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (
  select doc_id, i as line_no, list_filter(regexp_split_to_array(ls[i + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from (select doc_id, ls, unnest(range(len(ls))) as i from d) where doc_id is not null),
m as (
  select doc_id, line_no, w, list_transform(w, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as t, len(w) as n from l where len(w) > 0),
k as (select *, t[1] as a, coalesce(t[2], '') as b from m),
leaf as (select n, a, b, count(*) as lines from k group by all),
e as (select n, a, b, unnest(range(len(t))) as place, unnest(t) as token from k),
c as (
  select n, a, b, place, token from (select n, a, b, place, token, count(*) as times from e where place >= 2 and token <> '<*>' group by all)
  join leaf using (n, a, b) where 2 * times > lines),
s as (select n, a, b, map(list(place), list(token)) as fixed from c group by all),
f as (
  select doc_id, line_no, n, t, w, list_transform(range(len(t)), lambda i: i < 2 or fixed[i] = t[i + 1]) as holds
  from k left join s using (n, a, b)),
x as (
  select doc_id, line_no, case when len(list_filter(t, lambda v: v <> '<*>')) = 0 then list_prepend('exact', w)
    when (len(list_filter(holds, lambda h: h)) - least(n, 2)) * 10 >= (n - 2) * 6 then list_prepend('tree', list_transform(range(len(t)), lambda i: case when holds[i + 1] then t[i + 1] else '<*>' end))
    else list_prepend('line', t) end as template from f),
r as (select template from x group by 1 having count(distinct doc_id) >= 3),
gone as (select distinct doc_id, line_no from x join r using (template)),
y as (select doc_id, ls[i + 1] as line, i as line_no from (select doc_id, ls, unnest(range(len(ls))) as i from d)),
kept as (select doc_id, string_agg(line, chr(10) order by line_no) as text from y anti join gone using (doc_id, line_no) group by 1),
g as (select doc_id, count(*) as n_dropped from gone group by 1)
select d.doc_id, len(ls) as n_lines, coalesce(n_dropped, 0) as n_dropped, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id) left join g using (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document outside templates that three documents share."""
    return lines.drop_templates(table(spark, sf_dir, "documents"), give_text=False)


@query("op11_exact_topk", """
with d as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, x, row_number() over () as slot from d where vec_id % 50 = 0),
s as (
  select slot, query_id, d.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, d.x), lambda z: coalesce(z[1], 0)::hugeint * coalesce(z[2], 0))), 0)::bigint as score
  from q join d on d.vec_id is distinct from q.query_id),
r as (select *, row_number() over (partition by slot order by score desc, vec_id nulls last) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows by integer inner product for every row whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def repeat_tail(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """The contract's planted runs: words from place a on become repetitions of the first p of them."""
    out = []
    for doc, text in zip(ids.to_pylist(), texts.to_pylist()):
        w = (text or "").encode("utf-8", "replace").split()
        if doc is None or not w:
            out.append(text)
            continue
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        out.append(b" ".join(w[:a] + [w[a + i % p] for i in range(len(w) - a)]).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them with a repeated tail; tested against brute force in tests/llm."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    tail = F.arrow_udf(repeat_tail, "string")(F.when(chosen, F.col("doc_id")), F.when(chosen, F.col("text")))
    return periodic.periodic_runs(docs.withColumn("text", F.when(chosen, tail).otherwise(F.col("text"))))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First eight whitened components of every vector; tested against an eigendecomposition in tests/llm."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=8, scale=1024, shift=100_000)
