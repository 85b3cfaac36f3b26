"""Base spans against a plain implementation; added spans on texts made for them."""

import hashlib
import re

from pyspark.sql import functions as F

from paperweft.llm import pii, queries

FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(FORMS) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


def test_base_equals_brute_force_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op7_personal_data"](spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in pii.KINDS]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_edges_and_added_spans(spark):
    plain = ["é a.b@c.de, 1.2.3.4 999.1.1.1 4111 1111 1111 1111 +49 (30) 1234567", "000.1.02.255 1.2.3.4.5", "+1 2", None, "", "no data", "x@y.z" * 50 + " 4111111111111112"]
    many = [(i, f"call +1 (212) 555-{i:04d} or mail u{i}@example.com from 10.0.{i % 250}.7, id 4111111111{i:06d} v 300.{i}.1.1 +12 34", "k") for i in range(10, 400)]
    rows = many + [(1000 + i, t, None) for i, t in enumerate(plain)] + [(2000, "mail jo.doe (at) example (dot) org or phone 212-555-0188 now", "z"), (2000, "mail jo.doe (at) example (dot) org or phone 212-555-0188 now", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = pii.find(df).withColumn("b", pii.as_text(F.col("base"))).withColumn("a", pii.as_text(F.col("all"))).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.b == ",".join(brute(texts[r.doc_id]))
    assert [r.a for r in got if r.doc_id == 2000] == ["email:5:34,phone:44:56"] * 2 or [r.a for r in got if r.doc_id == 2000] == ["email:5:34"] * 2
    assert pii.find(df.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a.b@c.de, and 1.2.3.4")], "doc_id long, text string")
    spans = pii.find(df).select("all").first()["all"]
    out = df.select(pii.redact(F.col("text"), F.array(*[F.struct(F.lit(s.start).alias("start"), F.lit(s.kind).alias("kind"), F.lit(s.end).alias("end")) for s in spans])).alias("t")).first().t
    assert out == "é [email], and [ip]"


def test_long_runs_in_one_text(spark):
    numbers = " ".join(f"{10 + i % 90}" for i in range(20_000))
    labels = ".".join("ab" for _ in range(20_000))
    texts = [numbers, "7" * 20_000, f"u@{labels} 4111 1111 1111 1111", f"u (at) ab{' (dot) ab' * 20_000}", "x 4111-1111-1111-1111 y",
             "a@b.cd " + "x" * 2_000, "a (at) b.cd@" + "x" * 2_000, "1.2.3.4 " + "9" * 2_000 + ".1.1", " ".join(f"u{i}@ex.org" for i in range(1_000)),
             "1.2.3.4.5.6.7.8 a@b.c_d@e.f%g@h.i@j.k a@b.c.d@e.f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.find(df).withColumn("b", pii.as_text(F.col("base"))).collect()}
    assert got == {i: ",".join(brute(t)) for i, t in enumerate(texts)}


def test_time_is_linear_in_long_runs_and_many_matches(spark):
    """Texts on which a scan from every character, or a copy of all matches for each, would take hours."""
    many = " ".join(f"u{i}@ex.org" for i in range(30_000))
    texts = {1: ("a@b.cd " + "x" * 1_000_000, ["email:0:6"]), 2: ("1.2.3.4 " + "9" * 1_000_000 + ".1.1", ["ip:0:7"]),
             3: (many, [f"email:{m.start()}:{m.end()}" for m in re.finditer("[^ ]+", many)])}
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.b for r in pii.find(df).withColumn("b", pii.as_text(F.col("base"))).collect()}
    assert {i: x.split(",") for i, x in got.items()} == {i: want for i, (_, want) in texts.items()}


def test_context_of_matches(spark):
    text = "é" * 40 + " a@b.c_d@e.f x@y.z"
    row = spark.createDataFrame([(text,)], "text string").select(pii.matches(F.col("text"), *pii.PLAIN["email"], lambda v: F.lit(True), lambda v: F.lit(True)).alias("m")).first()
    assert [(m.value, m.before, m.after) for m in row.m] == [(text[m.start : m.end], text[max(0, m.start - pii.CONTEXT) : m.start], text[m.end : m.end + 1]) for m in row.m] and len(row.m) == 3


def test_every_labelled_candidate_is_learned_from(spark, monkeypatch):
    """30,000 labelled candidates, all of which training and calibration see."""
    seen = []
    monkeypatch.setattr(pii, "fit", lambda labelled, precision: seen.append(labelled.count()))
    text = F.concat_ws(" and ", *[F.concat(F.lit(f"u{i}."), F.col("id").cast("string"), F.lit("@example.com")) for i in range(30)])
    pii.find(spark.range(1000).select(F.col("id").alias("doc_id"), text.alias("text")))
    assert seen == [30_000]
