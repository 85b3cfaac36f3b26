import random

import pandas as pd
from pyspark.sql import Window, functions as F

from paperweft.operators import (
    catalog as C, extract as E, match as M, pages as P, parts, populate as U, prefix, schema as S, signature as G, structure as D,
    substring, tables as T, verify as V)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_running_equals_window_for_any_segment(spark):
    rnd = random.Random(1)
    data = [(k, i, rnd.choice([None, 1, 2, 5])) for k in range(3) for i in range(40) if rnd.random() < 0.8]
    df = spark.createDataFrame(data, "k int, i int, v int")
    w = Window.partitionBy("k").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "i", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.max("v").over(upto).alias("m"),
                     F.last("v", ignorenulls=True).over(upto).alias("l"), F.lag("v").over(w).alias("g"))
    want = {(r.k, r.i): (r.s, r.m, r.l, r.g) for r in want.collect()}
    v = F.col("v")
    for segment in (3, 7, 1000):
        got = prefix.running(df, ["k"], "i", {"s": ("sum", v), "m": ("max", v), "l": ("last", v), "g": ("lag", v)}, segment)
        assert {(r.k, r.i): (r.s, r.m, r.l, r.g) for r in got.collect()} == want


def test_substring_join_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6)))
    texts = [(i, " ".join(word() for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    needles = sorted({" ".join(word() for _ in range(rnd.randint(1, 4))) for _ in range(80)} | {"a", "ab", "a b"})
    for limit in (500_000, 0):  # broadcast and shuffled look-up
        monkeypatch.setattr(substring, "BROADCAST_ROWS", limit)
        hits = substring.substring_hits(spark.createDataFrame(texts, "id int, text string"), ["id"], spark.createDataFrame([(n,) for n in needles], "needle string"))
        assert rows(hits, "id", "needle") == sorted((i, n) for i, t in texts for n in needles if n in t)


def test_detection_branches(spark):
    pages = spark.createDataFrame([
        (1, 1, "the Electrical  design BASIS of IP009-43"), (2, 1, "electrical design basis"), (3, 1, "see ip009-43 rated voltage"),
        (4, 1, "rated voltage only"), (4, 2, "rated voltage, earthing"), (5, 1, "nothing here"), (6, 1, "specification 02")], "doc_id int, page_number int, text string")
    templates = spark.createDataFrame([("A", "Electrical design basis", "IP009-43"), ("B", "Specification 02", None)], "template_id string, template_name string, specification_number string")
    fields = spark.createDataFrame([("A", "General", "Rated voltage"), ("A", "General", "Earthing"), ("B", "S2", "No")], "template_id string, section_name string, field_label string")
    d = M.detect_specifications(pages, M.template_signals(templates, fields))
    got = {(r.doc_id, r.template_id): (r.match_status, r.match_confidence, list(r.matched_pages)) for r in d.collect()}
    assert got == {
        (1, "A"): ("matched", 0.9, [1]), (2, "A"): ("matched", 0.75, [1]), (3, "A"): ("review", 0.52, [1]),
        (4, "A"): ("review", 0.55, [1, 2])}
    assert rows(M.detection_counts(pages, d, templates), "doc_id", "matched", "review", "not_found")[4] == (5, 0, 0, 2)


def test_page_summary(spark):
    df = spark.createDataFrame([(1, "Area: X\na | b\nc\td"), (2, ""), (3, None)], "id int, text string")
    r = {x.id: x for x in P.page_summary(df).collect()}
    assert r[1].field_labels == ["Area"] and r[1].table_count == 2 and r[1].line_count == 3
    assert r[1].layout_score == 0.94 and r[2].layout_score == 0.0 and r[3].line_count == 0


def test_page_fidelity(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, "a b\nx | y", "a b x y\nx | y"), (3, "a b c d", "a")], "id int, s string, e string")
    r = {x.id: (x.coverage_ratio, x.table_match_ratio) for x in P.page_fidelity(df, "s", "e").collect()}
    assert r == {1: (1.0, 0.0), 2: (1.0, 1.0), 3: (0.25, 0.0)}


def blocks(spark, lines, doc=1):
    cols = "doc_id long, block_seq int, block_type string, text string, style string, has_page_break boolean, rendered_breaks int, alignment string, level int, run_count int"
    return spark.createDataFrame([(doc, i, kind, text, "Normal", brk, 0, None, None, 1) for i, (kind, text, brk) in enumerate(lines)], cols)


def reference_boundaries(lines, total):
    taken, blanks = {}, 0
    upper = lambda t: t.strip() and t.upper() == t
    for i, (kind, text, brk) in enumerate(lines):
        if kind == "table":
            page = 1 + i * total // (len(lines) + 1)
            if i > 0 and page not in taken.values() and page <= total:
                taken[i] = page
            blanks = 0
            continue
        if brk and i > 0:
            taken[i] = min(total, 1 + len(taken))
        if not text:
            blanks += 1
            if blanks >= 3 and i > 0:
                taken.setdefault(i, min(total, 1 + len(taken)))
                blanks = 0
        else:
            if upper(text) and i > 0:
                taken.setdefault(i, min(total, 1 + len(taken)))
            blanks = 0
    return taken


def test_page_boundaries(spark):
    rnd = random.Random(3)
    for _ in range(3):
        lines = [(rnd.choice(["para", "para", "para", "table"]), rnd.choice(["", "", "", "text", "HEAD"]), rnd.random() < 0.1) for _ in range(60)]
        b = blocks(spark, lines)
        stats = D.document_stats(b)
        total = stats.first()["total_pages"]
        want = reference_boundaries(lines, total) if total > 1 else {}
        assert {r.block_seq: r.page for r in D.page_boundaries(b, stats).collect()} == want


def test_locate(spark):
    needles = spark.createDataFrame([(1, 0, "beta", 9), (1, 1, "zzz", 9), (1, 2, "alpha", 9), (1, 3, "", 9), (1, 4, "gamma", 9)], "doc_id long, seq int, text string, fallback int")
    pages = spark.createDataFrame([(1, 1, "Alpha"), (1, 2, "BETA"), (1, 3, "gamma  beta")], "doc_id long, page_number int, text string")
    assert rows(D.locate(needles, pages), "seq", "page") == [(0, 2), (1, 2), (2, 2), (3, 3), (4, 3)]


def test_register_fields(spark):
    names = ["X", "x", "X!", "x 2", "X?", "Y"]
    c = spark.createDataFrame([(1, i, n, None, None) for i, n in enumerate(names)], "doc_id long, o int, label string, explicit_id string, value string")
    assert rows(S.register_fields(c, ["o"]), "o", "field_id") == [(0, "x"), (2, "x_2"), (3, "x_2_2"), (4, "x_3"), (5, "y")]


def cells(spark, table):
    data = [(1, 0, r, p, *c) for r, row in enumerate(table) for p, c in enumerate(row)]
    return spark.createDataFrame(data, "doc_id long, table_index int, row_no int, pos int, text string, colspan int, vmerge string, border_top string, border_bottom string")


def test_table_geometry(spark):
    plain = lambda t, span=1, vm=None, top=None, bottom=None: (t, span, vm, top, bottom)
    t = cells(spark, [[plain("a", 2), plain("b", 1, "restart")], [plain("c"), plain("d"), plain("", 1, "continue")], [plain("e"), plain("f"), plain("", 1, "continue")]])
    assert rows(T.table_structure(t), "row_no", "col", "rowspan", "text") == [(0, 0, 1, "a"), (0, 2, 3, "b"), (1, 0, 1, "c"), (1, 1, 1, "d"), (2, 0, 1, "e"), (2, 1, 1, "f")]
    h = cells(spark, [[plain("a", 1, None, None, "none")], [plain("", 1, None, "none", "none")], [plain("", 1, None, "none", None)], [plain("z", 1, None, "none")]])
    assert rows(T.collapse_merges(h), "row_no", "rowspan", "text") == [(0, 3, "a"), (3, 1, "z")]


def test_form_cells(spark):
    plain = lambda t: (t, 1, None, None, None)
    t = cells(spark, [[plain("Checked by:"), plain("Dated:"), plain("Place:"), plain("Pune")], [plain("5"), plain("Serial no")], [plain("Area: X"), plain("")]])
    assert rows(T.form_cells(t), "phase", "row_no", "cell_no", "label", "value") == [(0, 2, 0, "Area", "X"), (1, 0, 1, "Checked by", "Dated:"), (1, 0, 3, "Place", "Pune"), (2, 1, 0, "Serial no", "5")]


def test_merge_chunks(spark):
    df = spark.createDataFrame([(1, "a", 1, None), (1, "a", 2, "v"), (1, "b", 1, ""), (1, "b", 2, "w"), (1, "c", 1, None)], "job_id long, field_id string, chunk_no int, value string")
    assert [(r.field_id, r.value) for r in E.merge_chunks(df).orderBy("field_id").collect()] == [("a", "v"), ("b", ""), ("c", None)]


def test_parse_output(spark):
    data = [('{"fields": []}', "stop", None), ('{"fields": [', "length", "truncated"), ('{"fields": [', "stop", "invalid_json"), ("[1]", "stop", "missing_fields"),
            ('{"a": 1}', "stop", "missing_fields"), ('{"fields": 3}', "stop", "fields_not_list"), ('{"fields": null}', "stop", "fields_not_list"), (None, "stop", "invalid_json")]
    df = spark.createDataFrame(data, "response string, done_reason string, want string")
    assert all(r.error == r.want for r in E.parse_output(df).collect())


def test_validate_output(spark):
    schema = spark.createDataFrame([("T", "a", "A"), ("T", "b", "B")], "template_id string, field_id string, field_label string")
    texts = ['{"fields":[{"field_id":"a","value":"1","confidence":0.5}]}', '{"fields":[{"field_id":"zz"}]}', '{"fields":[{"field_id":"a"},{"field_id":"a"}]}', '{"fields":[{"field_id":"a","source":3}]}',
             '{"fields":[{"field_id":"a","source":{"page_number":"1"}}]}', '{"fields":[{"field_id":"a","source":{"source_text":1}}]}', '{"fields":[{"field_id":"a","source":{"confidence":"x"}}]}', '{"fields":[7]}', '{"fields":[]}']
    r = spark.createDataFrame([(i, t, "stop") for i, t in enumerate(texts)], "k int, response string, done_reason string")
    heads = r.select("k", F.lit("T").alias("expected_id"), F.lit("1").alias("expected_version"), F.when(F.col("k") == 8, "U").otherwise("T").alias("template_id"), F.lit("1").alias("template_version"))
    ok, errors = E.validate_output(heads, E.output_fields(E.parse_output(r), ["k"]), schema, ["k"])
    assert rows(errors, "k", "error") == [(1, "Unknown field: zz"), (2, "Duplicate field: a"), (3, "Invalid source object"), (4, "Invalid source page number"),
                                          (5, "Invalid source text"), (6, "Invalid source confidence"), (7, "Invalid field entry"), (8, "Template ID mismatch")]
    assert [(x.field_id, x.field_name, x.value, x.confidence) for x in ok.orderBy("field_id").collect()] == [("a", "A", "1", 0.5), ("b", "B", None, 0.0)]


def test_verify(spark):
    rule = "array<struct<pattern:string,min_length:int,message:string>>"
    schema = spark.createDataFrame([("a", True, [("[0-9", 50, None), ("^x", None, "starts with x")]), ("b", False, [("^v", None, None), (None, 5, None)])], f"field_id string, required boolean, rules {rule}")
    schema = schema.selectExpr("0 AS template_key", "*", "'h' AS extraction_hint")
    data = [("a", "y", 0.5, "pending"), ("a", "", None, "pending"), ("b", " ", 0.9, "pending"), ("b", "v", 0.49, "pending"), ("b", "v", 0.5, "pending"), ("b", "value", None, "pending"), ("b", "value", None, "rejected")]
    f = spark.createDataFrame([(i, 0, *d) for i, d in enumerate(data)], "job_id long, template_key int, field_id string, value string, confidence double, validation_status string")
    got = {r.job_id: (r.status, r.reason) for r in V.verify(f, schema).collect()}
    assert got[0] == ("mismatch", "starts with x") and got[1][0] == "not_found" and got[2][0] == "review"
    assert got[3] == ("review", "Low extraction confidence (49%) — please double-check.")
    assert got[4] == ("mismatch", "Value is shorter than the required 5 characters.") and got[5] == ("match", None) and got[6][0] == "mismatch"


def test_populate(spark):
    b = spark.createDataFrame([(1, "{{a}} {a} [a] {{{a}}} {b}"), (1, "Name: old\nrest Name: x"), (2, "{a}")], "k int, text string")
    v = spark.createDataFrame([(1, 0, "a", "Name", "{b}"), (1, 1, "b", "Other", "B")], "k int, pos int, field_id string, field_label string, value string")
    out = U.populate(b, U.value_lists(v, ["k"], ["pos"]), ["k"])
    assert sorted((r.text, len(r.ops)) for r in out.collect()) == [("B B B B B", 5), ("Name: B\nrest Name: x", 2), ("{a}", 0)]


def test_sync_and_delete_plan(spark):
    head = "template_id string, version string, template_name string, description string, specification_number string, file_name string, structure_locked boolean"
    cur = spark.createDataFrame([("A", "1", "a", None, None, "f", False, True, "active", {"sections": "s", "page_html": "[1]"})], head + ", is_active boolean, status string, schema map<string,string>")
    inc = spark.createDataFrame([("A", "1", "a", None, None, "f", False, {"page_html": "[]", "sections": "s"}), ("N", "1", "n", None, None, "f", True, {"sections": "own"})], head + ", schema map<string,string>")
    inferred = spark.createDataFrame([("N", "inferred")], "template_id string, sections string")
    got = {r.template_id: (r.change, r.status, dict(r.schema)) for r in C.sync(cur, inc, inferred).collect()}
    assert got == {"A": ("unchanged", "active", {"sections": "s", "page_html": "[1]"}), "N": ("inserted", "pending", {"sections": "own"})}
    jobs = spark.createDataFrame([(1, 7, 1), (2, 8, 1), (3, 9, 2)], "id int, project_id int, template_key int")
    projects = spark.createDataFrame([(7, "P")], "id int, project_name string")
    targets = spark.createDataFrame([(1,), (2,)], "template_key int")
    verdict, names, gone = C.delete_plan(targets, jobs, projects)
    assert rows(verdict, "template_key", "blocked", "project_names") == [(1, True, 1), (2, False, 0)] and rows(gone, "job_id") == [(3,)]
    assert rows(names, "template_key", "project_name") == [(1, "P")]
    assert rows(C.delete_plan(targets, jobs, projects, True)[2], "job_id") == [(1,), (2,), (3,)]


def test_parts_keep_everything(spark):
    df = spark.createDataFrame([(1, i) for i in range(1000)] + [(2, 1)], "k int, i int")
    n = parts.nest(df.repartition(7), ["k"], ["i"], ["i"], "items", size=100)
    got = {(r.k, r.part_no): [x.i for x in r["items"]] for r in n.collect()}
    assert got == {(1, p): list(range(100 * p, 100 * p + 100)) for p in range(10)} | {(2, 0): [1]}


def test_ranks_over_many_ranges(spark):
    """A key that holds most rows, ties in the order, an empty table; ranks equal a window's."""
    from pyspark.sql import Window

    df = spark.range(20_000).select((F.when(F.col("id") % 5 == 0, F.col("id") % 11).otherwise(99)).alias("k"), F.pmod(F.xxhash64("id"), F.lit(3_000)).alias("v"), "id")
    df = df.union(df.limit(50))
    got = parts.ranked(df, ["k"], ["v", "id"])
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert parts.ranked(df.where("false"), ["k"], ["v"]).count() == 0


def test_running_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(3_000).select(F.lit(1).alias("k"), "id").mapInPandas(touch, "k int, id long")
    got = prefix.running(df, ["k"], "id", {"s": ("sum", F.col("id")), "g": ("lag", F.col("id"))}, segment=100)
    assert got.agg(F.max("s")).first()[0] == 2_999 * 1_500 and got.where("g = id - 1").count() == 2_999
    assert seen.value == 3_000 and got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 0


def test_signature_pairs(spark):
    base = dict(page_count=1, table_count=0, has_headers=True, has_footers=True)
    make = lambda n: spark.createDataFrame(pd.DataFrame([dict(pair_id=i, paragraph_count=c, **base) for i, c in enumerate(n)]))
    seq = spark.createDataFrame([(3,)], "pair_id long")
    got = G.compare_signatures(make([10, 10, 10, 10]), make([10, 15, 16, 10]), seq)
    assert rows(got, "pair_id", "is_identical") == [(0, True), (1, True), (2, False), (3, False)]


def test_positions_of_long_tables_do_not_reach_the_next_block(spark):
    from paperweft.operators.structure import rows_by_page

    blocks = spark.createDataFrame([(1, 0, "table", None), (1, 1, "table", None)], "doc_id long, block_seq int, block_type string, text string")
    texts = spark.createDataFrame([(1, 0, 1_000_000, "far row"), (1, 1, 0, "next row")], "doc_id long, table_index int, row_no int, row_text string")
    tables = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "doc_id long, table_index int, block_seq int")
    pages = spark.createDataFrame([(1, 1, "far row"), (1, 2, "next row")], "doc_id long, page_number int, text string")
    got = sorted((r.page_number, r.row_text) for r in rows_by_page(blocks, texts, tables, pages).collect())
    assert got == [(1, "far row"), (2, "next row")]


def test_json_booleans_are_numbers(spark):
    schema = spark.createDataFrame([("T", "a", "A")], "template_id string, field_id string, field_label string")
    text = '{"fields":[{"field_id":"a","value":"1","confidence":0.5,"source":{"page_number":true,"confidence":false}}]}'
    r = spark.createDataFrame([(0, text, "stop")], "k int, response string, done_reason string")
    heads = r.select("k", F.lit("T").alias("expected_id"), F.lit("1").alias("expected_version"), F.lit("T").alias("template_id"), F.lit("1").alias("template_version"))
    ok, errors = E.validate_output(heads, E.output_fields(E.parse_output(r), ["k"]), schema, ["k"])
    assert rows(errors, "k", "error") == [] and rows(ok, "field_id", "page_number") == [("a", 1)]


def test_blocks_that_read_nbsp_are_no_fields(spark):
    page = spark.createDataFrame([(1, "<p>one</p><p>&amp;nbsp;</p><p>a: b</p>")], "page_id int, html string")
    assert rows(P.html_fields(page), "idx", "field_label", "value") == [(1, "Value 1", "one"), (3, "a", "b")]


def test_needs_review_of_exact_decimals(spark):
    f = spark.createDataFrame([(1, "0.9"), (1, "0.5"), (2, "0.69"), (3, None)], "k int, c string").withColumn("c", F.col("c").cast("decimal(3,2)"))
    assert rows(P.needs_review(f, ["k"], "c"), "k", "needs_review") == [(1, False), (2, True), (3, True)]


def fold_boundaries(rows):
    """By definition: (block_seq, guess or None, total) in order; a table is accepted on a page not taken yet."""
    taken, out = set(), []
    for seq, guess, total in rows:
        if guess is None:
            page = min(total, 1 + len(out))
        elif guess in taken or guess > total:
            continue
        else:
            page = guess
        taken.add(page)
        out.append((seq, page))
    return out


def test_page_boundaries_equal_the_fold(spark):
    import random

    from paperweft.operators import structure as D

    rnd, blocks, want = random.Random(4), [], {}
    for doc in range(120):
        n, density, breaks = rnd.choice([5, 30, 90]), rnd.random(), rnd.random() * 0.6
        kinds = [rnd.choices(["table", "break", "plain"], [density, breaks, 0.4])[0] for _ in range(n)]
        blocks += [(doc, i, "table" if k == "table" else "para", "x", None, k == "break", 0) for i, k in enumerate(kinds)]
        total = 1 + kinds.count("break")
        if total > 1:
            cands = [(i, 1 + i * total // (n + 1) if k == "table" else None, total) for i, k in enumerate(kinds) if i and k != "plain"]
            want |= {(doc, i): p for i, p in fold_boundaries(cands)}
    df = spark.createDataFrame(blocks, "doc_id long, block_seq int, block_type string, text string, style string, has_page_break boolean, rendered_breaks int")
    got = D.page_boundaries(df, D.document_stats(df)).collect()
    assert len(got) == len(want) and {(r.doc_id, r.block_seq): r.page for r in got} == want


def test_no_task_holds_a_document_with_many_tables(spark, monkeypatch):
    from paperweft.operators import structure as D

    most = spark.sparkContext.accumulator(0)
    accept = D._accept_tables

    def watched(rows):
        most.add(len(rows))
        return accept(rows)

    monkeypatch.setattr(D, "_accept_tables", watched)
    i = F.col("id")
    df = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), i.cast("int").alias("block_seq"), F.when(i % 3 > 0, "table").otherwise("para").alias("block_type"),
                                     F.lit("x").alias("text"), F.lit(None).cast("string").alias("style"), (i % 600 == 0).alias("has_page_break"), F.lit(0).alias("rendered_breaks"))
    got = D.page_boundaries(df, D.document_stats(df))
    assert got.count() >= 166 and 0 < most.value <= 168


def test_digests_of_a_large_template(spark):
    """10^5 fields in one section: no row holds them; order, wording and section borders count."""
    i = F.col("id")
    f = spark.range(100_000).select(F.lit("T").alias("template_id"), (i % 2 * 5).cast("int").alias("section_pos"), (i * 3).cast("int").alias("field_pos"), F.lit("s").alias("section_id"),
                                    F.lit("S").alias("section_name"), F.concat(F.lit("f"), i.cast("string")).alias("field_id"), F.lit("L").alias("field_label"), F.lit("string").alias("data_type"),
                                    F.lit(False).alias("required"))
    sign = lambda df: tuple(G.schema_signature(df).first())
    first = sign(f)
    assert first[:3] == ("T", 2, 100_000) and first == sign(f.withColumn("field_pos", F.col("field_pos") + 7).repartition(3))
    swapped = f.withColumn("field_pos", F.when(F.col("field_id") == "f10", 36).when(F.col("field_id") == "f12", 30).otherwise(F.col("field_pos")).cast("int"))
    others = [swapped, f.withColumn("section_pos", F.lit(0)), f.where("field_id <> 'f9'"), f.withColumn("section_name", F.lit("Z"))]
    assert len({first, *map(sign, others)}) == 5
    assert rows(G.changed_sections(f, swapped), "section_pos", "change") == [(0, "changed")]
    assert G.signature_lines(f).count() == 100_002


def serve_ids(asked, used):
    """By definition: every request in order takes its base, or the first free number after those it has tried."""
    seen, out = set(used), []
    for base in asked:
        found, n = base, 2
        while found in seen:
            found, n = f"{base}_{n}", n + 1
        seen.add(found)
        out.append(found)
    return out


def test_ids_equal_serving_one_by_one(spark):
    import random

    from paperweft.operators import ids

    rnd, asked, used, want = random.Random(9), [], [], {}
    for scope in range(60):
        names = rnd.sample(["a", "b", "a_2", "a_2_2", "a_3", "b_02", "b_1", "c_10", "c", "_2", "d_9", "d"], rnd.randint(1, 6))
        mine = [rnd.choice(names) for _ in range(rnd.randint(1, 25))]
        has = rnd.sample(["a", "a_2", "a_4", "a_5", "b", "b_2", "b_1", "c_2", "c_11", "d_2", "d_3", "d_9_2", "x"], rnd.randint(0, 8))
        asked += [(scope, i, n, "z") for i, n in enumerate(mine)]
        used += [(scope, x) for x in has]
        want |= {(scope, i): x for i, x in enumerate(serve_ids(mine, has))}
    df = spark.createDataFrame(asked, "scope int, seq int, base string, extra string").repartition(3)
    got = ids.allocate(df, ["scope"], ["seq"], spark.createDataFrame(used, "scope int, id string")).collect()
    assert len(got) == len(want) and {(r.scope, r.seq): r.id for r in got} == want and {r.extra for r in got} == {"z"}


def test_a_large_family_of_ids(spark):
    from paperweft.operators import ids

    i = F.col("id")
    asked = spark.range(100_000).select(i.alias("seq"), F.lit("part").alias("base"))
    used = spark.range(100_000).select(F.when(i == 0, "part").otherwise(F.concat(F.lit("part_"), (i * 2).cast("string"))).alias("id"))
    got = ids.allocate(asked, [], ["seq"], used)
    assert got.select("id").distinct().count() == 100_000 and got.join(used, "id").count() == 0
    assert [r.id for r in got.where("seq in (0, 1, 99998, 99999)").orderBy("seq").collect()] == ["part_3", "part_5", "part_199999", "part_200000"]


def test_locate_equals_the_walk_over_texts(spark):
    import random

    from paperweft.operators import structure as D

    rnd, needles, pages, want = random.Random(6), [], [], {}
    words = ["alpha", "beta", "gamma", "al", "ma", "a", "x y", "beta gamma", "ta ga", ""]
    for doc in range(40):
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 6))]
        pages += [(doc, 3 * i + 2, t) for i, t in enumerate(texts)]
        norm, cursor = [" ".join(t.lower().split()) for t in texts], 0
        for seq in range(rnd.randint(1, 12)):
            text, fallback = rnd.choice([*words, "  Beta  GAMMA ", "nowhere"]), rnd.randint(-1, 9)
            needles.append((doc, seq, text, fallback))
            key = " ".join(text.lower().split())
            if not texts:
                want[doc, seq] = fallback
            elif not key:
                want[doc, seq] = max(1, min(fallback, len(texts)))
            else:
                cursor = next((p for p in range(cursor, len(texts)) if key in norm[p]), cursor)
                want[doc, seq] = cursor + 1
    got = D.locate(spark.createDataFrame(needles, "doc_id long, seq int, text string, fallback int"), spark.createDataFrame(pages, "doc_id long, page_number int, text string")).collect()
    assert len(got) == len(want) and {(r.doc_id, r.seq): r.page for r in got} == want


def test_pages_of_hits_beyond_one_word_of_bits(spark):
    pages = spark.createDataFrame([(1, n, "the long title here" if n % 2 else "part no 7") for n in (1, 63, 64, 65, 130, 200)], "doc_id long, page_number int, text string")
    signals = spark.createDataFrame([("T", "title", "the long title here"), ("T", "label", "part no"), ("U", "label", "long title"), ("V", "number", "absent")], "template_id string, kind string, needle string")
    got = {r.template_id: (r.matched_pages, r.match_status) for r in M.detect_specifications(pages, signals).collect()}
    assert got["T"][0] == [1, 63, 64, 65, 130, 200] and got["U"][0] == [1, 63, 65] and set(got) == {"T", "U"}


def test_a_section_without_fields_gets_a_prompt(spark):
    chunks = spark.createDataFrame([(1, "T", 1, "body", 1)], "doc_id long, template_id string, page_number int, text string, chunk_no int")
    batches = spark.createDataFrame([("T", 0, "Main", 0, "a", "A", None, 1)], "template_id string, section_pos int, section_name string, field_pos int, field_id string, field_label string, extraction_hint string, batch_no int")
    versions = spark.createDataFrame([("T", "1", None)], "template_id string, version string, reference_text string")
    sections = spark.createDataFrame([("T", 0, "Main"), ("T", 1, "Annex")], "template_id string, section_pos int, section_name string")
    got = {r.section_pos: r.prompt for r in E.prompts(chunks, batches, versions, sections).collect()}
    assert set(got) == {0, 1} and "SECTION: Annex\n\nDOCUMENT TEXT:\n--- PAGE 1 ---\nbody" in got[1] and "field_id=a" in got[0] and "field_id" not in got[1].split("SECTION")[1]
    assert E.prompts(chunks, batches, versions).count() == 1


def test_file_ends(spark, tmp_path):
    """Template files, incoming files and exports, through real folders."""
    import json

    from paperweft.sources import exports as X, files as S

    for name, schema in (("b", {"template_id": "T", "template_name": "Second"}), ("a", {"template_id": "T", "template_name": "First", "is_active": False}), ("c", ["no object"]), ("d", {"x": 1})):
        (tmp_path / "templates" / name).mkdir(parents=True)
        (tmp_path / "templates" / name / "schema.json").write_text(json.dumps(schema))
    (tmp_path / "templates" / "e").mkdir()
    (tmp_path / "templates" / "e" / "schema.json").write_text("{broken")
    got = S.read_templates(spark, str(tmp_path / "templates")).collect()
    assert [(r.template_id, r.template_name, r.is_active, r.version) for r in got] == [("T", "First", False, "1.0")]
    assert S.read_template_files(spark, str(tmp_path / "templates")).count() == 5
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "x.PDF").write_bytes(b"1234")
    (tmp_path / "in" / "deep" / "y.exe").write_bytes(b"1")
    seen = S.intake(S.read_incoming(spark, str(tmp_path / "in")))
    assert rows(seen, "original_filename", "size", "file_type", "reject_reason") == [("x.PDF", 4, "pdf", None), ("y.exe", 1, "exe", "Unsupported file type")]
    out = spark.createDataFrame([(1, 0, "completed", '{"a":1}'), (1, 1, "completed", '{"a":2}')], "job_id int, part_no int, status string, json string")
    X.write_job_exports(out, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [('{"a":1}', "completed"), ('{"a":2}', "completed")]


def test_texts_are_not_dealt_with_running_values(spark, monkeypatch):
    kept, write = [], prefix.written
    monkeypatch.setattr(prefix, "written", lambda df: (kept.append(df.columns), write(df))[1])
    data = [(1, i, "para", t, st, False, 0) for i, (t, st) in enumerate([("TITLE", "Title"), ("Name: x", "Normal"), ("", "Normal"), ("words, and words!", "Normal")])]
    blocks = spark.createDataFrame(data, "doc_id long, block_seq int, block_type string, text string, style string, has_page_break boolean, rendered_breaks int")
    cells = spark.createDataFrame([], "doc_id long, table_index int, row_no int, pos int, text string, colspan int, vmerge string, border_top string, border_bottom string")
    paged = D.estimate_pages(blocks)
    assert "words, and words!" in [r.text for r in S.static_blocks(paged, cells).collect()]
    sections = S.inferred_sections(blocks, S.infer_fields(paged, cells))
    assert rows(S.infer_sections(paged, cells), *sections.columns) == rows(sections, *sections.columns)
    assert kept and not any({"text", "style"} & set(c) for c in kept)  # texts and styles were written by each of them


def test_parts_of_many_middling_keys_are_not_dealt_by_ranges(spark, monkeypatch):
    df = spark.range(60).selectExpr("id % 3 as k", "cast(id as int) as i").where("k > 0 or i < 30").repartition(5)
    seen, rank = [], parts.ranked
    monkeypatch.setattr(parts, "ranked", lambda d, *a: (seen.append(1), rank(d, *a))[1])
    want = rows(parts.with_parts(df, ["k"], ["i"], 4), "k", "i", "part_no")
    assert not seen  # keys of more than a part were
    assert want == sorted((k, i, i // 3 // 4) for i in range(60) for k in [i % 3] if k > 0 or i < 30)
    monkeypatch.setattr(parts, "WINDOW_ROWS", 15)  # keys 1 and 2 by ranges, key 0 by window
    assert rows(parts.with_parts(df, ["k"], ["i"], 4), "k", "i", "part_no") == want and seen


def test_texts_are_normalized_once(spark):
    """Detection evaluates its texts once, however often the substring join reads them."""
    seen = spark.sparkContext.accumulator(0)
    look = F.udf(lambda t: (seen.add(1), t)[1])
    pages = spark.createDataFrame([(1, 1, "Alpha beta gamma"), (1, 2, "delta")], "doc_id long, page_number int, text string").withColumn("text", look.asNondeterministic()("text"))
    signals = spark.createDataFrame([("t", "title", "alpha beta gamma"), ("t", "label", "delta")], "template_id string, kind string, needle string")
    assert rows(M.detect_specifications(pages, signals), "doc_id", "template_id", "match_status", "matched_pages") == [(1, "t", "matched", [1, 2])]
    assert seen.value == 2  # was four


def test_pattern_search_reads_values_of_given_patterns_only():
    """Arrays in, array out; a value is taken from its batch only where a rule has a pattern, here from a slice."""
    import pyarrow as pa

    from paperweft.operators import verify as V

    values = pa.array(["gone", "12", None, "x", "a1", "y"]).slice(1)
    patterns = pa.array([["q"], ["^[0-9]+$", None], ["", None], None, ["[0-9", "[0-9]", "^[0-9]+$"], []], pa.list_(pa.string())).slice(1)
    assert V._searches.func(values, patterns).to_pylist() == [[True, True], [True, True], None, [None, True, False], []]


def test_table_structure_sends_no_widths_through_the_driver(spark):
    from paperweft.operators import tables as T

    cells = spark.sql("""select 1L doc_id, 0 table_index, 0 row_no, pos, text, colspan, cast(null as string) vmerge
                         from values (0, 'Brand: x', 1), (1, 'y', 2) as c(pos, text, colspan)""")
    grid = spark.sql("select 1L doc_id, 0 table_index, col, width from values (0, 1000), (1, 2000), (2, 1000) as g(col, width)")
    found = T.table_structure(cells, grid)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.col, r.width_pct, r.field_id) for r in found.collect()) == [(0, 25.0, "brand_table_1_row_1_cell_1"), (1, 75.0, None)]


def broadcasts(monkeypatch, make):
    """Plans of ``make()`` and of all tables that it writes on the way in which a side is sent through the driver, counted look-ups aside."""
    from paperweft.operators import cut, ids

    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (D, S, T, ids, parts, prefix):
        for name, f in (("written", cut.written), ("cut", cut.cut)):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, lambda df, f=f: f(noted(df)))
        if hasattr(module, "lookup"):
            monkeypatch.setattr(module, "lookup", cut.merged)
    df = noted(make())
    monkeypatch.undo()
    return df, [p for p in plans if "Broadcast" in p]


COVERED = [("para", "PROJECT A", False), ("para", "", False), ("table", "a table", False), ("para", "AB-12", True), ("para", "Brand: x", False), ("para", "words, and words!", True), ("para", "", False)]


def test_pages_and_cover_titles_send_no_rows_through_the_driver(spark, monkeypatch):
    found, sent = broadcasts(monkeypatch, lambda: D.cover_titles(D.estimate_pages(blocks(spark, COVERED))))
    assert not sent
    assert rows(found, "block_seq", "label") == [(0, "Project Name")]


def form(spark, *table):
    return cells(spark, [[(t, 1, None, None, None) for t in row] for row in table])


def test_draft_fields_send_no_rows_through_the_driver(spark, monkeypatch):
    found, sent = broadcasts(monkeypatch, lambda: S.infer_fields(D.estimate_pages(blocks(spark, COVERED)), form(spark, ["Brand", "Kind", "Size"], ["a", "b", "c"])))
    assert not sent
    assert rows(found, "block_seq", "field_label") == [(0, "Project Name"), (2, "Brand (row 1)"), (2, "Kind (row 1)"), (2, "Size (row 1)"), (4, "Brand")]


def test_draft_sections_send_no_rows_through_the_driver(spark, monkeypatch):
    found, sent = broadcasts(monkeypatch, lambda: S.infer_sections(D.estimate_pages(blocks(spark, COVERED)), form(spark, ["Brand", "Kind", "Size"], ["a", "b", "c"])))
    assert not sent
    assert rows(found, "section_no", "field_count") == [(0, 4), (1, 1)]


def test_static_blocks_send_no_rows_through_the_driver(spark, monkeypatch):
    found, sent = broadcasts(monkeypatch, lambda: S.static_blocks(D.estimate_pages(blocks(spark, COVERED)), form(spark, ["a table"])))
    assert not sent
    assert rows(found, "block_seq", "block_type", "text") == [
        (1, "paragraph", ""), (2, "table", "a table"), (3, "heading", "AB-12"), (5, "paragraph", "words, and words!")]


def test_located_texts_are_not_written(spark, monkeypatch):
    """Texts are dealt to their documents and compared there; documents of many pairs go through the substring join, with the same pages."""
    needles = [(d, i, t, 1) for d in (1, 2, 3) for i, t in enumerate(["beta", "gamma  Beta", "", "none", "ALPHA", "alpha"])]
    pages = [(d, i, t) for d in (1, 2) for i, t in enumerate(["Alpha beta", "beta gamma beta", "x alpha"] * d)]
    needles = spark.createDataFrame(needles, "doc_id long, seq int, text string, fallback int")
    pages = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    kept, write = [], D.written
    for module in (D, substring):
        monkeypatch.setattr(module, "written", lambda df: (kept.append(df.columns), write(df))[1])
    found = rows(D.locate(needles, pages), "doc_id", "seq", "page")
    assert kept and not any({"norm", "_needle", "_text"} & set(c) for c in kept)  # pages and needles were written, needles with their words
    assert [p for d, _, p in found if d == 1] == [1, 2, 1, 2, 3, 3] and [p for d, _, p in found if d == 3] == [1] * 6
    for pairs in (20, 0):  # the second document, then both, in the substring join
        monkeypatch.setattr(D, "PAIRS", pairs)
        assert rows(D.locate(needles, pages), "doc_id", "seq", "page") == found


def test_row_texts_are_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)
    look = F.udf(lambda t: (seen.add(1), t)[1]).asNondeterministic()
    row_texts = spark.createDataFrame([(1, 0, 0, "a b"), (1, 0, 1, "c")], "doc_id long, table_index int, row_no int, row_text string").withColumn("row_text", look("row_text"))
    tables = spark.createDataFrame([(1, 0, 1)], "doc_id long, table_index int, block_seq int")
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "A  b"), (1, 3, "c")], "doc_id long, page_number int, text string")
    found = D.rows_by_page(blocks(spark, [("para", "x", False), ("table", "", False)]), row_texts, tables, pages)
    assert rows(found, "page_number", "row_text") == [(2, "a b"), (3, "c")]
    assert seen.value == 2  # was more: counted, located and returned


def test_page_texts_are_not_written_for_their_fields(spark, monkeypatch):
    cols = "template_id string, section_pos int, field_pos int, field_id string, section_id string, clause_ref string, field_label string, default_value string"
    fields = [("", 0, 1, "a", "s", "4.5", "Rated", "none"), ("", 0, 2, "b", "s", "4.5 (b)", "Kind", "x"), ("", 0, 3, "c", "s", "§", "Size", None), ("", 1, 4, "d", "u", None, "Colour", "deep red"), ("", 1, 5, "", "u", "4.50", "Size", "big")]
    fields = spark.createDataFrame([(t, *f[1:]) for t in "TU" for f in fields], cols)
    html = ["<p>cover</p>", "<p>see 4.5 (b) and 4.50.</p>", "<p>the COLOUR is  deep <b>red</b> § 4.5</p>", "<p>size: bigger</p>"]
    pages = spark.createDataFrame([(t, i + 1, h) for t in "TUV" for i, h in enumerate(html[:4 if t == "T" else 3])], "template_id string, page_number int, html string")
    kept, write = [], M.written
    for module in (M, substring):
        monkeypatch.setattr(module, "written", lambda df: (kept.append(df.columns), write(df))[1])
    found = rows(M.fields_in_html(fields, pages), "template_id", "page_number", "field_id", "rule")
    assert kept and not any({"_raw", "text", "_needle", "_text"} & set(c) for c in kept)
    assert [x[1:] for x in found if x[0] == "T"] == [(2, "a", 3), (2, "b", 3), (3, "a", 3), (3, "c", 3), (3, "d", 4), (4, "", 4)]
    for pairs in (14, 0):  # the first template, then both, by words
        monkeypatch.setattr(M, "PAIRS", pairs)
        assert rows(M.fields_in_html(fields, pages), "template_id", "page_number", "field_id", "rule") == found


def test_detection_deals_texts_once_and_writes_none(spark, monkeypatch):
    """Few needles meet the texts in place; only documents of several stretches of pages are dealt again."""
    pages = spark.createDataFrame([(d, n, "the Long title here" if n % 2 else "part no 7 overparted") for d, n in [(1, 1), (1, 2), (1, 9), (2, 3), (3, 4), (None, 1), (None, 9)]], "doc_id long, page_number int, text string")
    signals = spark.createDataFrame([("T", "title", "the long title here"), ("T", "label", "part no"), ("T", "label", "part"), ("U", "label", "title here"), ("U", "number", "absent")], "template_id string, kind string, needle string")
    kept, write = [], substring.written
    for module in (M, substring):
        monkeypatch.setattr(module, "written", lambda df: (kept.append(df.columns), write(df))[1])
    found = M.detect_specifications(pages, signals)
    assert kept and not any({"text", "_text"} & set(c) for c in kept)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1  # was one for each of three counts
    columns = ["doc_id", "template_id", "match_status", "match_confidence", "matched_pages"]
    want = sorted(map(str, found.select(columns).collect()))
    assert len(want) == 7 and "matched_pages=[1, 2, 9])" in want[0]
    monkeypatch.setattr(M, "STRETCH", 4)
    assert sorted(map(str, M.detect_specifications(pages, signals).select(columns).collect())) == want
    monkeypatch.setattr(substring, "BROADCAST_ROWS", 0)  # needles too many for a broadcast: then texts meet by document, as before
    found = M.detect_specifications(pages, signals).where("doc_id is not null")
    assert sorted(map(str, found.select(columns).collect())) == [w for w in want if "doc_id=None" not in w]
