from pyspark.sql import functions as F

from paperweft.plans import detection, extraction, inference


def test_detection_uses_active_templates(spark):
    pages = spark.createDataFrame([(1, 1, "rated voltage")], "doc_id int, page_number int, text string")
    templates = spark.createDataFrame([("A", "Alpha specs", None, True), ("B", "Beta specs", None, False)], "template_id string, template_name string, specification_number string, is_active boolean")
    fields = spark.createDataFrame([("A", "X", "Rated voltage"), ("B", "X", "Rated voltage")], "template_id string, section_name string, field_label string")
    assert [(r.template_id, r.match_status) for r in detection.detect(pages, templates, fields).collect()] == [("A", "review")]


def test_draft_schema(spark):
    cols = "doc_id long, block_seq int, block_type string, text string, style string, has_page_break boolean, rendered_breaks int"
    b = spark.createDataFrame([(1, i, "para", t, "Normal", False, 0) for i, t in enumerate(["PROJECT X", "1 Scope of work", "", "Area: North", "free prose goes on, and on."])], cols)
    cells = spark.createDataFrame([], "doc_id long, table_index int, row_no int, pos int, text string, colspan int, vmerge string, border_top string, border_bottom string")
    out = inference.draft_schema(b, cells)
    assert sorted((r.section_id, r.field_id, r.default_value) for r in out["fields"].collect()) == [("1_scope_of_work_1", "area", "North"), ("general", "project_name", "PROJECT X")]
    assert sorted((r.block_id, r.block_type, r.looks_like_blank_field) for r in out["static_blocks"].collect()) == [
        ("static_1", "heading", False), ("static_2", "paragraph", True), ("static_3", "paragraph", False)]


def test_store_responses(spark):
    jobs = spark.createDataFrame([(1, 10, 5, "T", "1")], "job_id long, document_id long, template_key long, template_id string, version string")
    schema = spark.createDataFrame(
        [(5, "T", "a", "A", True, True, None), (5, "T", "b", "B", True, True, None), (5, "T", "s", "S", False, False, "std")],
        "template_key long, template_id string, field_id string, field_label string, required boolean, is_dynamic boolean, default_value string").withColumns({
            "extraction_hint": F.lit("h"), "rules": F.array().cast("array<struct<pattern:string,min_length:int,message:string>>")})
    head = '{"template_id":"T","template_version":"1","fields":['
    r = spark.createDataFrame([(1, 1, head + '{"field_id":"a","value":null}]}', "stop"), (1, 2, head + '{"field_id":"a","value":"x","confidence":0.9}]}', "stop"), (1, 3, "{", "length")],
                              "job_id long, chunk_no int, response string, done_reason string")
    out = extraction.store_responses(r, jobs, schema)
    assert sorted((x.field_id, x.value, x.validation_status) for x in out["fields"].collect() if x.value) == [("a", "x", "pending")]
    assert sorted((x.field_id, x.validation_status) for x in out["fields"].collect()) == [("a", "pending"), ("b", "missing"), ("s", "pending")]
    assert sorted((x.field_id, x.status) for x in out["verdicts"].collect()) == [("a", "match"), ("b", "not_found"), ("s", "review")]
    assert [(x.chunk_no, x.error) for x in out["errors"].collect()] == [(3, "truncated")]
