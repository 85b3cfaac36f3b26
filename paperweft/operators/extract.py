"""Field values: chunking, prompts, parsing, validating, merging, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as K, labels as L, text as X
from .cut import lookup
from .parts import PART_SIZE, nest
from .prefix import running

# --- chunks, batches, prompts ----------------------------------------------------------------------


def chunk_pages(pages: DataFrame, n: int = K.PAGES_PER_CHUNK, key: str = "doc_id") -> DataFrame:
    """Number the chunks of ``n`` consecutive pages from 1."""
    n = n if n > 0 else 10
    ranked = running(pages, [key], "page_number", {"_rank": ("sum", F.lit(1))})
    return ranked.withColumn("chunk_no", (F.floor((F.col("_rank") - 1) / n) + 1).cast("int")).drop("_rank")


def batch_fields(fields: DataFrame, n: int = K.FIELDS_PER_BATCH) -> DataFrame:
    """Number the batches of at most ``n`` fields inside every section from 1."""
    ranked = running(fields, ["template_id", "section_pos"], "field_pos", {"_rank": ("sum", F.lit(1))})
    return ranked.withColumn("batch_no", (F.floor((F.col("_rank") - 1) / n) + 1).cast("int")).drop("_rank")


# fixed values: wording of the prompts
PROMPT_RULES = [
    "You are a document extraction engine. Extract values from the document text below using EXACTLY the template schema given.",
    "Rules:",
    "- Do not create, remove, rename, or reorder fields.",
    "- If a value is not present in the document text, set its value to null.",
    "- Preserve the original wording from the document where possible.",
    "- Respond with ONLY valid JSON matching this exact shape:",
    '{"template_id": "...", "template_version": "...", "fields": [{"field_id": "...", "field_name": "...", "value": "..." or null, '
    '"confidence": 0.0-1.0, "source": {"page_number": int, "source_text": "..."}}]}',
    "",
]
PROMPT_END = "\nReturn only the JSON object described above."
VALIDATION_RULES = [
    "You are a document field extraction validator. Extract and validate the following fields from the document text.",
]
VALIDATION_STEPS = [
    "",
    "For each field:",
    "1. Search for the value in the document text",
    "2. If found, provide the exact text with confidence (0.0-1.0)",
    "3. If not found, explain why",
    "4. Suggest alternative names if the field might be labeled differently",
    "",
    "Response format: JSON with field results and confidence scores",
]


def _or_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def prompts(chunks: DataFrame, batches: DataFrame, versions: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Extraction prompt per (document, chunk, section, batch).

    With ``sections`` (template_id, section_pos, section_name), those without a field get one prompt too, as batch 1.

    ``chunks``: doc_id, template_id, page_number, text, chunk_no. ``batches``: fields with batch_no.
    ``versions``: template_id, version, reference_text. Pages are taken in order until one would
    pass the budget; a chunk has few pages, a batch few fields, so both lists are bounded.
    """
    line = F.concat(
        F.lit("- field_id="), _or_none(F.col("field_id")), F.lit(' label="'), _or_none(F.col("field_label")),
        F.lit('" hint="'), F.coalesce("extraction_hint", F.lit("")), F.lit('"'))
    heads = batches.groupBy("template_id", "section_pos", "section_name", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("field_pos", line.alias("line")))).alias("f"), F.count("*").alias("n_fields"))
    if sections is not None:
        bare = sections.select("template_id", "section_pos", "section_name").distinct().join(batches.select("template_id", "section_pos").distinct(), ["template_id", "section_pos"], "left_anti")
        none = F.array().cast(heads.schema["f"].dataType)
        heads = heads.unionByName(bare.select("*", F.lit(1).alias("batch_no"), none.alias("f"), F.lit(0).cast("long").alias("n_fields")))
    heads = heads.join(versions, "template_id")
    head = F.concat(
        F.array(*[F.lit(x) for x in PROMPT_RULES]),
        F.array(F.concat(F.lit("TEMPLATE_ID: "), _or_none(F.col("template_id"))),
                F.concat(F.lit("TEMPLATE_VERSION: "), _or_none(F.col("version"))),
                F.lit("FIELDS TO EXTRACT:"), F.concat(F.lit("SECTION: "), _or_none(F.col("section_name")))),
        F.col("f.line"))
    heads = X.let(heads, _head=head)
    heads = X.let(heads, _len=F.aggregate("_head", F.lit(0), lambda n, x: n + F.length(x)))
    reference = F.concat(F.lit("\nREFERENCE TEMPLATE:\n"), X.truncate_text("reference_text", K.REFERENCE_MAX_CHARS))
    given = F.coalesce(F.col("reference_text"), F.lit("")) != ""
    heads = X.let(heads, _ref=F.when(given & (F.col("_len") + F.length(reference) < K.PROMPT_MAX_CHARS), reference))
    title = "\nDOCUMENT TEXT:"
    heads = heads.select(
        "template_id", "section_pos", "batch_no", "n_fields",
        F.concat("_head", F.when(F.col("_ref").isNotNull(), F.array("_ref")).otherwise(F.array().cast("array<string>")), F.array(F.lit(title))).alias("_head"),
        (F.col("_len") + F.coalesce(F.length("_ref"), F.lit(0)) + len(title)).alias("_len"))

    block = F.concat(F.lit("--- PAGE "), F.col("page_number").cast("string"), F.lit(" ---\n"), X.truncate_text("text", K.PAGE_MAX_CHARS))
    body = chunks.groupBy("doc_id", "template_id", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("page_number", block.alias("block")))).alias("p")).select(
        "doc_id", "template_id", "chunk_no", F.col("p.block").alias("_blocks"))
    df = body.join(heads, "template_id")

    start = F.struct(F.col("_len").alias("used"), F.lit(0).alias("taken"), F.lit(False).alias("full"))

    def take(acc: Column, b: Column) -> Column:
        full = acc["full"] | (acc["used"] + F.length(b) > K.PROMPT_MAX_CHARS)
        return F.struct(
            F.when(full, acc["used"]).otherwise(acc["used"] + F.length(b)).alias("used"),
            F.when(full, acc["taken"]).otherwise(acc["taken"] + 1).alias("taken"),
            full.alias("full"))

    df = X.let(df, _taken=F.aggregate("_blocks", start, take)["taken"])
    parts = F.concat("_head", F.slice("_blocks", F.lit(1), F.col("_taken")), F.array(F.lit(PROMPT_END)))
    return df.select(
        "doc_id", "template_id", "chunk_no", "section_pos", "batch_no", L.output_budget("n_fields").alias("output_tokens"),
        F.left(F.array_join(parts, "\n"), F.lit(K.PROMPT_MAX_CHARS)).alias("prompt"))


def validation_prompts(pages: DataFrame, fields: DataFrame, ident: list[str] | None = None) -> DataFrame:
    """Validation prompt per page row: the fields of (template_id, page_number), then the page text.

    ``ident`` names further columns of ``pages`` to keep.
    """
    key = ["template_id", "page_number"]
    line = F.concat(F.lit("- "), _or_none(F.col("field_label")), F.lit(" (type: "), F.coalesce("data_type", F.lit("text")), F.lit(") "),
                    F.coalesce("extraction_hint", F.lit("")))
    per_page = fields.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("section_pos", "field_pos", line.alias("line")))).alias("f")).select(*key, F.col("f.line").alias("_f"))
    df = pages.join(per_page, key, "left")
    parts = F.concat(
        F.array(*[F.lit(x) for x in VALIDATION_RULES], F.concat(F.lit("This is page "), F.col("page_number").cast("string"), F.lit(" of the document.")),
                F.lit(""), F.lit("FIELDS TO EXTRACT AND VALIDATE:")),
        F.coalesce("_f", F.array().cast("array<string>")),
        F.array(F.lit(""), F.lit("DOCUMENT TEXT:"), F.coalesce("text", F.lit("")), *[F.lit(x) for x in VALIDATION_STEPS]))
    return df.select(*(ident or []), *key, F.array_join(parts, "\n").alias("prompt"))


# --- model output ------------------------------------------------------------------------------------


def parse_output(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add ``error`` (NULL if usable) and ``parsed`` (VARIANT) to every response."""
    df = X.let(responses, parsed=F.try_parse_json(F.coalesce(F.col(response), F.lit(""))))
    df = X.let(df, _shape=F.coalesce(F.schema_of_variant(F.try_variant_get("parsed", "$.fields", "variant")), F.lit("")))
    error = (
        F.when(F.col("parsed").isNull(), F.when(F.col("done_reason") == "length", "truncated").otherwise("invalid_json"))
        .when(F.col("_shape") == "", "missing_fields")
        .when(~F.startswith("_shape", F.lit("ARRAY")), "fields_not_list")
    )
    return df.withColumn("error", error).drop("_shape")


def output_fields(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Field entries of the usable responses, with the JSON kinds of the source object's parts."""
    items = parsed.where("error is null").select(
        *keys, F.posexplode(F.try_variant_get("parsed", "$.fields", "array<variant>")).alias("pos", "item"))
    get = lambda path, t: F.try_variant_get("item", path, t)
    kind = lambda path: F.schema_of_variant(get(path, "variant"))
    return items.select(
        *keys, "pos", kind("$").alias("item_kind"),
        get("$.field_id", "string").alias("field_id"), get("$.field_name", "string").alias("field_name"),
        get("$.value", "string").alias("value"), get("$.confidence", "double").alias("confidence"),
        get("$.source.page_number", "int").alias("page_number"), get("$.source.source_text", "string").alias("source_text"),
        kind("$.source").alias("source_kind"), kind("$.source.page_number").alias("page_kind"),
        kind("$.source.source_text").alias("text_kind"), kind("$.source.confidence").alias("confidence_kind"))


def known_fields(fields: DataFrame, schema: DataFrame, keys: list[str]) -> DataFrame:
    return fields.join(schema.select(*keys, "field_id").distinct(), keys + ["field_id"], "left_semi")


def combine_batches(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Per chunk: number of batches and the failed ones (``batch: error``) in order."""
    failed = F.when(F.col("error").isNotNull(), F.struct("batch_no", F.concat_ws(": ", F.col("batch_no"), "error").alias("m")))
    return parsed.groupBy(*keys).agg(F.count("*").alias("batches"), F.array_sort(F.collect_list(failed)).alias("f")).select(
        *keys, "batches", F.size("f").alias("n_failed"), F.array_join("f.m", "; ").alias("failed_batches"))


def suggestions(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines that speak of a found or extracted value, split at the first colon."""
    keep = [c for c in df.columns if c != text]
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    low = F.lower("line")
    wanted = F.contains("line", F.lit(":")) & (
        F.contains(low, F.lit("extract")) | F.contains(low, F.lit("found")) | F.contains(low, F.lit("value")))
    rest = F.substring("line", F.instr("line", ":") + 1, F.length("line"))
    return lines.where(wanted).select(
        *keep, "line_no", X.strip(F.substring_index("line", ":", 1)).alias("field"), X.strip(rest).alias("value"))


# fixed value: pattern of a named score
SCORE = r"(?U)(\w+(?:\s+\w+)*?)[\s:]+(\d+(?:\.\d+)?)\s*%?"


def confidence_scores(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, field, score): named numbers in free text, per cent scaled to 0-1, last one wins."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(SCORE), 1).alias("n"), F.regexp_extract_all(text, F.lit(SCORE), 2).alias("x"))
    rows = df.select(*keys, F.posexplode(both).alias("pos", "s"))
    x = F.col("s.x").cast("double")
    score = F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x))
    return rows.select(*keys, "pos", X.strip("s.n").alias("field"), score.alias("score")).groupBy(*keys, "field").agg(
        F.max_by("score", "pos").alias("score"))


def validate_output(headers: DataFrame, fields: DataFrame, schema: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, errors) of chunk outputs.

    ``headers``: keys + expected_id, expected_version, template_id, template_version.
    ``fields``: keys + pos + the columns of ``output_fields``. ``schema``: template_id, field_id,
    field_label. The first problem in reading order rejects the output; accepted outputs are
    completed with the schema's missing fields and take their labels from the schema.
    """
    head = headers.withColumn("_head", F.when(~F.col("template_id").eqNullSafe(F.col("expected_id")), "Template ID mismatch").when(
        ~F.col("template_version").eqNullSafe(F.col("expected_version")), "Template version mismatch"))
    known = lookup(schema.select(F.col("template_id").alias("expected_id"), "field_id", F.col("field_label").alias("_label")))
    # an output's rows meet their header by merging and stay together: outputs are too many for a broadcast
    rows = head.hint("merge").join(fields.hint("merge"), keys, "left").join(known, ["expected_id", "field_id"], "left")
    rows = rows.withColumn("_first", F.min("pos").over(Window.partitionBy(*keys, "field_id")))
    number = F.col("confidence_kind").rlike("^(BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL.*)$")  # a JSON boolean counts as a number
    given = lambda c: F.coalesce(F.col(c), F.lit("VOID")) != "VOID"
    problem = (
        F.when(~F.startswith("item_kind", F.lit("OBJECT")), "Invalid field entry")
        .when(F.col("_label").isNull(), F.concat(F.lit("Unknown field: "), _or_none(F.col("field_id"))))
        .when(F.col("pos") > F.col("_first"), F.concat(F.lit("Duplicate field: "), F.col("field_id")))
        .when(given("source_kind") & ~F.startswith("source_kind", F.lit("OBJECT")), "Invalid source object")
        .when(given("page_kind") & ~F.col("page_kind").isin("BIGINT", "BOOLEAN"), "Invalid source page number")
        .when(given("text_kind") & (F.col("text_kind") != "STRING"), "Invalid source text")
        .when(given("confidence_kind") & ~number, "Invalid source confidence")
    )
    rows = rows.withColumn("_p", F.when(F.col("pos").isNotNull(), problem))
    judged = rows.groupBy(*keys).agg(
        F.first("expected_id").alias("expected_id"), F.first("_head").alias("_head"), F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("pos"))).alias("_p"))
    judged = judged.withColumn("error", F.coalesce("_head", "_p"))
    errors = judged.where("error is not null").select(*keys, "error")
    good = judged.where("error is null").select(*keys, "expected_id")
    wanted = good.join(known, "expected_id")
    got = fields.select(*keys, "field_id", "value", "confidence", "page_number", "source_text").withColumn("_got", F.lit(True)).hint("merge")
    accepted = wanted.join(got, [*keys, "field_id"], "left").select(
        *keys, "field_id", F.col("_label").alias("field_name"), "value",
        F.when(F.col("_got"), F.col("confidence")).otherwise(0.0).alias("confidence"), "page_number", "source_text")
    return accepted, errors


def merge_chunks(chunk_fields: DataFrame, keys=("job_id", "field_id")) -> DataFrame:
    """First non-NULL value per key in chunk order, else the first row.

    One hash aggregate with map-side combine; a hot key is reduced before the shuffle.
    """
    rest = [c for c in chunk_fields.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(F.col("value").isNull().alias("n"), F.col("chunk_no")))
    return chunk_fields.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def job_status(jobs: DataFrame, chunks: DataFrame, prefix: str = "Extraction failed for every page chunk: ") -> DataFrame:
    """Outcome per job from its chunks (job_id, chunk_no, first_page, last_page, done, error)."""
    failed = F.col("error").isNotNull()
    message = F.when(failed, F.struct("chunk_no", F.concat(
        F.lit("pages "), F.col("first_page").cast("string"), F.lit("-"), F.col("last_page").cast("string"), F.lit(": "), F.col("error")).alias("m")))
    per_job = chunks.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if("done").alias("done"), F.count_if(failed).alias("failed"),
        F.array_sort(F.collect_list(message)).alias("m"))
    df = jobs.select("job_id").join(per_job, "job_id", "left").withColumn("_all", F.array_join("m.m", "; "))
    finished = F.col("done") == F.col("total")
    return df.select(
        "job_id",
        F.when(F.col("total").isNull(), "failed").when(~finished, "processing")
        .when(F.col("failed") == F.col("total"), "failed").otherwise("completed").alias("status"),
        F.when(F.col("total").isNull(), 0)
        .when(finished & (F.col("failed") < F.col("total")), 100)
        .otherwise(F.least(F.lit(99), F.floor(F.col("done") / F.col("total") * 100))).cast("int").alias("progress"),
        F.when(F.col("total").isNull(), "No document pages available")
        .when(finished & (F.col("failed") == F.col("total")), F.concat(F.lit(prefix), "_all"))
        .when(finished & (F.col("failed") > 0), F.concat(
            F.lit("Completed with "), F.col("failed").cast("string"), F.lit("/"), F.col("total").cast("string"),
            F.lit(" page chunk(s) unresolved after retries (fields from those pages need manual entry): "), "_all")).alias("error_message"))


# --- storing -------------------------------------------------------------------------------------------


def required_missing(fields: DataFrame, jobs: DataFrame, schema: DataFrame) -> DataFrame:
    """(job_id, field_id) of required fields without a value. ``jobs``: job_id, template_key."""
    wanted = schema.where("required").select("template_key", "field_id")
    filled = fields.where(X.strip(F.coalesce("value", F.lit(""))) != "").select("job_id", "field_id")
    return jobs.join(wanted, "template_key").select("job_id", "field_id").join(filled, ["job_id", "field_id"], "left_anti")


def store_fields(merged: DataFrame, missing: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(extracted_fields, source_references) rows of merged output. ``jobs``: job_id, document_id."""
    flagged = merged.join(missing.withColumn("_m", F.lit(True)), ["job_id", "field_id"], "left")
    rows = flagged.select(
        "job_id", "field_id", F.col("field_name").alias("field_label"), "value", F.col("value").alias("original_value"), "confidence",
        F.when(F.col("_m"), "missing").otherwise("pending").alias("validation_status"), F.lit(True).alias("is_dynamic"))
    references = merged.join(jobs.select("job_id", "document_id"), "job_id").select(
        "job_id", "field_id", "document_id", "page_number", "source_text")
    return rows, references


def seed_static(fields: DataFrame, jobs: DataFrame, schema: DataFrame) -> DataFrame:
    """Rows for static fields with a default that have no row yet: verified, without confidence."""
    static = schema.where("not coalesce(is_dynamic, false) and default_value is not null and coalesce(field_id, '') <> ''").select(
        "template_key", "field_id", F.coalesce("field_label", "field_id").alias("field_label"), "default_value")
    return jobs.join(static, "template_key").join(fields.select("job_id", "field_id"), ["job_id", "field_id"], "left_anti").select(
        "job_id", "field_id", "field_label", F.col("default_value").alias("value"), F.col("default_value").alias("original_value"),
        F.lit(None).cast("double").alias("confidence"), F.lit("verified").alias("validation_status"), F.lit(False).alias("is_dynamic"))


def create_jobs(requests: DataFrame, projects: DataFrame, documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Accepted requests as pending jobs, refused ones with an error, told apart by ``error``.

    ``requests``: request_id, project_id, document_id, template_id (may be NULL: the project's own).
    """
    p = projects.select(F.col("id").alias("project_id"), F.col("template_key").alias("_own"), F.lit(True).alias("_p"))
    d = documents.select(F.col("id").alias("document_id"), F.col("project_id").alias("_owner"), "page_count")
    active = templates.where("is_active").select("template_id", F.col("template_key").alias("_asked"))
    df = requests.join(p, "project_id", "left").join(d, "document_id", "left").join(active, "template_id", "left")
    named = F.coalesce(F.col("template_id"), F.lit("")) != ""
    error = (
        F.when(F.col("_p").isNull(), "Project not found")
        .when(F.col("_owner").isNull() | (F.col("_owner") != F.col("project_id")), "Document not found for this project")
        .when(named & F.col("_asked").isNull(), "Template not found")
        .when(~named & F.col("_own").isNull(), "template_id is required")
    )
    ok = error.isNull()
    return df.select(
        "request_id", "project_id", "document_id", F.when(ok, F.coalesce("_asked", "_own")).alias("template_key"),
        F.when(ok, "pending").alias("status"), F.when(ok, 0).alias("progress"),
        F.when(ok, F.coalesce("page_count", F.lit(0))).alias("total_pages"), error.alias("error"))


# fixed value: wording of the recovery message
INTERRUPTED = ("Extraction was interrupted by a server restart before it finished. Any fields already saved from earlier pages are kept - "
               "re-run extraction to pick up the rest.")


def recover_orphans(jobs: DataFrame) -> DataFrame:
    running_ = F.col("status") == "processing"
    return jobs.withColumns({
        "status": F.when(running_, "failed").otherwise(F.col("status")),
        "error_message": F.when(running_, INTERRUPTED).otherwise(F.col("error_message"))})


def fold_edits(edits: DataFrame) -> DataFrame:
    """Net effect of an edit log per (job_id, field_id): last status, last value given."""
    at = F.struct("ts", "edit_id")
    return edits.where(F.col("validation_status").isin(K.VALIDATION_STATUSES)).groupBy("job_id", "field_id").agg(
        F.max_by("validation_status", at).alias("new_status"),
        F.max_by("value", F.when(F.col("value").isNotNull(), at)).alias("new_value"))


def apply_field_edits(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Fields after the edit log; an edited field loses its verification."""
    df = fields.join(fold_edits(edits), ["job_id", "field_id"], "left")
    edited = F.col("new_status").isNotNull()
    return df.withColumns({
        "value": F.coalesce("new_value", "value"),
        "validation_status": F.coalesce("new_status", "validation_status"),
        "verification_status": F.when(~edited, F.col("verification_status"))}).drop("new_status", "new_value")


def job_results(jobs: DataFrame, fields: DataFrame, references: DataFrame, templates: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Jobs with nested fields, each with its source references, in bounded parts.

    ``jobs`` carries job_id; a field has few references, a job's fields are cut into parts of ``part_size``.
    """
    key = ["job_id", "field_id"]
    refs = references.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page_number", "source_text"))).alias("source_references"))
    cols = [c for c in ("field_label", "value", "original_value", "confidence", "validation_status", "verification_status", "is_dynamic")
            if c in fields.columns]
    full = fields.join(refs, key, "left").withColumn("source_references", F.coalesce("source_references", F.array()))
    nested = nest(full, ["job_id"], ["field_id"], ["field_id", *cols, "source_references"], "extracted_fields", part_size)
    body = jobs.join(templates.select("template_key", F.col("template_id").alias("template_code"), "template_name"), "template_key", "left")
    return body.join(nested, "job_id", "left").withColumns({
        "part_no": F.coalesce("part_no", F.lit(0)), "extracted_fields": F.coalesce("extracted_fields", F.array())})


def fill_counts(fields: DataFrame) -> DataFrame:
    return fields.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("value", F.lit("")) != "").alias("filled"))


def display_values(jobs: DataFrame, schema: DataFrame, fields: DataFrame) -> DataFrame:
    """Value shown for every schema field of a job: extracted if non-empty, else the default."""
    shown = jobs.join(schema.select("template_key", "section_pos", "field_pos", "field_id", "field_label", "default_value"), "template_key")
    return shown.join(fields.select("job_id", "field_id", "value"), ["job_id", "field_id"], "left").select(
        "job_id", "section_pos", "field_pos", "field_id", F.coalesce(F.nullif("field_label", F.lit("")), "field_id").alias("field_label"),
        F.coalesce(F.nullif("value", F.lit("")), "default_value", F.lit("")).alias("shown"))
