"""From model responses to stored, verified fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.cut import cut
from ..operators.extract import merge_chunks, output_fields, parse_output, required_missing, seed_static, store_fields, validate_output
from ..operators.verify import verify


def store_responses(responses: DataFrame, jobs: DataFrame, schema: DataFrame) -> dict[str, DataFrame]:
    """Parse, validate, merge, store, seed and verify.

    ``responses``: job_id, chunk_no, response, done_reason (one per chunk). ``jobs``: job_id,
    document_id, template_key, template_id, version. ``schema``: template fields with rules.
    """
    key = ["job_id", "chunk_no"]
    parsed = parse_output(responses)
    heads = parsed.where("error is null").join(jobs.select("job_id", F.col("template_id").alias("expected_id"), F.col("version").alias("expected_version")), "job_id").select(
        *key, "expected_id", "expected_version", F.try_variant_get("parsed", "$.template_id", "string").alias("template_id"),
        F.try_variant_get("parsed", "$.template_version", "string").alias("template_version"))
    accepted, refused = validate_output(heads, output_fields(parsed, key), schema, key)
    merged = cut(merge_chunks(accepted).drop("chunk_no"))
    missing = required_missing(merged, jobs.select("job_id", "template_key"), schema)
    rows, references = store_fields(merged, missing, jobs)
    seeded = seed_static(rows, jobs.select("job_id", "template_key"), schema)
    fields = rows.unionByName(seeded)
    verdicts = verify(fields.join(jobs.select("job_id", "template_key"), "job_id"), schema)
    errors = parsed.where("error is not null").select(*key, "error").unionByName(refused)
    return {"fields": fields, "references": references, "verdicts": verdicts, "errors": errors}
