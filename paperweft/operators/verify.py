"""Verification verdicts and the review list."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType

from ..functions import fixed as K, text as X


@F.arrow_udf(ArrayType(BooleanType()))
def _searches(value: pa.Array, patterns: pa.Array) -> pa.Array:
    """Per rule: does the pattern occur in the value; NULL for an invalid pattern.

    Rules without a pattern cost no Python step a row: only values that meet one are read out of their batch.
    """
    counts = pc.fill_null(pc.list_value_length(patterns), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    owner = np.repeat(np.arange(len(counts)), counts)
    given = patterns.flatten().dictionary_encode()
    code = pc.fill_null(given.indices, -1).to_numpy(zero_copy_only=False)
    hit, valid = np.ones(len(owner), bool), np.ones(len(owner), bool)
    for i, pattern in enumerate(given.dictionary.to_pylist()):
        if not pattern:
            continue
        rows = np.flatnonzero(code == i)
        try:
            search = re.compile(pattern).search
        except re.error:
            valid[rows] = False
            continue
        hit[rows] = [search(v) is not None for v in value.take(pa.array(owner[rows])).to_pylist()]
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hit, mask=~valid), mask=patterns.is_null())


def first_rule_failure(rules: Column, found: Column, value: Column) -> Column:
    """Message of the first failing rule, NULL if none fails.

    ``found`` holds one search result per rule. An invalid pattern skips its whole rule.
    """
    message = lambda r, default: F.coalesce(F.nullif(r["message"], F.lit("")), default)

    def failure(rule: Column, i: Column) -> Column:
        hit = F.get(found, i)
        short = rule["min_length"].isNotNull() & (F.length(value) < rule["min_length"])
        return (
            F.when(hit.isNull(), None)
            .when(~hit, message(rule, F.lit("Value does not match the pattern this template requires.")))
            .when(short, message(rule, F.concat(
                F.lit("Value is shorter than the required "), rule["min_length"].cast("string"), F.lit(" characters."))))
        )

    return F.get(F.filter(F.transform(rules, failure), lambda m: m.isNotNull()), F.lit(0))


def verify(fields: DataFrame, schema: DataFrame) -> DataFrame:
    """(job_id, field_id, status, required, expected_hint, reason).

    ``fields`` carries template_key; ``schema`` carries rules ``array<struct<pattern,min_length,message>>``.
    Patterns are searched with Python's regex semantics, in Arrow batches, each compiled once per
    batch; only values that reach the rule check carry patterns into the batch.
    """
    s = schema.select("template_key", "field_id", "required", "extraction_hint", "rules")
    df = fields.join(s, ["template_key", "field_id"], "left")
    df = X.let(df, _v=X.strip(F.coalesce("value", F.lit(""))), _required=F.coalesce("required", F.lit(False)))
    low = F.col("confidence").isNotNull() & (F.col("confidence") < K.LOW_CONFIDENCE)
    early = F.col("validation_status").eqNullSafe(F.lit("rejected")) | (F.col("_v") == "") | low
    df = df.withColumn("_found", _searches(F.when(~early, F.col("_v")), F.when(~early, F.col("rules.pattern"))))
    df = X.let(df, _failure=F.when(~early, first_rule_failure(F.col("rules"), F.col("_found"), F.col("_v"))))
    rejected = F.col("validation_status").eqNullSafe(F.lit("rejected"))
    percent = F.bround(F.col("confidence") * 100).cast("int").cast("string")
    status = (
        F.when(rejected, "mismatch")
        .when(F.col("_v") == "", F.when(F.col("_required"), "not_found").otherwise("review"))
        .when(low, "review")
        .when(F.col("_failure").isNotNull(), "mismatch")
        .otherwise("match")
    )
    reason = (
        F.when(rejected, "This value was rejected during review.")
        .when(F.col("_v") == "", F.when(F.col("_required"), "Required value was not found in the source document.").otherwise(
            "Optional value was not found in the source document."))
        .when(low, F.concat(F.lit("Low extraction confidence ("), percent, F.lit("%) — please double-check.")))
        .otherwise(F.col("_failure"))
    )
    return df.select("job_id", "field_id", status.alias("status"), F.col("_required").alias("required"),
                     F.col("extraction_hint").alias("expected_hint"), reason.alias("reason"))


def store_verdicts(fields: DataFrame, verdicts: DataFrame) -> DataFrame:
    v = verdicts.select("job_id", "field_id", F.col("status").alias("_s"))
    return fields.join(v, ["job_id", "field_id"], "left").withColumn(
        "verification_status", F.coalesce("_s", "verification_status")).drop("_s")


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Counts per job, one column per verdict, all present."""
    return verdicts.groupBy("job_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in K.VERDICTS])


def attention(fields: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Fields that need a reviewer, with their priority (0 first)."""
    v = verdicts.select("job_id", "field_id", F.col("status").alias("_s"), F.col("required").alias("_r"))
    df = fields.join(v, ["job_id", "field_id"], "left")
    blank = X.strip(F.coalesce("value", F.lit(""))) == ""
    status = F.coalesce(F.col("_s"), F.when(blank, "not_found").otherwise("match"))
    required = F.coalesce("_r", F.lit(False))
    priority = (
        F.when((status == "not_found") & required, 0).when(status == "not_found", 1)
        .when(status == "mismatch", 2).when(status == "review", 3).otherwise(4)
    )
    flagged = F.when(F.col("_s").isNotNull(), F.col("_s") != "match").otherwise(blank)
    return df.where(flagged).select("job_id", "field_id", "value", status.alias("status"), required.alias("required"), priority.alias("priority"))


def required_missing_counts(attention_rows: DataFrame) -> DataFrame:
    return attention_rows.groupBy("job_id").agg(F.count_if(F.col("required") & (F.col("status") == "not_found")).alias("required_missing"))
