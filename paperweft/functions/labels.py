"""Small derived labels: display names, statuses, indicators, budgets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed as K
from .text import ColumnOrName, col, strip, title_case


def file_stem(file_name: ColumnOrName) -> Column:
    base = F.regexp_extract(col(file_name), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def display_name(file_name: ColumnOrName) -> Column:
    return title_case(strip(F.translate(file_stem(file_name), "_-", "  ")))


def match_indicator(value: ColumnOrName, default: ColumnOrName) -> Column:
    v, d = F.lower(strip(value)), F.lower(strip(default))
    return (
        F.when((F.coalesce(col(value), F.lit("")) == "") | (F.coalesce(col(default), F.lit("")) == ""), None)
        .when(v == d, "exact")
        .when(F.contains(v, d) | F.contains(d, v), "partial")
        .otherwise("different")
    )


def time_ago(ts: ColumnOrName, now: Column) -> Column:
    """Relative label against ``now`` (a parameter, never the clock)."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(col(ts))) / 60_000_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(minutes < 1, "Just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(col(ts), "M/d/yyyy"))
    )


def project_status(job_status: ColumnOrName, n_documents: ColumnOrName) -> Column:
    s = col(job_status)
    return (
        F.when(s == "completed", "Completed")
        .when(s == "processing", "Processing")
        .when(s == "failed", "Failed")
        .when(s == "pending", "Pending")
        .when(col(n_documents) > 0, "Awaiting Extraction")
        .otherwise("Draft")
    )


def unclear(c: ColumnOrName) -> Column:
    x = F.lower(col(c))
    return F.contains(x, F.lit("uncertain")) | F.contains(x, F.lit("unclear"))


def output_budget(n_fields: ColumnOrName) -> Column:
    estimate = F.lit(K.TOKENS_BASE) + col(n_fields) * K.TOKENS_PER_FIELD
    return F.greatest(F.lit(K.TOKENS_MIN), F.least(F.lit(K.TOKENS_MAX), estimate)).cast("int")
