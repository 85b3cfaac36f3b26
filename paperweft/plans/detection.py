"""Which specifications does each document contain?"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.match import detect_specifications, template_signals


def detect(pages: DataFrame, templates: DataFrame, fields: DataFrame) -> DataFrame:
    """Signals of the active templates matched against all pages."""
    active = templates.where("is_active")
    return detect_specifications(pages, template_signals(active, fields.join(active.select("template_id"), "template_id", "left_semi")))
