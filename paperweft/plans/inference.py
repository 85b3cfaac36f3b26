"""Draft schema of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.schema import infer_fields, inferred_sections, static_blocks
from ..operators.structure import estimate_pages


def draft_schema(blocks: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    """Fields, sections and static blocks, with pages estimated from the block sequence."""
    paged = estimate_pages(blocks)
    fields = infer_fields(paged, cells)
    return {"fields": fields, "sections": inferred_sections(blocks, fields), "static_blocks": static_blocks(paged, cells)}
