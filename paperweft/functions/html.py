"""HTML to text. Patterns, not a parser: a block ends at the first closing tag of a listed kind."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from . import fixed as K
from .text import ColumnOrName, col, normalize, strip


@F.pandas_udf(StringType())
def _unescape_all(s: pd.Series) -> pd.Series:
    return s.map(_html.unescape, na_action="ignore")


def unescape(c: ColumnOrName, entities: dict[str, str] | None = None) -> Column:
    """Character references to text.

    By default every HTML5 reference is resolved by the standard library in Arrow batches. Where
    the corpus is known to use only a few, pass them (``{"&amp;": "&"}``): the work then stays in
    generated code. ``&amp;`` is replaced last so that nothing is resolved twice.
    """
    if entities is None:
        return _unescape_all(col(c))
    out = col(c)
    for name in sorted(entities, key=lambda n: n == "&amp;"):
        out = F.replace(out, F.lit(name), F.lit(entities[name]))
    return out


def drop_tags(c: ColumnOrName, by: str = " ") -> Column:
    return F.regexp_replace(col(c), K.TAG, by)


def html_plain(c: ColumnOrName, entities: dict[str, str] | None = None) -> Column:
    return normalize(drop_tags(unescape(F.coalesce(col(c), F.lit("")), entities)))


def html_paragraphs(c: ColumnOrName) -> Column:
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?i)</p>", "\n\n")
    return F.filter(F.transform(F.split(drop_tags(x, ""), "\n"), strip), lambda p: p != "")


def tagged_ids(c: ColumnOrName) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(K.TAGGED_ID), 1))


def html_blocks(c: ColumnOrName) -> Column:
    """Inner text of block-level elements in document order, tags dropped, references kept."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(K.HTML_BLOCK), 1), lambda b: drop_tags(b))
