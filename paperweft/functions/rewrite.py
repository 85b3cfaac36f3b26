"""Instruction-driven text rewriting by fixed rules (first keyword that applies decides)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed as K
from .html import drop_tags
from .text import ColumnOrName, col, squeeze, strip


def _sub_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, "(?iU)" + p[0], p[1]), pairs, text)


def _with_full_stop(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit(".")), c).otherwise(F.concat(c, F.lit(".")))


def _asks(instruction: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(instruction, F.lit(w)) for w in words])


def transform_text(text: ColumnOrName, instruction: ColumnOrName) -> Column:
    body = strip(F.coalesce(col(text), F.lit("")))
    raw = squeeze(drop_tags(body))
    inst = F.lower(strip(instruction))
    sentences = F.filter(F.transform(F.split(raw, "[.!?]+"), strip), lambda s: s != "")
    items = F.array_join(F.transform(sentences, lambda s: F.concat(F.lit("<li>"), s, F.lit("</li>"))), "")
    first = F.left(raw, F.lit(1))
    highlighted = [(p, K.HIGHLIGHT_OPEN + "$1" + K.HIGHLIGHT_CLOSE) for p in K.HIGHLIGHT_PATTERNS]
    return (
        F.when(body == "", "")
        .when(_asks(inst, "formal", "professional"),
              F.concat(F.lit(K.FORMAL_FRAME), _with_full_stop(_sub_all(raw, K.FORMAL_REWRITES))))
        .when(_asks(inst, "highlight", "keyword"), _sub_all(body, highlighted))
        .when(_asks(inst, "simplify", "short"),
              F.when(F.size(sentences) > 0, F.concat(F.array_join(sentences, " · "), F.lit("."))).otherwise(raw))
        .when(_asks(inst, "summarize", "summary"), F.concat(F.lit("<strong>Summary:</strong> "), raw))
        .when(_asks(inst, "bullet", "list"),
              F.concat(F.lit("<ul>"),
                       F.when(F.size(sentences) > 1, items).otherwise(F.concat(F.lit("<li>"), raw, F.lit("</li>"))),
                       F.lit("</ul>")))
        .when(_asks(inst, "grammar", "fix"),
              _with_full_stop(F.concat(F.when(first == F.lower(first), F.upper(first)).otherwise(first),
                                       F.substring(raw, 2, 2147483647))))
        .otherwise(F.concat(raw, F.lit(K.REVIEWED_SUFFIX)))
    )
