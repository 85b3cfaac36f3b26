"""Text helpers for the oracle side (DuckDB SQL)."""

from paperweft.functions import fixed as K


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = K.WS
WSC = q(K.WS_CHARS)


def strip(x: str) -> str:
    return f"trim({x}, {WSC})"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')")


def norm(x: str) -> str:
    return 'lower(' + squeeze(f"coalesce({x}, '')") + ')'


def slug(x: str, default: str = "field") -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({strip(x)}), '[^a-z0-9]+', '_', 'g'), '_'), ''), '{default}')"


def norm_label(x: str) -> str:
    y = strip(f"coalesce({x}, '')")
    y = f"regexp_replace({y}, {q('^' + K.BULLET + WS + '+')}, '')"
    y = f"regexp_replace({y}, {q('^' + K.OUTLINE + WS + '+')}, '')"
    return strip(f"rtrim({squeeze(y)}, ':')")


def words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"


def stop() -> str:
    return "(" + ", ".join(q(w) for w in K.STOPWORD_LABELS) + ")"


def candidates(source: str, raw: str, keep: str = "*") -> str:
    """Sub-select adding kind, prefix, label, value, offset_ (NULL kind: no candidate) to ``source``."""
    return f"""(
      SELECT *,
        CASE WHEN ok_ THEN kind_ END AS kind,
        CASE WHEN ok_ THEN coalesce(prefix_, '') END AS prefix,
        CASE WHEN ok_ THEN label_ END AS label,
        CASE WHEN ok_ THEN {strip('tail_')} END AS value,
        CASE WHEN ok_ THEN CAST(length(raw_) - length(ltrim(raw_, {WSC}))
             + CASE WHEN kind_ = 'value' THEN length(line_) - length(tail_) ELSE length(lead_) END AS INTEGER) END AS offset_
      FROM (
        SELECT *, coalesce(kind_ IS NOT NULL AND label_ <> '' AND lower(label_) NOT IN {stop()}
                  AND {words(squeeze('label_'))} <= 8
                  AND {norm_label('label_')} <> ''
                  AND NOT regexp_matches({norm_label('label_')}, {q(K.LIST_MARKER)}), false) AS ok_
        FROM (
          SELECT *, {strip("regexp_extract(line_, pat_, 3)")} AS label_,
                 regexp_extract(line_, pat_, 2) AS prefix_, regexp_extract(line_, pat_, 1) AS lead_,
                 CASE WHEN kind_ = 'value' THEN regexp_extract(line_, {q(K.LABEL_VALUE)}, 5) ELSE '' END AS tail_
          FROM (
            SELECT *, CASE kind_ WHEN 'value' THEN {q(K.LABEL_VALUE)} WHEN 'blank' THEN {q(K.LABEL_BLANK)} ELSE {q(K.LABEL_ONLY)} END AS pat_
            FROM (
              SELECT *, CASE WHEN line_ = '' OR length(line_) > 120 THEN NULL
                             WHEN regexp_matches(line_, {q(K.LABEL_VALUE)}) THEN 'value'
                             WHEN regexp_matches(line_, {q(K.LABEL_BLANK)}) THEN 'blank'
                             WHEN regexp_matches(line_, {q(K.LABEL_ONLY)}) THEN 'label' END AS kind_
              FROM (SELECT *, coalesce({raw}, '') AS raw_, {strip(f"coalesce({raw}, '')")} AS line_ FROM {source})))))
    )"""


def numbered(x: str) -> str:
    y = strip(f"coalesce({x}, '')")
    return f"(length({y}) <= 100 AND regexp_matches({y}, {q(K.NUMBERED_HEADING)}))"


def heading(style: str, x: str) -> str:
    y = strip(f"coalesce({x}, '')")
    s = f"lower(coalesce({style}, ''))"
    return (f"(starts_with({s}, 'heading') OR {s} = 'title' OR {numbered(x)} OR "
            f"({y} <> '' AND length({y}) <= 60 AND upper({y}) = {y} AND right({y}, 1) NOT IN ('.', ':')))")


def table_label(x: str) -> str:
    y = squeeze(f"coalesce({x}, '')")
    return (f"({y} <> '' AND NOT regexp_matches({y}, {q(K.LIST_MARKER)}) AND lower({y}) NOT IN {stop()} "
            f"AND length({y}) <= 80 AND {words(y)} <= 8)")


def is_code(x: str) -> str:
    y = strip(f"coalesce({x}, '')")
    d = f"len(regexp_extract_all({y}, '[0-9]'))"
    return f"({d} >= 2 AND {d} * 5 >= length({y}))"


def row_cells(x: str) -> str:
    """List of cells (any length)."""
    return (f"list_filter(list_transform(string_split(replace({x}, chr(9), '|'), '|'), lambda c: {strip('c')}), "
            f"lambda c: c <> '')")


def title_case(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '\\p{{L}}+|\\P{{L}}+'), "
            f"lambda r: upper(left(r, 1)) || substr(r, 2)), '')")


def unescape4(x: str) -> str:
    """The four references that occur in the given pages."""
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
