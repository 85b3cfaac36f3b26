import random
import re

import pytest
from pyspark.sql import functions as F

from paperweft.functions import fixed as K, html as H, labels as L, rewrite as R, text as X


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr).first()[0]


def candidate(spark, line):
    df = spark.createDataFrame([(line,)], "c string")
    staged = X.with_candidate(df, "c", "r").first()["r"]
    inline = df.select(X.candidate_field("c").alias("r")).first()["r"]
    assert (staged is None) == (inline is None)
    if staged is not None:
        assert (staged["kind"], staged["label"], staged["value"]) == (inline["kind"], inline["label"], inline["value"])
    return staged and (staged["kind"], staged["label"], staged["value"])


@pytest.mark.parametrize("line, expected", [
    ("Spec. No.: IP009-43", ("value", "Spec. No.", "IP009-43")),
    ("1.2 Rated Voltage - 415 - V", ("value", "Rated Voltage - 415", "V")),
    ("b) Prepared By ______", ("blank", "Prepared By", "")),
    ("• Area : ELECTRICAL", ("value", "Area", "ELECTRICAL")),
    ("Project Name", ("label", "Project Name", "")),
    ("Note: x", None),
    ("A: b", None),
    ("x" * 121, None),
    ("a1 b2 c3 d4 e5 f6 g7 h8 i9", None),
    ("", None),
    (None, None),
])
def test_candidate_field(spark, line, expected):
    assert candidate(spark, line) == expected


def test_value_offset(spark):
    raw = "   1.2 Rated: 415 V"
    df = X.with_candidate(spark.createDataFrame([(raw,)], "c string"), "c", "r")
    assert raw[df.first()["r"]["offset"]:] == "415 V"


@pytest.mark.parametrize("text, number", [("4.5.10 Earthing", "4.5.10"), ("1.2.3.4 x", None), ("123", None), ("7. Scope", "7")])
def test_numbered_heading(spark, text, number):
    got = one(spark, X.numbered_heading("c"), text)
    assert (got and got["number"]) == number


@pytest.mark.parametrize("style, text, expected", [
    ("Normal", "4.5.10 Earthing", True), ("Normal", "123", True), ("Normal", "TITLE:", False), ("Heading 2", "abc", True),
    ("Title", "abc", True), ("Normal", "abc", False), ("Normal", "", False), (None, "SCOPE", True)])
def test_is_heading(spark, style, text, expected):
    df = spark.createDataFrame([(style, text)], "s string, t string")
    assert df.select(X.is_heading("s", "t")).first()[0] is expected


def garbage(text, min_ratio=0.6):
    """Brute force: ratio of plausible characters, then the leftmost shortest chunk repeated three times."""
    s = text.strip()
    if not s:
        return True
    ok = sum(c.isascii() and (c.isalnum() or c in ".,;:-+/()%'\"&#@=_") or c.isspace() for c in s)
    if ok / len(s) < min_ratio:
        return True
    for i in range(len(s)):
        for n in range(3, 26):
            c = s[i:i + n]
            if len(c) < n or "\n" in c or s[i:i + 3 * n] != c * 3:
                continue
            k = 3
            while s[i + k * n:i + (k + 1) * n] == c:
                k += 1
            chunk = c.strip()
            return not set(chunk) <= set("-_.=*# ") and len(chunk) >= 3 and k * n >= 0.3 * len(s)
    return False


def test_is_garbage(spark):
    texts = ["", "  ", "abcabcabc", "------------", "é" * 41 + "a" * 59, "é" * 40 + "a b" * 20, "xyz " * 3 + "q w e r t y " * 9,
             "1545-E0..x1545-E0..x1545-E0..x", "plain words only", "abc\nabc\nabc", "hello hello hello there my friend of old"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.is_garbage("t").alias("g")).collect()
    assert {r["i"]: r["g"] for r in rows} == {i: garbage(t) for i, t in enumerate(texts)}


def test_is_garbage_of_long_texts(spark):
    rnd = random.Random(14)
    filler = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    texts = []
    for _ in range(400):
        chunk, n = filler(rnd.randint(3, 26)), rnd.choice([50, 60, 61, 119, 300, 900])
        run = (chunk * n)[: rnd.randint(n // 5, n // 2)]
        at = rnd.randint(0, n - len(run))
        texts.append(filler(at) + run + filler(n - at - len(run)))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.is_garbage("t").alias("g")).collect()
    want = {i: garbage(t) for i, t in enumerate(texts)}
    assert {r["i"]: r["g"] for r in rows} == want and 40 < sum(want.values()) < 360


def test_garbage_is_searched_for_once(spark):
    df = spark.createDataFrame([("a",)], "t string")
    signs = X.let(df, _s=X.garbage_signs("t"))
    for once in (signs.select(X.looks_garbage("_s").alias("a"), X.looks_garbage("_s", 0.9).alias("b")), df.select(X.is_garbage("t").alias("a"))):
        plan = once._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(K.REPEATED_CHUNK + ", 0)") == 1  # was once for every use of run and chunk


def test_plausible_share_of_every_character(spark):
    text = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000, 7), 0x1F600]))
    kept = one(spark, F.length(F.regexp_replace("c", K.IMPLAUSIBLE_CHAR, "")), text)
    assert one(spark, X._plausible_share(F.col("c")), text) == kept / len(text)


def test_small_functions(spark):
    assert one(spark, X.clean_text("c"), " a\xa0 b \r\n\r\n\tc\t d ") == "a b\nc d"
    assert one(spark, X.slug("c"), "  Ärea / No. 1 ") == "rea_no_1"
    assert one(spark, X.slug("c", "template"), "--") == "template"
    assert one(spark, X.normalize_label("c"), "• a) Rated  Voltage :") == "Rated Voltage"
    assert one(spark, X.dedupe_merged("c"), ["a", "a", "b", "a"], "array<string>") == ["a", "b", "a"]
    assert one(spark, X.row_cells("c"), " a | b |\t c ") == ["a", "b", "c"]
    assert one(spark, X.row_cells("c"), "a |  | ") is None
    assert one(spark, X.truncate_text("c", 5), "abcd efgh") == "abcd\n...[truncated]"
    assert one(spark, X.is_code("c"), "IP009-43") is True
    assert one(spark, X.is_code("c"), "abcdefghijk12") is False
    assert one(spark, H.html_plain("c"), "<p>A &amp;amp; B&nbsp;&euro;</p>") == "a &amp; b €"
    assert one(spark, H.tagged_ids("c"), '<a data-field-id="x"><b data-field-id="y"><c data-field-id="x">') == ["x", "y"]
    assert one(spark, L.display_name("c"), "a_b-c2d.v1.PDF") == "A B C2D.V1"
    assert one(spark, L.output_budget("c"), 2, "int") == 512
    assert one(spark, L.output_budget("c"), 100, "int") == 4096
    assert one(spark, R.transform_text("c", F.lit("make formal")), "we need to check <b>it</b>") == (
        "The Scope of Work and design requirements entail: we shall be required to verify and inspect it.")
    assert one(spark, R.transform_text("c", F.lit("LIST")), "One. Two!") == "<ul><li>One</li><li>Two</li></ul>"
    assert one(spark, R.transform_text("c", F.lit("x")), "  ") == ""


def test_title_case_matches_python(spark):
    for s in ["o'neil's 3rd pump", "ALL CAPS-text", "mixed Case"]:
        assert one(spark, X.title_case("c"), s) == s.title()


def test_strip_matches_python(spark):
    for s in [" a　", "\x1c a \x85", "\xa0\n x"]:
        assert one(spark, X.strip("c"), s) == s.strip()
        assert one(spark, X.squeeze("c"), s + "  b") == re.sub(r"\s+", " ", s + "  b").strip()
