"""Matching templates against documents and fields against pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed as K, html as H, text as X
from .cut import lookup, merged, written
from .pages import html_fields
from .substring import numbered_hits, substring_hits


def template_signals(templates: DataFrame, fields: DataFrame) -> DataFrame:
    """Long (template_id, kind, needle): title, specification number, distinct labels."""
    title = X.normalize("template_name")
    titles = templates.select("template_id", F.lit("title").alias("kind"), title.alias("needle")).where(
        (F.length("needle") >= K.TITLE_MIN_CHARS) & ~F.rlike("needle", F.lit(K.PLACEHOLDER_TITLE)))
    numbers = templates.select("template_id", F.lit("number").alias("kind"), X.normalize("specification_number").alias("needle"))
    labels = fields.select("template_id", F.lit("label").alias("kind"), F.explode(F.array("section_name", "field_label")).alias("needle"))
    labels = labels.withColumn("needle", X.normalize("needle")).where(F.length("needle") >= K.LABEL_MIN_CHARS).distinct()
    return titles.unionByName(numbers.where("needle <> ''")).unionByName(labels)


#: Consecutive pages of a document that one task may get.
STRETCH = 4_096


def detect_specifications(pages: DataFrame, signals: DataFrame) -> DataFrame:
    """(doc_id, template_id, match_status, match_confidence, matched_pages) for every pair with a hit.

    A pair without any hit has confidence 0 and status ``not_found``; those pairs are implied and
    counted by ``detection_counts`` rather than written out, so the output follows the hits and not
    documents x templates.
    """
    # texts are had and normalized once and dealt once, by document and stretch of pages: hits, which are many times their
    # texts, then meet templates and are counted where they are found
    stretch = F.coalesce(F.floor(F.col("page_number") / STRETCH), F.lit(0))
    texts = pages.select("doc_id", "page_number", stretch.alias("_stretch"), X.normalize("text").alias("text")).repartition("doc_id", "_stretch")
    hits, needles = numbered_hits(texts, ["doc_id", "_stretch", "page_number"], signals)
    # pages of a needle as bits of 64-page words: rows shrink to document x needle before they meet the templates
    word, bit = F.floor(F.col("page_number") / 64).cast("int"), F.expr("shiftleft(1L, cast(pmod(page_number, 64) as int))")
    sets = hits.groupBy("doc_id", "_stretch", "_id", word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    wanted = lookup(needles.join(signals, "needle").select("_id", "template_id", "kind"))
    by_word = sets.join(wanted, "_id").groupBy("doc_id", "_stretch", "template_id", "_word").agg(
        F.max(F.col("kind") == "title").alias("title_hit"), F.max(F.col("kind") == "number").alias("number_hit"),
        F.sum(F.when(F.col("kind") == "label", F.bit_count("_bits")).otherwise(0)).alias("label_hits"), F.bit_or("_bits").alias("_bits"))
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("_bits", i) == 1)
    by_word = by_word.withColumn("matched_pages", F.transform(on, lambda i: (F.col("_word") * 64 + i).cast("int")))

    def together(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.max("title_hit").alias("title_hit"), F.max("number_hit").alias("number_hit"), F.sum("label_hits").alias("label_hits"),
            F.sort_array(F.flatten(F.collect_list("matched_pages"))).alias("matched_pages"))

    found = together(by_word, "doc_id", "_stretch", "template_id")
    # only documents of several stretches are dealt again
    extent = pages.groupBy("doc_id").agg(F.min(stretch).alias("_low"), F.max(stretch).alias("_high"))
    long = written(extent.where("_low < _high").select(F.col("doc_id").alias("_long")))
    if long.isEmpty():
        found = found.drop("_stretch")
    else:
        long, same = lookup(long), F.col("doc_id").eqNullSafe(F.col("_long"))
        found = found.join(long, same, "left_anti").drop("_stretch").unionByName(together(found.join(long, same, "left_semi"), "doc_id", "template_id"))
    n_labels = lookup(signals.groupBy("template_id").agg(F.count_if(F.col("kind") == "label").alias("n_labels")))
    signal = F.least(F.lit(1.0), F.col("label_hits") / F.greatest("n_labels", F.lit(1)))
    confidence = (
        F.when(F.col("title_hit"), 0.75 + F.when(F.col("number_hit"), 0.15).otherwise(0.0) + 0.10 * F.col("_s"))
        .when(F.col("number_hit"), 0.45 + 0.2 * F.col("_s"))
        .when(F.col("_s") > 0, F.least(F.lit(0.55), 0.15 + 0.4 * F.col("_s")))
        .otherwise(0.0)
    )
    scored = found.join(n_labels, "template_id").withColumn("_s", signal).withColumn(
        "match_confidence", F.round(F.least(confidence, F.lit(1.0)), 2))
    status = (
        F.when(F.col("match_confidence") >= K.MATCH_THRESHOLD, "matched")
        .when(F.col("match_confidence") >= K.REVIEW_THRESHOLD, "review")
        .otherwise("not_found")
    )
    return scored.select("doc_id", "template_id", status.alias("match_status"), "match_confidence", "matched_pages")


def detection_counts(documents: DataFrame, detected: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates per status for every document; ``not_found`` includes the implied pairs."""
    per_doc = detected.groupBy("doc_id").agg(
        F.count_if(F.col("match_status") == "matched").alias("matched"),
        F.count_if(F.col("match_status") == "review").alias("review"))
    total = F.lit(templates.select("template_id").distinct().count())
    counted = documents.select("doc_id").distinct().join(per_doc, "doc_id", "left").na.fill(0, ["matched", "review"])
    return counted.select("doc_id", "matched", "review", (total - F.col("matched") - F.col("review")).alias("not_found"))


def confirmed(detected: DataFrame) -> DataFrame:
    return detected.where(F.col("match_status") != "not_found")


def latest_document(documents: DataFrame) -> DataFrame:
    """Newest document per project and whether detection may start on it."""
    last = F.max_by(F.struct("id", "original_filename", "upload_status"), "id")
    return documents.groupBy("project_id").agg(last.alias("d")).select(
        "project_id", F.col("d.id").alias("document_id"), "d.original_filename", "d.upload_status",
        (F.col("d.upload_status") == "processed").alias("ready"))


def fields_by_page(fields: DataFrame) -> DataFrame:
    """Every field on its own page, else on its section's page; fields without either are dropped."""
    return fields.withColumn("page_number", F.coalesce("page_number", "section_page")).where("page_number is not null")


def sections_by_page(fields: DataFrame) -> DataFrame:
    return fields_by_page(fields).groupBy("template_id", "page_number", "section_id", "section_name").agg(
        F.count("*").cast("int").alias("field_count"))


def _is_cover():
    return F.lower(X.strip(F.coalesce("clause_ref", F.lit("")))).isin(K.COVER_REFS)


#: Pairs of field and page up to which a template's fields are looked for on each of its pages.
PAIRS = 100_000
_QUOTED = r"(?U)(?:^|[^\w.])\Q", r"\E(?:$|[^\w.])"


def _on_pages(fields: DataFrame, later: DataFrame) -> DataFrame:
    """Fields that later pages cite (rule 3) or show by label and value (rule 4): pages are dealt once, to their template's fields."""
    columns = ["section_pos", "field_pos", "field_id", "section_id"]
    sets = fields.groupBy("template_id").agg(F.collect_list(F.struct(*columns, "clause_ref", "_label", "_value")).alias("_fields"))
    df = X.let(later.join(merged(sets), "template_id"), text=X.normalize("_raw"))
    cited = lambda x: (x["clause_ref"] != "") & F.contains("_raw", x["clause_ref"]) & F.rlike(
        F.col("_raw"), F.concat(F.lit(_QUOTED[0]), x["clause_ref"], F.lit(_QUOTED[1])))
    valued = lambda x: (F.length(x["_value"]) >= 3) & (F.length(x["_label"]) >= 4) & F.contains("text", x["_label"]) & F.contains("text", x["_value"])
    shown = F.transform("_fields", lambda x: F.struct(*[x[c].alias(c) for c in columns], F.when(cited(x), 3).when(valued(x), 4).alias("rule")))
    return df.select("template_id", "page_number", F.inline(shown)).where("rule is not null")


def _on_pages_indexed(fields: DataFrame, later: DataFrame) -> DataFrame:
    """The same by equality on the runs of clause references and by the substring join: work follows shared words, not pairs."""
    key = ["template_id", "page_number"]
    later = written(later.select(*key, "_raw", X.normalize("_raw").alias("text")))  # read by every rule below
    token = r"(?U)([\w.]+)"
    runs = later.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("_raw", F.lit(token), 1))).alias("_run"))
    cited = fields.where("clause_ref <> ''").withColumn("_runs", F.regexp_extract_all("clause_ref", F.lit(token), 1)).withColumn(
        "_run", F.get("_runs", F.lit(0)))
    plain = cited.where("_run = clause_ref").join(runs, ["template_id", "_run"])
    quoted = F.concat(F.lit(_QUOTED[0]), F.col("clause_ref"), F.lit(_QUOTED[1]))
    composite = cited.where("_run is not null and _run <> clause_ref").join(runs, ["template_id", "_run"]).join(
        later.select(*key, "_raw"), key).where(F.rlike("_raw", quoted)).drop("_raw")
    symbols = cited.where("_run is null").join(later.select(*key, "_raw"), "template_id").where(F.rlike("_raw", quoted)).drop("_raw")
    r3 = plain.unionByName(composite).unionByName(symbols).drop("_run", "_runs").withColumn("rule", F.lit(3))

    valued = fields.where((F.length("_value") >= 3) & (F.length("_label") >= 4))
    texts = later.select(*key, "text")
    needles = valued.select("template_id", F.explode(F.array("_label", "_value")).alias("needle"))
    hits = substring_hits(texts, key, needles, scope=["template_id"])
    r4 = (
        valued.join(hits.withColumnRenamed("needle", "_label"), ["template_id", "_label"])
        .join(hits.withColumnRenamed("needle", "_value"), key + ["_value"], "left_semi")
        .withColumn("rule", F.lit(4))
    )
    cols = key + ["section_pos", "field_pos", "field_id", "section_id", "rule"]
    return r3.select(*cols).unionByName(r4.select(*cols))


def fields_in_html(fields: DataFrame, pages: DataFrame, entities: dict[str, str] | None = None) -> DataFrame:
    """(template_id, page_number, field columns, rule): which fields a page shows, by four rules.

    The rules are exclusive per page kind, so each is an equi-join of its own: tagged ids; cover
    references and known cover labels on page 1; clause references as whole tokens and label plus
    value on later pages. The latter meet in pairs of a template's fields and pages, or, where there are more than ``PAIRS``
    of them, by words.
    """
    key, place = ["template_id", "page_number"], ["template_id", "section_pos", "field_pos"]
    strip0 = lambda c: X.strip(F.coalesce(c, F.lit("")))
    f = fields.select(
        *place, strip0("field_id").alias("field_id"), "section_id", strip0("clause_ref").alias("clause_ref"),
        F.lower(strip0("field_label")).alias("_label"), F.lower(strip0("default_value")).alias("_value"), _is_cover().alias("_cover"))
    page = pages.select(*key, "html")
    tagged = page.select(*key, F.explode(H.tagged_ids("html")).alias("field_id"))
    on_tag = merged(f.where("field_id <> ''")).join(tagged, ["template_id", "field_id"])
    r1 = on_tag.where("page_number = 1 or not _cover").withColumn("rule", F.lit(1))

    first = page.where("page_number = 1").select(*key, H.html_plain("html", entities).alias("_plain"))
    known = reduce(lambda a, b: a | b, [F.contains("_label", F.lit(w)) for w in K.COVER_LABEL_WORDS])
    r2 = merged(f.where(F.col("_cover") | known)).join(first, "template_id").where(
        F.col("_cover") | F.contains("_plain", F.col("_label"))).drop("_plain").withColumn("rule", F.lit(2))

    later = X.let(page.where("page_number > 1").select(*key, "html"), _raw=H.unescape(H.drop_tags("html"), entities)).select(*key, "_raw")
    rest = f.where("not _cover")
    count = lambda df, name: df.groupBy("template_id").agg(F.count("*").alias(name))
    large = written(count(rest, "_n").join(merged(count(page.where("page_number > 1"), "_m")), "template_id").where(F.col("_n") * F.col("_m") > PAIRS).select("template_id"))
    if large.isEmpty():
        r34 = _on_pages(rest, later)
    else:
        few = lookup(large)
        r34 = _on_pages(rest.join(few, "template_id", "left_anti"), later.join(few, "template_id", "left_anti")).unionByName(
            _on_pages_indexed(rest.join(few, "template_id", "left_semi"), later.join(few, "template_id", "left_semi")))
    cols = key + ["section_pos", "field_pos", "field_id", "section_id", "rule"]
    untagged = r2.select(*cols).unionByName(r34.select(*cols)).join(merged(tagged), key + ["field_id"], "left_anti")
    every = r1.select(*cols).unionByName(untagged)
    # a field with an id is shown once per page, an unnamed one once per place
    unnamed = F.when(F.col("field_id") == "", F.struct("section_pos", "field_pos"))
    best = F.min_by(F.struct("section_pos", "field_pos", "section_id", "rule"), F.struct("section_pos", "field_pos", "rule"))
    return every.groupBy(*key, "field_id", unnamed.alias("_u")).agg(best.alias("b")).select(*key, "field_id", "b.*")


def sections_for(matches: DataFrame, fields: DataFrame) -> DataFrame:
    """Sections that own the matched field ids, with their number of matched fields."""
    ids = matches.where("field_id <> ''").select("template_id", "page_number", "field_id").distinct()
    return fields.select("template_id", "section_id", "section_name", "field_id").join(merged(ids), ["template_id", "field_id"]).groupBy(
        "template_id", "page_number", "section_id", "section_name").agg(F.count("*").cast("int").alias("field_count"))


def page_preview(fields: DataFrame, pages: DataFrame, entities: dict[str, str] | None = None) -> DataFrame:
    """Fields of every page: declared for it, else matched in its HTML, else read from its text."""
    key = ["template_id", "page_number"]
    ids = pages.select(*key)
    declared = fields_by_page(fields).join(ids, key, "left_semi").select(
        *key, F.lit("declared").alias("origin"), "field_id", F.col("field_label"), F.col("default_value").alias("value"))
    open_ = pages.join(declared.select(*key).distinct(), key, "left_anti")
    matched = fields_in_html(fields, open_, entities).select(*key, "section_pos", "field_pos").join(
        fields.select("template_id", "section_pos", "field_pos", "field_id", "field_label", "default_value"),
        ["template_id", "section_pos", "field_pos"]).select(
        *key, F.lit("matched").alias("origin"), "field_id", "field_label", F.col("default_value").alias("value"))
    bare = open_.join(matched.select(*key).distinct(), key, "left_anti")
    read = html_fields(bare.select(*key, "html"), entities=entities).select(
        *key, F.lit("read").alias("origin"),
        F.concat(F.lit("dynamic_page_"), F.col("page_number").cast("string"), F.lit("_"), F.col("idx").cast("string")).alias("field_id"),
        "field_label", "value")
    return declared.unionByName(matched).unionByName(read)


def overlay(pages: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Extracted values of the fields a page tags."""
    ids = pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(H.tagged_ids("html")).alias("pos", "field_id"))
    return ids.join(extracted, keys + ["field_id"])
