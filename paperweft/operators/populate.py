"""Filling values into template text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def replaceable(fields: DataFrame) -> DataFrame:
    """Dynamic fields, and static ones with a default."""
    return fields.where("coalesce(is_dynamic, false) or default_value is not null").where("coalesce(field_id, '') <> ''")


def value_lists(values: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, values: array<struct<field_id, label, value>>) in schema order; one list per template instance."""
    item = F.struct("field_id", F.col("field_label").alias("label"), F.coalesce("value", F.lit("")).alias("value"))
    return values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("v")))).alias("b")).select(*keys, F.col("b.v").alias("values"))


def fill(text: Column, values: Column, labels: bool = True) -> Column:
    """``struct<text, ops>`` after replacing, per field in order, ``{{id}}``, ``{id}``, ``[id]`` and
    then (``labels``) what follows ``label:`` up to the line end. Later fields see earlier results."""

    def op(field: Column, pattern: Column) -> Column:
        return F.struct(field.alias("field_id"), pattern.alias("pattern"))

    def token(acc: Column, v: Column, pattern: Column) -> Column:
        hit = F.contains(acc["text"], pattern)
        return F.struct(
            F.when(hit, F.replace(acc["text"], pattern, v["value"])).otherwise(acc["text"]).alias("text"),
            F.when(hit, F.array_append(acc["ops"], op(v["field_id"], pattern))).otherwise(acc["ops"]).alias("ops"))

    def labelled(acc: Column, v: Column) -> Column:
        pattern = F.concat(v["label"], F.lit(":"))
        at = F.position(pattern, acc["text"])
        stop = at + F.length(pattern)
        after = F.substring(acc["text"], stop, F.length(acc["text"]))
        newline = F.position(F.lit("\n"), after)
        trailing = F.when(newline > 0, F.substring(after, newline, F.length(after))).otherwise("")
        hit = at > 0
        return F.struct(
            F.when(hit, F.concat(F.left(acc["text"], stop - 1), F.lit(" "), v["value"], trailing)).otherwise(acc["text"]).alias("text"),
            F.when(hit, F.array_append(acc["ops"], op(v["field_id"], pattern))).otherwise(acc["ops"]).alias("ops"))

    # one fold step per (field, rule), so that no step's result is copied into the next expression
    rules = [0, 1, 2, 3] if labels else [0, 1, 2]
    steps = F.flatten(F.transform(values, lambda v: F.array(*[F.struct(v.alias("v"), F.lit(r).alias("r")) for r in rules])))
    pattern = lambda s: F.when(s["r"] == 0, F.concat(F.lit("{{"), s["v"]["field_id"], F.lit("}}"))).when(
        s["r"] == 1, F.concat(F.lit("{"), s["v"]["field_id"], F.lit("}"))).otherwise(F.concat(F.lit("["), s["v"]["field_id"], F.lit("]")))
    start = F.struct(text.alias("text"), F.array().cast("array<struct<field_id:string,pattern:string>>").alias("ops"))
    return F.aggregate(steps, start, lambda acc, s: F.when(s["r"] == 3, labelled(acc, s["v"])).otherwise(token(acc, s["v"], pattern(s))))


def populate(blocks: DataFrame, lists: DataFrame, keys: list[str], labels: bool = True) -> DataFrame:
    """Blocks with replaced ``text`` and the list of ``ops`` done on them."""
    df = blocks.join(lists, keys, "left")
    filled = F.when(F.col("values").isNotNull(), fill(F.col("text"), F.col("values"), labels))
    return df.withColumn("_f", filled).withColumns({
        "text": F.coalesce("_f.text", "text"), "ops": F.coalesce("_f.ops", F.array())}).drop("_f", "values")


def unfilled_fields(wanted: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field_id) of the replaceable fields ``wanted`` that have no value row in ``values``."""
    return wanted.select(*keys, "field_id").join(values.select(*keys, "field_id").distinct(), [*keys, "field_id"], "left_anti")


def population_report(populated: DataFrame, wanted: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fields_processed, replacements_made, fields_unfilled, unfilled): the names of the fields without a value are joined in order."""
    done = populated.groupBy(*keys).agg(F.sum(F.size("ops")).alias("replacements_made"))
    missing = unfilled_fields(wanted, values, keys).groupBy(*keys).agg(
        F.count("*").alias("fields_unfilled"), F.array_join(F.sort_array(F.collect_list("field_id")), ",").alias("unfilled"))
    total = wanted.groupBy(*keys).agg(F.count("*").alias("fields_processed"))
    return total.join(done, keys, "left").join(missing, keys, "left").select(
        *keys, "fields_processed", F.coalesce("replacements_made", F.lit(0)).alias("replacements_made"), F.coalesce("fields_unfilled", F.lit(0)).alias("fields_unfilled"),
        F.coalesce("unfilled", F.lit("")).alias("unfilled"))


def export_route(report: DataFrame, integrity: DataFrame, keys: list[str]) -> DataFrame:
    """``template`` where the document was populated and kept its structure, else ``flat``."""
    return report.join(integrity, keys, "left").select(
        *keys, F.when(F.coalesce("populated", F.lit(False)) & F.coalesce("is_valid", F.lit(False)), "template").otherwise("flat").alias("route"))
