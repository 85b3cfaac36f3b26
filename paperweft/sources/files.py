"""Reading: template files, incoming documents, pages; change detection; schema migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed as K


def read_template_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, modified) of every ``<folder>/*/schema.json``."""
    return spark.read.text(f"{folder}/*/schema.json", wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))


def parse_templates(files: DataFrame) -> DataFrame:
    """Catalogue rows of template files (path, content).

    Files that are no JSON object or lack a text ``template_id`` are skipped; of several files with
    one id the first directory in order wins. The schema is kept as a map of key to JSON text.
    """
    df = files.withColumn("_v", F.try_parse_json("content"))
    kind = F.schema_of_variant(F.try_variant_get("_v", "$.template_id", "variant"))
    df = df.where(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")) & (kind == "STRING"))
    text = lambda k: F.try_variant_get("_v", f"$.{k}", "string")
    flag = lambda k, d: F.coalesce(F.try_variant_get("_v", f"$.{k}", "boolean"), F.lit(d))
    filled = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), d)
    df = df.withColumn("template_id", text("template_id")).where("template_id <> ''")
    row = F.struct(
        F.col("path"), filled(text("version"), F.lit("1.0")).alias("version"), filled(text("template_name"), F.col("template_id")).alias("template_name"),
        text("description").alias("description"), text("specification_number").alias("specification_number"),
        filled(text("file_name"), F.lit("")).alias("file_name"), flag("is_active", True).alias("is_active"), flag("structure_locked", False).alias("structure_locked"),
        F.from_json("content", "map<string,string>").alias("schema"))
    first = df.groupBy("template_id").agg(F.min_by(row, "path").alias("r"))
    return first.select("template_id", "r.*")


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    return parse_templates(read_template_files(spark, folder))


def read_incoming(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of incoming files; contents are never read. Files without a byte are not seen."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def intake(files: DataFrame) -> DataFrame:
    """Files with file_type, upload_status and, for refused ones, ``reject_reason``."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1))
    reason = F.when(~ext.isin(K.ALLOWED_EXTENSIONS), "Unsupported file type").when(F.col("size") > K.MAX_UPLOAD_BYTES, "File too large")
    return files.withColumns({"original_filename": name, "file_type": ext, "reject_reason": reason}).withColumn(
        "upload_status", F.when(F.col("reject_reason").isNull(), "uploaded"))


def pages_of(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Existing pages 1..page_count of every document, with has_image and total_pages."""
    d = documents.select(F.col("id").alias("document_id"), F.coalesce("page_count", F.lit(0)).alias("total_pages"))
    return pages.join(d, "document_id").where((F.col("page_number") >= 1) & (F.col("page_number") <= F.col("total_pages"))).select(
        "document_id", "page_number", "text", (F.coalesce("image_path", F.lit("")) != "").alias("has_image"), "total_pages")


def static_urls(paths: DataFrame, base: str, path: str = "path") -> DataFrame:
    """Served URL of files under ``base``; others are dropped."""
    root = base.rstrip("/") + "/"
    return paths.where(F.startswith(F.col(path), F.lit(root))).withColumn(
        "url", F.concat(F.lit("/static/"), F.substring(F.col(path), len(root) + 1, 2147483647)))


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """New, modified and vanished template directories; both sides: directory, modified."""
    j = files.select("directory", F.col("modified").alias("_n")).join(seen.select("directory", F.col("modified").alias("_o")), "directory", "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_n") != F.col("_o"), "modified")
    return j.select("directory", change.alias("change")).where("change is not null")


def migrate(df: DataFrame, columns: dict[str, tuple[str, object]], backfill: dict[str, str] | None = None) -> DataFrame:
    """Add missing columns: ``columns`` maps name to (type, default), ``backfill`` name to source column."""
    backfill = backfill or {}
    new = {
        name: (F.coalesce(F.col(backfill[name]).cast(kind), F.lit(default).cast(kind)) if name in backfill else F.lit(default).cast(kind))
        for name, (kind, default) in columns.items() if name not in df.columns}
    return df.withColumns(new) if new else df
