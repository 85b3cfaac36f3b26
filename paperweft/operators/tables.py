"""Table numbering and cell geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as K, text as X
from .cut import cut, merged
from .prefix import running


def number_tables(blocks: DataFrame) -> DataFrame:
    """Table blocks with their zero-based position among the document's tables."""
    t = blocks.where(F.col("block_type") == "table")
    t = running(t, ["doc_id"], "block_seq", {"_n": ("sum", F.lit(1))})
    return t.withColumn("table_index", (F.col("_n") - 1).cast("int")).drop("_n")


TABLE = ["doc_id", "table_index"]


def _grid_column(cells: DataFrame) -> DataFrame:
    """Add ``col``: columns spanned by the cells to the left. A row's width bounds the window."""
    left = Window.partitionBy(*TABLE, "row_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    span = F.greatest(F.coalesce("colspan", F.lit(1)), F.lit(1))
    return cells.withColumn("col", F.coalesce(F.sum(span).over(left), F.lit(0)).cast("int"))


def merge_vertical(cells: DataFrame) -> DataFrame:
    """Drop continuation cells of vertical merges; their count goes to the opening cell's rowspan.

    Windows run over one column of one table.
    """
    down = Window.partitionBy(*TABLE, "col").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.coalesce(F.col("vmerge") != "restart", F.lit(False))
    df = _grid_column(cells).withColumn("_on", on).withColumns({
        "_owner": F.last(F.when(~F.col("_on"), F.col("row_no")), ignorenulls=True).over(down),
        "_open": F.last(F.when(~F.col("_on"), F.col("vmerge").isNotNull()), ignorenulls=True).over(down)})
    more = F.count_if(F.col("_on") & F.col("_open")).over(Window.partitionBy(*TABLE, "col", "_owner"))
    return df.withColumn("rowspan", (1 + more).cast("int")).where("not _on").drop("_on", "_owner", "_open")


def table_structure(cells: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Cells with grid column, spans, width share and, if they hold ``label: value``, a field id.

    ``grid``: doc_id, table_index, col, width.
    """
    df = X.with_candidate(merge_vertical(cells), "text", "_c")
    strong = F.col("_c").isNotNull() & (F.col("_c.kind") != "label")
    fid = F.when(strong, cell_field_id(F.col("_c.label"), F.col("table_index"), F.col("row_no"), F.col("col")))
    df = df.withColumn("field_id", fid).withColumn("is_editable", strong)
    width = F.lit(None).cast("double")
    if grid is not None:
        shares = grid.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("col", "width"))).alias("g"), F.sum("width").alias("t"))
        total = F.when(F.col("t") > 0, F.col("t")).otherwise(1)
        shares = shares.select(*TABLE, F.transform("g.width", lambda w: w / total * 100).alias("_w"))
        df = df.join(shares.hint("merge"), TABLE, "left")  # a row a table: too many for a broadcast, however small the files
        covered = F.aggregate(F.slice("_w", F.col("col") + 1, F.col("colspan")), F.lit(0.0), lambda a, x: a + x)
        width = F.when(F.col("col") < F.size("_w"), F.round(covered, 2))
    return df.select(*TABLE, "row_no", "pos", "col", "rowspan", "colspan", "text", width.alias("width_pct"), "is_editable", "field_id")


def collapse_merges(cells: DataFrame) -> DataFrame:
    """Join empty cells under a hidden border to the cell above (after vertical merges)."""
    df = _grid_column(merge_vertical(cells).drop("col")).withColumn("_one", F.col("colspan") == 1)
    column = Window.partitionBy(*TABLE, "col", "_one").orderBy("row_no")
    above = F.lag(F.coalesce("border_bottom", F.lit(""))).over(column)
    gone = F.col("_one") & (F.col("text") == "") & (F.coalesce("border_top", F.lit("")) == "none") & (F.coalesce("_above", F.lit("")) == "none")
    df = df.withColumn("_above", above).withColumn("_gone", gone)
    upto = column.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_anchor", F.last(F.when(~F.col("_gone"), F.col("row_no")), ignorenulls=True).over(upto))
    more = F.count_if("_gone").over(Window.partitionBy(*TABLE, "col", "_one", "_anchor"))
    return df.withColumn("rowspan", (F.col("rowspan") + more).cast("int")).where("not _gone").drop("_one", "_above", "_gone", "_anchor")


def cell_field_id(label: Column, table: Column, row: Column, cell: Column) -> Column:
    n = lambda c: (c + 1).cast("string")
    return F.concat(X.slug(label), F.lit("_table_"), n(table), F.lit("_row_"), n(row), F.lit("_cell_"), n(cell))


def table_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_no, cells): cell texts of every row in order."""
    return cells.groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c")).select(
        *TABLE, "row_no", F.col("c.text").alias("cells"))


def table_fields(cells: DataFrame) -> DataFrame:
    """Fields read row by row: ``label: value`` cells, else (label, value) pairs, else a reversed pair.

    A row is one array, so the first two rules need no shuffle beyond the one that builds the rows.
    The reversed rule holds for one row per table at most: the first such row above every row that
    yields a field. Two minima per table decide it.
    """
    rows = table_rows(cells).where(F.exists("cells", lambda c: c != ""))
    one = lambda i, label, value: F.struct(i.cast("int").alias("cell_index"), label.alias("label"), value.alias("value"))

    def embedded(c, i):
        return X.within(X.candidate_field(c), lambda m: X.within(X.normalize_label(m["label"]), lambda label: F.when(
            m.isNotNull() & (label != ""), one(i, label, m["value"]))))

    def paired(i):
        return X.within(X.normalize_label(F.get("cells", i)), lambda label: F.when(
            (label != "") & X.is_table_label(label), one(i, label, X.strip(F.get("cells", i + 1)))))

    rows = X.let(rows, _e=F.filter(F.transform("cells", embedded), lambda m: m.isNotNull()))
    starts = F.when(F.size("cells") > 1, F.sequence(F.lit(0), F.size("cells") - 2, F.lit(2)))
    pairs = F.coalesce(F.filter(F.transform(starts, paired), lambda m: m.isNotNull()), F.array().cast("array<struct<cell_index:int,label:string,value:string>>"))
    rows = X.let(rows, _p=F.when(F.size("_e") > 0, F.col("_e")).otherwise(pairs))
    last = X.normalize_label(F.get("cells", F.lit(1)))
    rows = X.let(rows, _r=F.when((F.size("_p") == 0) & (F.size("cells") == 2) & (last != "") & X.is_table_label(last), last))
    decided = rows.groupBy(*TABLE).agg(
        F.min(F.when(F.size("_p") > 0, F.col("row_no"))).alias("_found"), F.min(F.when(F.col("_r").isNotNull(), F.col("row_no"))).alias("_turned"))
    normal = rows.select(*TABLE, "row_no", F.inline("_p"))
    turned = decided.where("_turned is not null and (_found is null or _turned < _found)").select(*TABLE, F.col("_turned").alias("row_no")).join(
        rows, [*TABLE, "row_no"]).select(*TABLE, "row_no", F.lit(1).alias("cell_index"), F.col("_r").alias("label"), F.get("cells", F.lit(0)).alias("value"))
    fields = normal.unionByName(turned)
    return fields.withColumn("field_id", cell_field_id(F.col("label"), F.col("table_index"), F.col("row_no"), F.col("cell_index")))


def _label_like(text: Column) -> Column:
    return (
        (text != "") & (F.length(text) <= 60) & (X.word_count(X.squeeze(text)) <= K.LABEL_MAX_WORDS)
        & ~F.lower(text).isin(K.STOPWORD_LABELS) & X.is_label(text)
    )


def form_cells(cells: DataFrame) -> DataFrame:
    """(doc_id, table_index, phase, row_no, cell_no, label, value): fields of form-like tables.

    Phases in registration order: 0 cells that hold label and value; 1 a cell that ends in a label,
    valued by its right neighbour; 2 a row left with one label and one value; 3 tables under a
    header row, one field per data cell. Works on collapsed cells (``collapse_merges``). A cell
    takes part once: a row's cells are one array and carry their state through the phases.
    """
    rows = collapse_merges(cells).groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c")).select(
        *TABLE, "row_no", F.col("c.text").alias("_t"))
    described = F.transform("_t", lambda t: X.within(X.candidate_field(t), lambda m: F.struct(
        t.alias("text"), m["label"].alias("label"),
        F.when(m["kind"] != "label", F.nullif(m["value"], F.lit(""))).alias("value"),
        F.coalesce((m["kind"] != "label") & (m["value"] == ""), F.lit(False)).alias("pending"))))
    rows = X.let(rows, _m=described)
    # phase 1: left to right; `open` = the previous cell is a pending label nobody has used
    step = lambda acc, x: F.struct(
        F.array_append(acc["took"], acc["open"] & x["value"].isNull() & (x["text"] != "")).alias("took"),
        (~(acc["open"] & x["value"].isNull() & (x["text"] != "")) & x["value"].isNull() & x["pending"]).alias("open"))
    start = F.struct(F.array().cast("array<boolean>").alias("took"), F.lit(False).alias("open"))
    rows = X.let(rows, _took=F.aggregate("_m", start, step)["took"])
    used = F.transform("_m", lambda x, i: x["value"].isNotNull() | F.get("_took", i) | F.coalesce(F.get("_took", i + 1), F.lit(False)))
    rows = X.let(rows, _used=used)
    free = F.filter(F.transform("_m", lambda x, i: F.struct(
        i.alias("i"), x["text"].alias("text"), F.coalesce(x["label"], x["text"]).alias("label"), F.get("_used", i).alias("used"))), lambda x: ~x["used"])
    rows = X.let(rows, _free=free)
    rows = X.let(rows, _full=F.filter("_free", lambda x: x["text"] != ""))
    pair = F.when(F.size("_full") == 2, F.col("_full")).when((F.size("_free") == 2) & (F.size("_full") == 1), F.col("_free"))
    rows = X.let(rows, _pair=pair)
    rows = X.let(rows, _a=F.get("_pair", F.lit(0)), _b=F.get("_pair", F.lit(1)))
    rows = X.let(rows, _la=_label_like(F.col("_a.text")), _lb=_label_like(F.col("_b.text")))
    swap = ~F.col("_la") & F.col("_lb")
    rows = X.let(rows, _l=F.when(swap, F.col("_b")).otherwise(F.col("_a")), _v=F.when(swap, F.col("_a")).otherwise(F.col("_b")))
    paired = F.col("_pair").isNotNull() & (F.col("_la") | F.col("_lb")) & ~X.is_code("_l.text")
    rows = X.let(rows, _second=F.when(paired, F.struct(F.col("_v.i").alias("cell_no"), F.col("_l.label").alias("label"), F.col("_v.text").alias("value"))))
    rows = rows.select(*TABLE, "row_no", "_t", "_m", "_took", "_second",
                       F.transform("_used", lambda u, i: u | F.coalesce(i == F.col("_second.cell_no"), F.lit(False))).alias("_used"))

    rows = cut(rows)
    cell = lambda phase, i, label, value: F.struct(
        F.lit(phase).alias("phase"), i.cast("int").alias("cell_no"), label.alias("label"), value.alias("value"))
    keep = lambda a: F.filter(a, lambda x: x.isNotNull())
    zero = keep(F.transform("_m", lambda x, i: F.when(x["value"].isNotNull(), cell(0, i, x["label"], x["value"]))))
    one = keep(F.transform("_m", lambda x, i: F.when(F.get("_took", i), cell(1, i, F.get("_m", i - 1)["label"], x["text"]))))
    two = keep(F.array(F.when(F.col("_second").isNotNull(), cell(2, F.col("_second.cell_no"), F.col("_second.label"), F.col("_second.value")))))

    # phase 3: tables under a header row
    full = F.filter("_t", lambda x: x != "")
    is_header = (
        (F.size(full) >= 3)
        & F.forall(full, lambda x: (F.length(x) <= 24) & (X.word_count(X.squeeze(x)) <= 4) & ~X.is_code(x))
        & F.forall("_m", lambda x: ~F.contains(x["text"], F.lit(":")) & ~(x["value"].isNull() & x["pending"]))
    )
    heads = rows.where("row_no = 0").where(is_header).select(*TABLE, F.col("_t").alias("_h"))
    rows = rows.join(merged(heads), TABLE, "left")
    named = keep(F.transform("_t", lambda x, i: F.when(
        (F.col("row_no") > 0) & ~F.get("_used", i) & (F.coalesce(F.get("_h", i), F.lit("")) != ""),
        cell(3, i, F.concat(F.get("_h", i), F.lit(" (row "), F.col("row_no").cast("string"), F.lit(")")), x))))
    return rows.select(*TABLE, "row_no", F.inline(F.concat(zero, one, two, named)))


def header_fields(cells: DataFrame) -> DataFrame:
    return form_cells(cells).where("phase = 3").drop("phase")


def pair_cells(cells: DataFrame) -> DataFrame:
    return form_cells(cells).where("phase in (1, 2)")
