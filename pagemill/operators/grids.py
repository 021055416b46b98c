"""Table structure: from detected boxes to grids, cells, spans, headers and records.

Boxes meet within their table: a table is one row with arrays, made by one shuffle, and what follows is array functions
over it. Joins have the table's id as an equality key, never a nested loop over tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import cell_text
from ..schemas import DETECTION_LABELS


def parsed(detections: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Detections over the score threshold, with label and kind (row, column, header, span; null: not used).

    Label 0 (the table itself) and unknown labels take no part in the structure.
    """
    label = F.coalesce(F.get(F.array(*map(F.lit, DETECTION_LABELS)), F.col("label_id")), F.lit("unknown"))
    kind = F.when(F.col("label_id") == 1, "column").when(F.col("label_id") == 2, "row").when(F.col("label_id").isin(3, 4), "header").when(F.col("label_id") == 5, "span")
    return detections.where(F.col("score") > threshold).withColumns({"label": label, "kind": kind})


def lines(parsed_: DataFrame) -> DataFrame:
    """Rows from the top and columns from the left, numbered from 0 within their table."""
    place = F.when(F.col("kind") == "row", F.col("y")).otherwise(F.col("x"))
    n = F.row_number().over(Window.partitionBy("table_id", "kind").orderBy("place", "pos")) - 1
    return parsed_.where(F.col("kind").isin("row", "column")).withColumn("place", place).withColumn("idx", n).select("table_id", "kind", "idx", "pos", "x", "y", "w", "h")


def tables(parsed_: DataFrame) -> DataFrame:
    """One row per table, by one shuffle: its rows from the top, its columns from the left and its spans in order, as
    arrays, with n_rows, n_cols, n_headers, has_spans and structure_confidence (mean score of what is used, 0.5 without
    any). A table is one image's, so its boxes are few by nature."""
    of = lambda kind, *cols: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*cols))))
    t = parsed_.groupBy("table_id").agg(
        of("row", "y", "pos", "h").alias("rows"), of("column", "x", "pos", "w").alias("cols"), of("span", "pos", "x", "y", "w", "h", "score").alias("spans"),
        F.count_if(F.col("kind") == "header").alias("n_headers"), F.coalesce(F.avg(F.when(F.col("kind").isNotNull(), F.col("score"))), F.lit(0.5)).alias("structure_confidence"),
    )
    n = lambda c: F.size(c).cast("long")
    return t.withColumns({"n_rows": n("rows"), "n_cols": n("cols"), "has_spans": F.size("spans") > 0})


def grid(parsed_: DataFrame) -> DataFrame:
    """One row per table: counts, has_spans, structure_confidence."""
    return tables(parsed_).drop("rows", "cols", "spans")


def _record(t: DataFrame) -> DataFrame:
    return t.withColumns({"n_rows": F.greatest("n_rows", F.lit(1)), "n_cols": F.greatest("n_cols", F.lit(1))})


def records(parsed_: DataFrame) -> DataFrame:
    """Structure records: at least one row and column each."""
    return _record(grid(parsed_)).select("table_id", F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols"), "n_headers", "has_spans", "structure_confidence")


def _exploded(t: DataFrame, *more: str) -> DataFrame:
    """Every row with every column of its table; rows 0 and 1 are header rows in a table with a detected header."""
    r = t.select("table_id", "cols", "n_headers", *more, F.posexplode("rows").alias("row", "r"))
    c = r.select("table_id", "n_headers", *more, "row", "r", F.posexplode("cols").alias("col", "c"))
    kind = F.when((F.col("n_headers") > 0) & (F.col("row") <= 1), "header").otherwise("data")
    return c.select("table_id", *more, "row", "col", F.col("c.x").alias("x"), F.col("r.y").alias("y"), F.col("c.w").alias("w"), F.col("r.h").alias("h"), kind.alias("cell_type"), F.lit(0.8).alias("confidence"))


def cells(parsed_: DataFrame) -> DataFrame:
    """A table's cells: position, box, type, confidence 0.8."""
    return _exploded(tables(parsed_))


def _spanned(t: DataFrame) -> DataFrame:
    """The cells of tables() under their spans.

    A cell's box is its column's by its row's, so what a span covers is the rows that it meets by the columns that it
    meets: its first cell and its extent follow from the two lists, without a join.
    """
    met = lambda lines, a, s, z: F.filter(F.transform(lines, lambda x, i: F.when(~((z[a] + z[s] <= x[a]) | (x[a] + x[s] <= z[a])), i)), lambda i: i.isNotNull())
    lists = F.transform("spans", lambda z: F.struct(z["pos"].alias("pos"), z["score"].alias("score"), met(F.col("rows"), "y", "h", z).alias("rs"), met(F.col("cols"), "x", "w", z).alias("cs")))
    e = _exploded(t.withColumn("hits", F.filter(lists, lambda z: (F.size(z["rs"]) > 0) & (F.size(z["cs"]) > 0))), "hits")
    e = e.withColumn("own", F.filter("hits", lambda z: F.array_contains(z["rs"], F.col("row")) & F.array_contains(z["cs"], F.col("col"))))
    is_main = lambda z: (F.array_min(z["rs"]) == F.col("row")) & (F.array_min(z["cs"]) == F.col("col"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    e = e.withColumns({"last": last(F.col("own")), "main": last(F.filter("own", is_main)), "part": last(F.filter("own", lambda z: ~is_main(z)))})
    extent = lambda c: F.coalesce(F.array_max(F.col(f"main.{c}")) - F.array_min(F.col(f"main.{c}")) + 1, F.lit(1))
    kind = F.when(F.col("last").isNull(), F.col("cell_type")).when(is_main(F.col("last")), "merged").otherwise("empty")
    return e.select(
        "table_id", "row", "col", extent("rs").alias("rowspan"), extent("cs").alias("colspan"), kind.alias("cell_type"), F.coalesce("main.score", "confidence").alias("confidence"),
        F.when(F.col("part").isNotNull(), F.struct(F.array_min("part.rs").alias("row"), F.array_min("part.cs").alias("col"))).alias("span_main"),
    )


def spanned(parsed_: DataFrame) -> DataFrame:
    """cells() after the table's spanning cells, applied in order: rowspan, colspan, cell_type, confidence, span_main.

    The first cell that a span covers (by row, then column) becomes merged and takes the span's extent and score; the
    other ones become empty and name it (span_main: row, col). Of several spans the last one decides each of these.
    """
    return _spanned(tables(parsed_))


def summary(parsed_: DataFrame) -> DataFrame:
    """One row per table: dimensions, cells, header and merged cells, confidence, multi-level headers."""
    t = tables(parsed_)
    per = _spanned(t).groupBy("table_id").agg(F.count(F.lit(1)).alias("total_cells"), F.count_if(F.col("cell_type") == "header").alias("header_cells"), F.count_if(F.col("cell_type") == "merged").alias("merged_cells"))
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    size = F.concat_ws("x", F.col("n_rows").cast("string"), F.col("n_cols").cast("string"))
    return _record(t.drop("rows", "cols", "spans")).join(per, "table_id", "left").select("table_id", size.alias("dimensions"), n("total_cells"), n("header_cells"), n("merged_cells"), "structure_confidence", (F.col("n_headers") > 0).alias("has_multi_level_headers"))


def headers(parsed_: DataFrame) -> DataFrame:
    """Header boxes with their level (dense rank of the rounded tenth of y), text and the tenths that they reach over."""
    h = parsed_.where("kind = 'header'").withColumn("level_key", F.bround(F.col("y") * 10, 0))
    level = F.dense_rank().over(Window.partitionBy("table_id").orderBy("level_key")) - 1
    return h.withColumn("level", level).select("table_id", "pos", "level", F.concat(F.lit("Header_L"), F.col("level").cast("string")).alias("text"), G.tenths(F.col("x"), F.col("w")).alias("columns"))


def placeholder_headers(parsed_: DataFrame) -> DataFrame:
    """(table_id, col, header): Column_1 to Column_n for a table's n columns."""
    n = grid(parsed_).where("n_cols > 0")
    return n.select("table_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n_cols").cast("int")), lambda i: F.format_string("Column_%d", i))).alias("col", "header"))


def overall(records_: DataFrame) -> DataFrame:
    """Statistics over structure records: one row; the largest table is the one with the smallest id on a tie."""
    size = F.col("rows") * F.col("cols")
    top = F.max_by(F.struct("table_id", "rows", "cols"), F.struct(size, -F.col("table_id")))
    return records_.agg(
        F.count(F.lit(1)).alias("tables"), F.sum(size).alias("total_cells"), F.avg("structure_confidence").alias("avg_confidence"), F.count_if(F.col("n_headers") > 0).alias("with_headers"),
        F.count_if("has_spans").alias("with_merged"), top.alias("t"),
    ).select("tables", "total_cells", "avg_confidence", "with_headers", "with_merged", F.col("t.table_id").alias("largest_id"), F.concat_ws("x", F.col("t.rows").cast("string"), F.col("t.cols").cast("string")).alias("largest"))


# Cell lists: (table_id, row, col, text, rowspan, colspan)


def coordinates(cells_: DataFrame) -> DataFrame:
    return cells_.select("table_id", "row", "col", cell_text(F.col("text")).alias("text"))


def filled(cells_: DataFrame) -> DataFrame:
    """Each cell at every position that its spans cover; where cells meet, the later one (by row, then column) stays."""
    at = cells_.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    last = at.groupBy("table_id", "r", "c").agg(F.max(F.struct("row", "col", "text")).alias("v"))
    return last.select("table_id", F.col("r").alias("row"), F.col("c").alias("col"), F.col("v.text").alias("text"))


def _filled_tables(cells_: DataFrame) -> DataFrame:
    """One row per table, by one shuffle: width, and its filled positions in order as structs r, c, text. A table is one
    image's, so its cells are few by nature."""
    t = cells_.groupBy("table_id").agg(F.collect_list(F.struct("row", "col", "text", "rowspan", "colspan")).alias("cells"), F.max(F.col("col") + F.col("colspan")).alias("width"))
    span = lambda x, at, n: F.sequence(x[at], x[at] + x[n] - 1)
    place = lambda x, r, c: F.struct(r.alias("r"), c.alias("c"), x["row"].alias("row"), x["col"].alias("col"), x["text"].alias("text"))
    every = F.flatten(F.transform("cells", lambda x: F.flatten(F.transform(span(x, "row", "rowspan"), lambda r: F.transform(span(x, "col", "colspan"), lambda c: place(x, r, c))))))
    t = t.select("table_id", "width", F.array_sort(every).alias("g"))
    after = lambda i: F.get(F.col("g"), i + 1)
    last = F.filter("g", lambda x, i: F.coalesce((after(i)["r"] != x["r"]) | (after(i)["c"] != x["c"]), F.lit(True)))
    return t.select("table_id", "width", F.transform(last, lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c"), x["text"].alias("text"))).alias("g"))


def structured(cells_: DataFrame) -> DataFrame:
    """(table_id, row, values): the first row with any text gives the keys; every later row with text is a map.

    A position without text is the empty string; of equal keys the last column's value stays. The grid's extent is that
    of its spans. Tables meet once: what follows the shuffle by table needs no other.
    """
    t = _filled_tables(cells_)
    t = t.withColumn("head", F.array_min(F.transform(F.filter("g", lambda x: x["text"].isNotNull()), lambda x: x["r"])))
    own = F.map_from_entries(F.transform(F.filter("g", lambda x: x["r"] == F.col("head")), lambda x: F.struct(x["c"], x["text"])))
    texts = lambda held: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at(held, i), F.lit("")))
    t = t.where("head is not null").withColumn("held", own).withColumn("keys", texts(F.col("held")))
    x = t.select("table_id", "width", "keys", F.explode(F.filter("g", lambda x: x["r"] > F.col("head"))).alias("x"))
    body = x.groupBy("table_id", F.col("x.r").alias("row")).agg(F.count("x.text").alias("n"), F.map_from_entries(F.collect_list(F.struct("x.c", "x.text"))).alias("held"), F.first("width").alias("width"), F.first("keys").alias("keys"))
    body = body.where("n > 0").withColumn("texts", texts(F.col("held")))
    pairs = F.arrays_zip(F.col("keys"), F.col("texts"))
    # the last of equal keys: those not seen again to the right
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["keys"].alias("k"), p["texts"].alias("v"), F.slice("keys", i + 2, F.size("keys")).alias("rest"))), lambda p: ~F.array_contains(p["rest"], p["k"]))
    return body.select("table_id", "row", F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"])).alias("values"))


def header_rows(cells_: DataFrame) -> DataFrame:
    """(table_id, header_row): the first row with any text."""
    return filled(cells_).where("text is not null").groupBy("table_id").agg(F.min("row").alias("header_row"))


def with_headers(cells_: DataFrame) -> DataFrame:
    """Body cells with the header of their column (row 0) and of their row (column 0)."""
    body = cells_.where("row > 0 and col > 0").select("table_id", "row", "col", "text")
    top = cells_.where("row = 0").select("table_id", "col", F.col("text").alias("column_header"))
    side = cells_.where("row > 0 and col = 0").select("table_id", "row", F.col("text").alias("row_header"))
    return body.join(top, ["table_id", "col"], "left").join(side, ["table_id", "row"], "left")


def marked(cells_: DataFrame, mark: str = "●") -> DataFrame:
    """Compatibility matrix: the header pairs at whose crossing the mark stands."""
    return with_headers(cells_).where(F.col("text") == mark).select("table_id", "row", "row_header", "column_header")


def options(cells_: DataFrame, mark: str = "●") -> DataFrame:
    """Option tables: per row the marked column's header as value, and all option columns' headers as notes."""
    lot = with_headers(cells_)
    return lot.groupBy("table_id", "row").agg(F.min_by("column_header", "col").alias("first"), F.min(F.when(F.col("text") == mark, F.struct("col", "column_header"))).alias("hit"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "column_header"))), lambda s: s["column_header"]), "; ").alias("notes")).select("table_id", "row", F.col("hit.column_header").alias("value"), "notes")


def section_titles(cells_: DataFrame) -> DataFrame:
    """Rows with text in column 0 and in no other."""
    t = F.coalesce(F.trim("text"), F.lit("")) != ""
    return cells_.groupBy("table_id", "row").agg(F.bool_or(t & (F.col("col") == 0)).alias("first"), F.count_if(t & (F.col("col") > 0)).alias("others"), F.min_by("text", "col").alias("title")).where("first and others = 0").select("table_id", "row", "title")


def raw_spans(detected: DataFrame) -> DataFrame:
    """Cells given by first and last row and column (row_start, row_end, col_start, col_end) -> row, col, spans.

    Deviation: the extents are read where the recogniser nests them, and boxes keep x, y, width, height.
    """
    return detected.withColumns({"row": F.col("row_start"), "col": F.col("col_start"), "rowspan": F.col("row_end") - F.col("row_start") + 1, "colspan": F.col("col_end") - F.col("col_start") + 1}).drop("row_start", "row_end", "col_start", "col_end")


def nearest_lines(boxes: DataFrame, lines_: DataFrame) -> DataFrame:
    """(table_id, pos, row, col): the grid row and column whose centre is nearest to a box's; the first on a tie."""
    b = boxes.select("table_id", "pos", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    j = b.join(lines_.select("table_id", "kind", "idx", (F.col("x") + F.col("w") / 2).alias("lx"), (F.col("y") + F.col("h") / 2).alias("ly")), "table_id")
    near = lambda kind, d: F.min(F.when(F.col("kind") == kind, F.struct(d.alias("d"), F.col("idx"))))["idx"]
    return j.groupBy("table_id", "pos").agg(near("row", F.abs(F.col("cy") - F.col("ly"))).alias("row"), near("column", F.abs(F.col("cx") - F.col("lx"))).alias("col"))
