"""Page regions and summaries over pages, tables and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import stripped, word_count
from ..schemas import TEXT_REGIONS

BINS = 5


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with errors, the names of the rules that a row breaks (a rule that gives null is broken)."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])))


def model_rules(df: DataFrame) -> dict[str, Column]:
    """The value constraints of the model, for those of its columns that df has."""
    c = F.col
    every = {
        "confidence": lambda: c("confidence").between(0, 1), "page_number": lambda: c("page_number") >= 1, "row": lambda: c("row") >= 0, "col": lambda: c("col") >= 0,
        "rowspan": lambda: c("rowspan") >= 1, "colspan": lambda: c("colspan") >= 1, "priority": lambda: c("priority").between(1, 5), "weight": lambda: c("weight") >= 0,
        "width": lambda: c("width") > 0, "height": lambda: c("height") > 0,
    }
    return {k: f() for k, f in every.items() if k in df.columns}


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with their errors."""
    out = checked(df, rules)
    return out.where(F.size("errors") == 0).drop("errors"), out.where(F.size("errors") > 0)


def survivors(boxes: DataFrame, *keys: str) -> DataFrame:
    """Per key the number of boxes, and of those that are strictly valid."""
    ok = G.valid(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"), F.count_if(G.inside(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).alias("n_inside"))


def text_regions(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("region_type").isin(*TEXT_REGIONS))


def by_type(regions: DataFrame) -> DataFrame:
    """Count and mean confidence per type, and over all (type `all`)."""
    r = regions.rollup("region_type").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.grouping("region_type").alias("g"))
    return r.select(F.when(F.col("g") == 1, "all").otherwise(F.col("region_type")).alias("region_type"), "n", "avg_confidence")


def confidence_histogram(regions: DataFrame) -> DataFrame:
    """Counts in five equal bins of [0, 1]; 1.0 counts in the last; empty bins stay."""
    n = regions.select(F.least(F.floor(F.col("confidence") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = regions.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def document_summary(pages: DataFrame) -> DataFrame:
    """One row per document from pages (doc_id, n_regions, n_tables, n_ok): sums, and successes over tables (at least 1)."""
    s = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_regions").alias("regions"), F.sum("n_tables").alias("tables"), F.sum("n_ok").alias("ok_tables"))
    return s.withColumn("success_rate", F.col("ok_tables") / F.greatest("tables", F.lit(1)))


def table_summary(tables: DataFrame) -> DataFrame:
    """Over tables (page_number, rows, cols, confidence, error): counts by status, mean confidence of the successful ones
    (0 without one), sum and number of their sizes, pages that have one."""
    ok = F.col("error").isNull()
    return tables.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
        F.sum(F.when(ok, F.col("rows") * F.col("cols"))).alias("total_size"), F.countDistinct(F.when(ok, F.col("page_number"))).alias("pages_with_tables"),
    )


def extraction_stats(tables: DataFrame) -> DataFrame:
    """Over extractions (confidence, language, table_type, complexity, document_type, is_fallback)."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    return tables.agg(F.avg("confidence").alias("avg_confidence"), *map(names, ("language", "table_type", "complexity", "document_type")), F.count_if(~F.col("is_fallback")).alias("structured"), F.count_if("is_fallback").alias("fallback"))


def preprocessing_result(pages: DataFrame) -> DataFrame:
    """One row per document from pages (doc_id, page_number, success, seconds, improvement)."""
    return pages.groupBy("doc_id").agg(F.sum("seconds").alias("seconds"), F.count_if("success").alias("successes"), F.coalesce(F.avg("improvement"), F.lit(0.7)).alias("improvement"), F.bool_and("success").alias("success"), F.min("page_number").alias("first_page"))


def combined_confidence(region: Column, structure: Column) -> Column:
    return (region + structure) / 2


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A text's lines as blocks: order, word and character counts, confidence 0.8."""
    b = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("order_in_page", "content"))
    return b.select(id_col, "order_in_page", "content", word_count(F.col("content")).alias("word_count"), F.length("content").alias("character_count"), F.lit(0.8).alias("confidence"))


def parts_for_regions(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """What stands in for text extraction that can't be parsed: the i-th part of the raw text, split at blank lines, for
    the i-th region (doc_id, pos from 0, region_id); confidence 0.5."""
    parts = texts.select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("pos", "part"))
    raw = F.coalesce("part", F.lit("Extraction failed"))
    return regions.join(parts, ["doc_id", "pos"], "left").select("doc_id", "pos", "region_id", stripped(raw).alias("extracted_text"), word_count(raw).alias("word_count"), F.lit(0.5).alias("confidence"))


def cross_page(blocks: DataFrame) -> DataFrame:
    """One row per document from blocks (doc_id, page, content, language): merged text, first and last page, words,
    languages. A document's blocks make one text, so they meet in one row by nature."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "content")))
    return blocks.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["content"]), "\n").alias("merged_content"), F.min("page").alias("start_page"), F.max("page").alias("end_page"),
        F.sum(word_count(F.col("content"))).alias("word_count"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )


def draw_list(regions: DataFrame, width: int, height: int, colours: dict[str, str], line: int = 3, text: int = 11) -> DataFrame:
    """What a renderer draws for each region (pos: its place on the page, from 0): pixel box, colour, label, line width by
    confidence, and the label's top edge: above the box, but on the page."""
    from ..sources.tables import mapped

    box = G.clamped_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(width), F.lit(height))
    label = F.concat(F.col("region_type"), F.lit("_"), F.col("pos").cast("string"), F.lit(" | "), F.call_function("format_number", F.col("confidence"), F.lit("0.00")))
    return regions.withColumns(box).withColumns({
        "colour": mapped(colours, F.col("region_type"), "#000000"), "label": label, "line_width": F.greatest(F.lit(1), (F.lit(line) * F.col("confidence")).cast("int")),
        "label_y": F.greatest(F.lit(0), F.col("py") - text - 5),
    })


STYLES = ("minimal", "detailed", "confidence_heatmap")


def drawn(regions: DataFrame, width: int, height: int, colours: dict[str, str], style: str, line: int = 3, text: int = 11) -> DataFrame:
    """draw_list() in one of the three styles: minimal is boxes alone; detailed adds a label, and the reading order in the
    middle of the box; the heat map has lines as wide as the confidence is high, and over 0.7 a second box within
    (inner: x, y, right, bottom)."""
    if style not in STYLES:
        raise ValueError(f"style: one of {STYLES}")
    d = draw_list(regions, width, height, colours, line, text)
    none, detailed, heat = F.lit(None), style == "detailed", style == "confidence_heatmap"
    inner = F.struct((F.col("px") + 2).alias("x"), (F.col("py") + 2).alias("y"), (F.col("px") + F.col("pw") - 2).alias("right"), (F.col("py") + F.col("ph") - 2).alias("bottom"))
    return d.withColumns({
        "line_width": F.col("line_width") if heat else F.lit(line), "label": F.col("label") if detailed else none.cast("string"), "label_y": F.col("label_y") if detailed else none.cast("int"),
        "order_x": F.col("px") + F.floor(F.col("pw") / 2).cast("int") if detailed else none.cast("int"), "order_y": F.col("py") + F.floor(F.col("ph") / 2).cast("int") if detailed else none.cast("int"),
        "inner": F.when((F.col("confidence") > 0.7) & F.lit(heat), inner),
    })


def detector_label_top(top: Column, text: Column) -> Column:
    """Top edge of a detector's label: over the box, or below its upper edge where that is off the page."""
    over = top - text - 10
    return F.when(over < 0, top + 10).otherwise(over)
