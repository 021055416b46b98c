"""Parquet tables, and adapters that give them the shapes of the document model.

Every adapter is plain arithmetic over columns, so that filters and column choices reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CONDITIONS, SEVERITIES

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
ENTITY_OF_SEGMENT = {"AUTOMOBILE": "product", "BUILDING": "location", "FURNITURE": "concept", "HOUSEHOLD": "organization", "MACHINERY": "technology"}
REGION_OF_TAG = {"title": "header", "h1": "title", "p": "paragraph", "li": "list", "nav": "sidebar", "footer": "footer"}
EVIDENCE = ("text at the bottom, header inverted", "horizontal text line, signature below", "vertical text", "clear page", "footer above the paragraph")
ACTION_OF_CONDITION = {
    "skewed": "deskew", "rotated_90_cw": "rotate_90_ccw", "rotated_90_ccw": "rotate_90_cw", "rotated_180": "rotate_180", "poor_quality": "denoise", "blurry": "sharpen",
    "low_contrast": "enhance_contrast", "dark_background": "gamma_correction", "faded_text": "histogram_equalization", "shadow_distortion": "remove_shadows", "torn_edges": "crop_margins",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(values, index):
    """The value at index of a fixed list."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def mapped(values: dict, key, default=None):
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def pixels(spark, sf_dir) -> DataFrame:
    """(image_id, y, x, g): each embedding as a gray image of 8 by 8."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    g = F.floor(F.lit(14.0) * (F.col("label") + 1) + F.lit(20.0) * (1 + 10 * (F.col("vec_id") % 5)) * F.col("v").cast("double"))
    return e.select(F.col("vec_id").alias("image_id"), F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.least(F.greatest(g, F.lit(0)), F.lit(255)).cast("int").alias("g"))


def detections(spark, sf_dir) -> DataFrame:
    """(table_id, pos, label_id, score, x, y, w, h): boxes that a structure detector found in a table."""
    line = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*LINE_ORDER))
    hundredth = lambda c: c.cast("double") / 100
    return line.select(
        F.col("l_partkey").alias("table_id"), pos.alias("pos"), (F.col("l_suppkey") % 6).cast("int").alias("label_id"), (F.lit(0.5) + F.lit(5.0) * F.col("l_discount")).alias("score"),
        hundredth(F.col("l_orderkey") % 70).alias("x"), hundredth(F.col("l_suppkey") % 90).alias("y"),
        hundredth(F.col("l_quantity").cast("long") % 30 + 1).alias("w"), hundredth(F.col("l_quantity").cast("long") % 20 + 1).alias("h"),
    )


def kv_rows(spark, sf_dir) -> DataFrame:
    """(table_id, pos, row_header, p_type, p_size): rows of specification tables; every third part has size zero."""
    part = table(spark, sf_dir, "part")
    size = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_size"))
    return part.select(F.col("p_brand").alias("table_id"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("pos"), F.col("p_name").alias("row_header"), "p_type", size.alias("p_size"))


def semantic_rows(spark, sf_dir) -> DataFrame:
    """(event_id, row_header, values, single_value): semantic table rows; odd ids have values, every third a single one."""
    e = table(spark, sf_dir, "events")
    held = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.col("event_type").alias("row_header"), F.when(F.col("event_id") % 2 == 1, held).otherwise(F.create_map().cast("map<string,string>")).alias("values"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("single_value"))


def entity_mentions(spark, sf_dir) -> DataFrame:
    """(doc_id, pos, name, entity_type): every seventh customer is mentioned a second time, with another type."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    first = c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"), mapped(ENTITY_OF_SEGMENT, F.col("c_mktsegment"), "other").alias("entity_type"))
    again = c.where("c_custkey % 7 = 0").select(F.col("c_nationkey").alias("doc_id"), (F.col("c_custkey") + 1_000_000_000).alias("pos"), F.col("c_name").alias("name"), F.lit("event").alias("entity_type"))
    return first.unionByName(again)


def relation_mentions(spark, sf_dir) -> DataFrame:
    """(doc_id, pos, subject_name, predicate, object_name, evidence)."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(F.col("c_nationkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("c_name").alias("subject_name"), F.when(F.col("o_totalprice") > 100000, "owns").otherwise("related_to").alias("predicate"), F.col("n_name").alias("object_name"), F.col("o_orderpriority").alias("evidence"))


def page_regions(spark, sf_dir) -> DataFrame:
    """(page_id, reading_order, region_type, confidence): the regions that a page's tags mark."""
    p = table(spark, sf_dir, "pages")
    tags = F.regexp_extract_all("html", F.lit(r"<(title|h1|p|li|footer|nav)[ >]"), F.lit(1))
    r = p.select("page_id", F.posexplode(tags).alias("i", "tag"))
    return r.select("page_id", (F.col("i") + 1).alias("reading_order"), mapped(REGION_OF_TAG, F.col("tag")).alias("region_type"), ((F.col("i") * 7 + F.col("page_id")) % 101 / F.lit(100.0)).alias("confidence"))


def line_votes(spark, sf_dir) -> DataFrame:
    """(page_id, pos, rho, deg): lines that a transform found on a page."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    return e.select(F.col("vec_id").alias("page_id"), "pos", (v * 100).alias("rho"), F.pmod(F.floor((v + 1) * 900), F.lit(180)).cast("double").alias("deg"))


def upright_votes(spark, sf_dir) -> DataFrame:
    """line_votes() of pages that are nearly straight: degrees from 88 to 104."""
    return line_votes(spark, sf_dir).withColumn("deg", F.lit(88.0) + F.col("deg") % 17)


def sparse_cells(spark, sf_dir) -> DataFrame:
    """cells() in which every other row of a table has text in column 0 only."""
    return cells(spark, sf_dir).withColumn("text", F.when((F.col("col") == 0) | (F.col("row") % 2 == 0), F.col("text")))


def cells(spark, sf_dir) -> DataFrame:
    """(table_id, row, col, text, rowspan, colspan): a header row and the table's lines, some without text."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.withColumn("row", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*LINE_ORDER)))
    texts = F.array(F.col("l_returnflag"), F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit(" "), F.col("l_linestatus"), F.lit("\n"))), F.when(F.col("l_linenumber") % 3 == 0, "●"), F.col("l_linenumber").cast("string"))
    body = rows.select(F.col("l_partkey").alias("table_id"), "row", F.posexplode(texts).alias("col", "text"))
    head = line.select(F.col("l_partkey").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, ("flag", "status", "option", "option")))).alias("col", "text"))
    spans = F.when((F.col("row") > 0) & (F.col("row") % 7 == 0) & (F.col("col") == 0), 2).otherwise(1)
    return head.unionByName(body).withColumns({"rowspan": spans, "colspan": F.when((F.col("row") > 0) & (F.col("row") % 11 == 0) & (F.col("col") == 1), 2).otherwise(1)})


def conditions(spark, sf_dir) -> DataFrame:
    """(page_id, pos, condition, severity, confidence, is_primary, evidence, actions): conditions found on a page."""
    line = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    condition = picked(CONDITIONS, F.col("l_suppkey") % len(CONDITIONS))
    out = line.select(
        F.col("l_orderkey").alias("page_id"), pos.alias("pos"), condition.alias("condition"), picked(SEVERITIES, F.col("l_partkey") % 5).alias("severity"), (F.lit(0.5) + F.lit(4.0) * F.col("l_discount")).alias("confidence"),
        (F.col("l_linenumber") % 2 == 1).alias("is_primary"), picked(EVIDENCE, F.col("l_suppkey") % 5).alias("evidence"), (F.col("l_partkey") % 3 == 0).alias("more"),
    )
    own = mapped(ACTION_OF_CONDITION, F.col("condition"), "no_action")
    return out.withColumn("actions", F.when(F.col("more"), F.array(own, F.lit("binarize"))).otherwise(F.array(own))).drop("more")
