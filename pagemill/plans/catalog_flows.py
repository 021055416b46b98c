"""Registered queries: files written and read again, and whole flows through the offline provider."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as L
from ..operators import regions as R
from ..schemas import FAILED_QUALITY, FALLBACK_TABLE
from ..sources import files, sinks
from ..sources import tables as S
from ..sources.shared import place
from . import catalog_kernels as K
from . import workflows as W
from .adapter_sql import sql
from .registry import near, query


@query(sql("page_regions", select="SELECT page_id, reading_order, region_type, confidence FROM page_regions"))
def json_round_trip(spark, sf_dir):
    p = S.page_regions(spark, sf_dir)
    path = place(spark, "json")
    sinks.results_json(p, path)
    return spark.read.schema(p.schema).json(path)


@query(sql("page_regions", select="SELECT page_id % 7 AS page_number, count(*) AS n, sum(reading_order)::BIGINT AS total FROM page_regions GROUP BY ALL"))
def response_folders(spark, sf_dir):
    """Responses in one folder for each page."""
    p = S.page_regions(spark, sf_dir).withColumn("page_number", F.col("page_id") % 7)
    path = place(spark, "responses")
    sinks.responses_json(p, path)
    back = spark.read.schema("reading_order long, page_number long").json(path)
    return back.groupBy("page_number").agg(F.count(F.lit(1)).alias("n"), F.sum("reading_order").alias("total"))


@query(sql("page_regions", select="SELECT page_id AS page_number, 'r' || reading_order AS region_id, region_type, round(confidence, 6) AS confidence FROM page_regions"))
def csv_round_trip(spark, sf_dir):
    p = S.page_regions(spark, sf_dir)
    box = F.struct(*[F.lit(0.5).alias(c) for c in ("x", "y", "width", "height")])
    rows = p.withColumns({"page_number": F.col("page_id"), "region_id": F.concat(F.lit("r"), F.col("reading_order").cast("string")), "bbox": box, "content_description": F.lit("a, \"b\"")})
    path = place(spark, "csv")
    sinks.regions_csv(rows, path)
    back = spark.read.option("header", True).schema("page_number long, region_id string, region_type string, x double, y double, width double, height double, confidence double, reading_order int, content_description string").csv(path)
    return back.where("x = 0.5 and content_description is not null").select("page_number", "region_id", "region_type", near("confidence").alias("confidence"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderkey % 11 <> 0) AS successful FROM orders")
def summary_file(spark, sf_dir):
    """The summary over tables, which is written only where there is a table."""
    k = F.col("o_orderkey")
    t = S.table(spark, sf_dir, "orders").select((k % 50).alias("page_number"), (k % 9).alias("rows"), (k % 5).alias("cols"), F.lit(0.5).alias("confidence"), F.when(k % 11 == 0, "failed").alias("error"))
    path = place(spark, "summary")
    if sinks.table_summary_json(t.limit(0), R.table_summary(t), path):
        raise AssertionError("a summary without a table")
    sinks.table_summary_json(t, R.table_summary(t), path)
    return spark.read.schema("total long, successful long").json(path)


def _png_folder(spark, sf_dir) -> str:
    """Every image of the pixel table as a PNG file of its own."""
    own = K.images(spark, sf_dir).select(F.concat(F.lit("i"), F.col("image_id").cast("string")).alias("document"), F.lit(1).alias("page_number"), "height", "width", "data")
    path = place(spark, "png")
    sinks.files(sinks.png_rows(own, "original"), path)
    return path


@query(sql("pixels", select="SELECT image_id, y, x, g FROM pixels"))
def image_files(spark, sf_dir):
    """Pages written as PNG files and read back as pixels."""
    pages = files.page_images(spark, _png_folder(spark, sf_dir)).where("error is null")
    return K.pixel_rows(pages.select(F.regexp_extract("document", r"^i(\d+)_", 1).cast("long").alias("image_id"), "width", "data"))


@query(sql("pixels", select="SELECT 'i' || image_id || '_page_001_original.png' AS name, 'image' AS kind, '.png' AS format, 8 AS width, 8 AS height, 'L' AS mode, '' AS errors FROM (SELECT DISTINCT image_id FROM pixels)"))
def image_file_facts(spark, sf_dir):
    path = _png_folder(spark, sf_dir)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    facts = files.image_facts(spark, path)
    kinds = files.inputs(spark, path).select("path", "kind")
    j = facts.join(kinds, "path")
    return j.select(name.alias("name"), "kind", "format", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "mode", F.array_join("errors", ",").alias("errors"))


CLASS_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(s, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in L.CLASS_RULES) + " ELSE 'Other' END"


@query(f"SELECT doc_id, {CLASS_CASE} AS doc_class, 'fallback' AS source FROM (SELECT doc_id, lower(substr(coalesce(text, ''), 1, 4000)) AS s FROM documents)")
def document_classes(spark, sf_dir):
    """Classification through a provider that has no class to give: the rules' class."""
    return W.document_classes(S.table(spark, sf_dir, "documents"))


@query("SELECT doc_id AS table_id, 'parameter_0' AS subject, 'related_to' AS predicate, md5(text) AS object, 'rules' AS method FROM documents WHERE text <> ''")
def text_triplets(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_id"), "text")
    return W.text_triplets(d).withColumn("object", F.md5(F.col("object").cast("binary")))


@query(sql("pixels", select=f"SELECT image_id AS table_id, 2 AS rows, 2 AS cols, 0.3::DOUBLE AS structure_confidence, '{','.join(FALLBACK_TABLE[0])}' AS headers, 4 AS cells, '{FALLBACK_TABLE[1][1]}' AS value, 'simple_fallback' AS method FROM (SELECT DISTINCT image_id FROM pixels)"))
def table_contents(spark, sf_dir):
    """Table regions read by a provider that has no table to give: the fall-back table."""
    crops = K.images(spark, sf_dir).withColumnRenamed("image_id", "table_id")
    t = W.table_contents(crops)
    value = F.element_at(F.col("data_rows")[0], FALLBACK_TABLE[0][1])
    return t.select("table_id", "rows", "cols", "structure_confidence", F.array_join("headers", ",").alias("headers"), F.size("cells").alias("cells"), value.alias("value"), "method")


@query(sql("pixels", "measures", select="SELECT image_id, round(contrast, 6) AS contrast, round(brightness, 6) AS brightness, round(sharpness, 6) AS sharpness, round(noise, 6) AS noise, 1.0::DOUBLE AS aspect FROM measures"))
def page_measures(spark, sf_dir):
    """What preprocessing measures of a page, from its bytes."""
    p = K.images(spark, sf_dir).select(F.col("image_id").cast("string").alias("path"), "height", "width", "data", F.lit(None).cast("string").alias("error"))
    m = W.measured(p)
    return m.select(F.col("path").cast("long").alias("image_id"), *(near(c).alias(c) for c in ("contrast", "brightness", "sharpness", "noise")), "aspect")


@query(sql("pixels", select=f"SELECT image_id, '{FAILED_QUALITY}' AS quality, 3 AS priority, 0.5::DOUBLE AS success_rate, 'enhance_contrast,denoise,sharpen' AS recommendations, TRUE AS process, 'fallback' AS source FROM (SELECT DISTINCT image_id FROM pixels)"))
def model_conditions(spark, sf_dir):
    """Conditions asked of a provider that has none to give: the stand-in assessment."""
    p = K.images(spark, sf_dir).select(F.col("image_id").cast("string").alias("path"), "height", "width", "data", F.lit(None).cast("string").alias("error"))
    m = W.model_conditions(p)
    return m.select(F.col("path").cast("long").alias("image_id"), "quality", "priority", "success_rate", F.array_join("recommendations", ",").alias("recommendations"), "process", "source")
