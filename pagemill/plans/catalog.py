"""Registered queries: each operator over a whole table, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as TX
from ..operators import conditions as C
from ..operators import grids as M
from ..operators import inference as L
from ..operators import knowledge as N
from ..operators import pixels as J
from ..operators import regions as R
from ..schemas import ACTION_GROUP, ACTION_RANK, CONDITION_MODIFIER, HORIZONTAL, NOTES, QUALITY_NOTE, ROTATIONS, SEVERITY_IMPACT, TURN_NAMES, TURN_NOTE, TYPE_COLOURS, UPSIDE_DOWN
from ..sources import sinks
from ..sources import tables as S
from .adapter_sql import case, sql, variance
from .registry import ORACLES, QUERIES, near, query, r6, rd

# Knowledge


def kv_triplets(spark, sf_dir):
    return N.rule_triplets(S.kv_rows(spark, sf_dir), ["p_type", "p_size"])


FALLBACK = """SELECT table_id, pos, row_header AS subject, 'related_to' AS predicate, v AS object, 0.6::DOUBLE AS confidence, row_header || ' has ' || k || ' of ' || v AS sentence
FROM (SELECT table_id, pos, row_header, unnest(['p_type', 'p_size']) AS k, unnest([p_type, CASE WHEN p_size <> 0 THEN p_size::VARCHAR END]) AS v FROM kv_rows WHERE pos <= 3) WHERE v <> ''"""


@query(sql("kv_rows", select=FALLBACK))
def fallback_triplets(spark, sf_dir):
    return kv_triplets(spark, sf_dir)


def triplets(spark, sf_dir):
    return N.resolved(S.entity_mentions(spark, sf_dir), S.relation_mentions(spark, sf_dir))


KNOWN = ("entity_mentions", "relation_mentions", "triplets")


@query(sql(*KNOWN, select="SELECT * FROM triplets"))
def triplet_resolution(spark, sf_dir):
    return triplets(spark, sf_dir)


@query(sql(*KNOWN, select="SELECT * FROM missing"))
def missing_entities(spark, sf_dir):
    return N.missing(S.entity_mentions(spark, sf_dir), S.relation_mentions(spark, sf_dir))


@query(sql(*KNOWN, select="SELECT entity_type, count(*) AS n FROM (SELECT subject_type AS entity_type FROM triplets UNION ALL SELECT object_type FROM triplets) GROUP BY ALL"))
def entity_type_distribution(spark, sf_dir):
    return N.end_types(triplets(spark, sf_dir))


@query(sql(*KNOWN, select="SELECT entity_type, count(*) AS n FROM (SELECT subject_name, subject_type AS entity_type FROM triplets UNION SELECT object_name, object_type FROM triplets) GROUP BY entity_type"))
def distinct_entities(spark, sf_dir):
    return N.distinct_entities(triplets(spark, sf_dir))


@query(sql(*KNOWN, select="SELECT predicate, count(*) AS n FROM triplets GROUP BY predicate"))
def predicate_distribution(spark, sf_dir):
    return N.distribution(triplets(spark, sf_dir), "predicate")


@query(sql(*KNOWN, select="""SELECT doc_id, name, sum(o)::BIGINT AS out_degree, sum(1 - o)::BIGINT AS in_degree FROM (SELECT doc_id, subject_name AS name, 1 AS o FROM triplets UNION ALL SELECT doc_id, object_name, 0 FROM triplets) GROUP BY ALL"""))
def graph_degrees(spark, sf_dir):
    return N.degrees(triplets(spark, sf_dir))


@query(sql(*KNOWN, select="""SELECT doc_id, n_entities, n_relations, n_predicates FROM (SELECT doc_id, count(*) AS n_relations, count(DISTINCT predicate) AS n_predicates FROM triplets GROUP BY doc_id)
JOIN (SELECT doc_id, count(*) AS n_entities FROM (SELECT doc_id, subject_name FROM triplets UNION SELECT doc_id, object_name FROM triplets) GROUP BY doc_id) USING (doc_id)"""))
def graph_stats(spark, sf_dir):
    return N.graph(triplets(spark, sf_dir))


@query(sql("entity_mentions", select="SELECT entity_type, count(DISTINCT name) AS n_instances, min(name) AS first_name, max(name) AS last_name, 'entity' AS parent FROM entity_mentions GROUP BY entity_type"))
def ontology_classes(spark, sf_dir):
    return N.ontology(S.entity_mentions(spark, sf_dir))


SINGLE = "coalesce(single_value, '') <> '' AND len(ks) = 0"


@query(sql("semantic_rows", select=f"SELECT event_id, row_header, {SINGLE} AS is_single, CASE WHEN {SINGLE} THEN 'value=' || single_value ELSE array_to_string(list_transform(list_zip(ks, vs), lambda z: z[1] || '=' || z[2]), ';') END AS data FROM semantic_rows"))
def semantic_rows(spark, sf_dir):
    d = N.data_rows(S.semantic_rows(spark, sf_dir))
    return d.select("event_id", "row_header", "is_single", F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("data"))


@query(sql("semantic_rows", select=f"""SELECT event_id, 0 AS col, row_header AS content, 'header' AS cell_type, 0.9::DOUBLE AS confidence FROM semantic_rows
UNION ALL SELECT event_id, i, coalesce(v, ''), 'data', 0.85::DOUBLE FROM (SELECT event_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM (SELECT event_id, CASE WHEN {SINGLE} THEN [single_value] ELSE vs END AS x FROM semantic_rows))"""))
def semantic_cells(spark, sf_dir):
    return N.semantic_cells(S.semantic_rows(spark, sf_dir))


@query(sql("kv_rows", select="""SELECT table_id, pos, 'Row ' || pos || ': {"row_header": "' || row_header || '", "p_type": "' || p_type || '", "p_size": ' || p_size || '}' AS line FROM (SELECT *, count(*) OVER (PARTITION BY table_id) AS n FROM kv_rows) WHERE pos <= 20 OR (n > 25 AND pos > n - 3)"""))
def row_preview_sample(spark, sf_dir):
    shown = N.shown_rows(S.kv_rows(spark, sf_dir))
    return shown.select("table_id", "pos", N.row_line(F.col("pos"), ["row_header", "p_type", "p_size"]).alias("line"))


@query("SELECT event_id, event_type AS row_header, len(list_filter(list_transform(json_keys(props), lambda k: json_extract_string(props, '$.' || k)), lambda v: v <> '')) AS shown FROM events")
def display_rows(spark, sf_dir):
    held = F.from_json("props", "map<string,string>")
    d = S.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("row_header"), held.alias("values"))
    return d.select("event_id", "row_header", F.size(N.shown_values(F.col("values"))).cast("long").alias("shown"))


@query("""WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS lang, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0.25::DOUBLE END AS conf FROM orders)
SELECT id, coalesce(lang, 'unknown') AS language, coalesce(conf, 0.8::DOUBLE) AS confidence, 2 AS cols, 0 AS rows FROM t""")
def extractor_defaults(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    t = o.select(
        F.col("o_orderkey").alias("id"), F.struct(F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("array<string>").alias("data_relationships"), F.struct(F.lit(None).cast("int").alias("columns")).alias("structure")).alias("table"),
        F.struct(F.when(F.col("o_orderkey") % 3 != 0, 0.25).alias("confidence"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("detected_language")).alias("extraction_metadata"),
        F.struct(F.lit(None).cast("string").alias("document_type"), F.lit(None).cast("int").alias("total_tables")).alias("table_summary"),
    )
    return N.extractor_input(t.withColumn("table", F.col("table").withField("table_id", F.col("id").cast("string")))).select(F.col("table_id").cast("long").alias("id"), "language", "confidence", "cols", "rows")


# Boxes and regions

BOX = "detections"


@query(sql(BOX, select="SELECT table_id, pos, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in (("right_x", "x + w"), ("bottom_y", "y + h"), ("center_x", "x + w / 2"), ("center_y", "y + h / 2"), ("area", "w * h"))) + " FROM detections"))
def bbox_geometry(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    d = S.detections(spark, sf_dir)
    return d.select("table_id", "pos", near(G.right(x, w)).alias("right_x"), near(G.bottom(y, h)).alias("bottom_y"), near(G.middle(x, w)).alias("center_x"), near(G.middle(y, h)).alias("center_y"), near(G.area(w, h)).alias("area"))


@query(sql(BOX, select="SELECT table_id, pos, trunc(x * 1448)::INT AS px, trunc(y * 2048)::INT AS py, trunc(w * 1448)::INT AS pw, trunc(h * 2048)::INT AS ph, trunc(x * 1448)::INT + trunc(w * 1448)::INT // 2 AS cx, (trunc(w * 1448)::INT * trunc(h * 2048)::INT)::BIGINT AS area FROM detections"))
def bbox_pixel_window(spark, sf_dir):
    p = S.detections(spark, sf_dir).select("table_id", "pos", *(G.pixels(F.col(a), F.lit(n)).alias(b) for a, n, b in (("x", 1448, "px"), ("y", 2048, "py"), ("w", 1448, "pw"), ("h", 2048, "ph"))))
    return p.withColumns({"cx": G.pixel_middle(F.col("px"), F.col("pw")), "area": G.area(F.col("pw").cast("long"), F.col("ph").cast("long"))})


@query(sql(BOX, select="""SELECT table_id, pos, px, py, greatest(1, least(trunc(w * 40)::INT, 40 - px)) AS pw, greatest(1, least(trunc(h * 30)::INT, 30 - py)) AS ph
FROM (SELECT *, greatest(0, least(trunc(x * 40)::INT, 39)) AS px, greatest(0, least(trunc(y * 30)::INT, 29)) AS py FROM detections)"""))
def bbox_clamped(spark, sf_dir):
    d = S.detections(spark, sf_dir)
    return d.select("table_id", "pos", *(c.alias(n) for n, c in G.clamped_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(40), F.lit(30)).items()))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_suppkey::DOUBLE / nullif(l_partkey, 0), 6) AS x, round(l_linenumber::DOUBLE / nullif(l_suppkey, 0), 6) AS y, round((l_quantity - l_suppkey) / nullif(l_partkey, 0), 6) AS width, round((l_quantity - l_linenumber) / nullif(l_suppkey, 0), 6) AS height FROM lineitem""")
def bbox_relative(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    b = G.relative_box(d("l_suppkey"), d("l_linenumber"), d("l_quantity"), d("l_quantity"), d("l_partkey"), d("l_suppkey"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *(near(c).alias(n) for n, c in b.items()))


VALID = "x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1 AND x + w <= 1 AND y + h <= 1"


@query(sql(BOX, select=f"SELECT table_id, count(*) AS n, count(*) FILTER ({VALID} AND w > 0 AND h > 0) AS n_valid, count(*) FILTER ({VALID}) AS n_inside FROM detections GROUP BY table_id"))
def bbox_valid_regions(spark, sf_dir):
    return R.survivors(S.detections(spark, sf_dir), "table_id")


@query(sql(BOX, select="SELECT table_id, pos, px, py FROM (SELECT table_id, pos, trunc(x * 100)::INT AS px, trunc(y * 100)::INT AS py FROM detections) WHERE px >= 20 AND px < 60 AND py >= 10 AND py < 90"))
def crop_window(spark, sf_dir):
    p = S.detections(spark, sf_dir).select(F.col("table_id"), F.col("pos"), G.pixels(F.col("x"), F.lit(100)).alias("x"), G.pixels(F.col("y"), F.lit(100)).alias("y"))
    out = J.cropped(p, F.lit(20), F.lit(10), F.lit(40), F.lit(80))
    return out.select("table_id", "pos", (F.col("x") + 20).alias("px"), (F.col("y") + 10).alias("py"))


@query(sql(BOX, select="""SELECT table_id, pos, array_to_string(list_filter([CASE WHEN NOT score BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN NOT label_id >= 1 THEN 'row' END, CASE WHEN NOT h > 0.05 THEN 'height' END], lambda e: e IS NOT NULL), ',') AS errors FROM detections"""))
def field_constraints(spark, sf_dir):
    d = S.detections(spark, sf_dir)
    out = R.checked(d, {"confidence": F.col("score").between(0, 1), "row": F.col("label_id") >= 1, "height": F.col("h") > 0.05})
    return out.select("table_id", "pos", F.array_join("errors", ",").alias("errors"))


@query(sql("page_regions", select=f"SELECT region_type, count(*) AS n, {rd('avg_confidence').replace('round(avg_confidence', 'round(avg(confidence)')} FROM page_regions GROUP BY region_type UNION ALL SELECT 'all', count(*), round(avg(confidence), 6) FROM page_regions"))
def regions_by_type(spark, sf_dir):
    return R.by_type(S.page_regions(spark, sf_dir)).select("region_type", "n", *r6("avg_confidence"))


@query(sql("page_regions", select="SELECT b::INT AS bin, count(confidence) AS n FROM range(5) t(b) LEFT JOIN page_regions ON least(floor(confidence * 5), 4) = b GROUP BY b"))
def confidence_histogram(spark, sf_dir):
    return R.confidence_histogram(S.page_regions(spark, sf_dir))


@query(sql("page_regions", select="SELECT * FROM page_regions WHERE region_type IN ('text', 'title', 'header', 'footer', 'caption')"))
def text_regions(spark, sf_dir):
    return R.text_regions(S.page_regions(spark, sf_dir))


@query(sql("page_regions", select="""SELECT page_id AS page_number, 'region_' || page_id || '_' || reading_order AS region_id, region_type, 0.1::DOUBLE AS x, 0.2::DOUBLE AS y, 0.8::DOUBLE AS width, 0.6::DOUBLE AS height, confidence, reading_order, region_type AS content_description FROM page_regions"""))
def regions_csv(spark, sf_dir):
    p = S.page_regions(spark, sf_dir)
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.8).alias("width"), F.lit(0.6).alias("height"))
    return sinks.region_rows(p.withColumns({"page_number": F.col("page_id"), "region_id": F.concat_ws("_", F.lit("region"), F.col("page_id").cast("string"), F.col("reading_order").cast("string")), "bbox": box, "content_description": F.col("region_type")}))


@query(sql("page_regions", select="""SELECT page_id, '{"page_id":' || page_id || ',"region_type":"' || region_type || '"}' AS json FROM page_regions"""))
def region_export(spark, sf_dir):
    p = S.page_regions(spark, sf_dir).select("page_id", "region_type", "reading_order")
    return p.select("page_id", F.to_json(F.struct("page_id", "region_type")).alias("json"))


@query(sql("page_regions", select="SELECT page_id, reading_order, CASE WHEN confidence >= 0.9 THEN 'very_high' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END AS level FROM page_regions"))
def confidence_levels(spark, sf_dir):
    return S.page_regions(spark, sf_dir).select("page_id", "reading_order", TX.confidence_level(F.col("confidence")).alias("level"))


@query(sql("page_regions", select=f"""SELECT page_id, reading_order, px, py, 100 AS pw, 12 AS ph, {case(TYPE_COLOURS, "region_type", "'#000000'")} AS colour, region_type || '_' || (reading_order - 1) || ' | ' || printf('%.2f', confidence) AS label, greatest(1, trunc(3 * confidence)::INT) AS line_width,
greatest(0, py - 16) AS label_y FROM (SELECT *, 20 AS px, trunc((reading_order % 20)::DOUBLE / 32 * 400)::INT AS py FROM page_regions)"""))
def draw_list(spark, sf_dir):
    p = S.page_regions(spark, sf_dir).withColumns({"pos": F.col("reading_order") - 1, "x": F.lit(0.1), "y": (F.col("reading_order") % 20).cast("double") / 32, "w": F.lit(0.5), "h": F.lit(0.03125)})
    return R.draw_list(p, 200, 400, TYPE_COLOURS).select("page_id", "reading_order", "px", "py", "pw", "ph", "colour", "label", "line_width", "label_y")


@query("""WITH p AS (SELECT o_custkey AS doc_id, (o_orderkey % 13) AS n_regions, (o_orderkey % 4) AS n_tables, least(o_orderkey % 4, o_orderkey % 3) AS n_ok FROM orders)
SELECT doc_id, count(*) AS pages, sum(n_regions)::BIGINT AS regions, sum(n_tables)::BIGINT AS tables, sum(n_ok)::BIGINT AS ok_tables, round(sum(n_ok)::DOUBLE / greatest(sum(n_tables), 1), 6) AS success_rate FROM p GROUP BY doc_id""")
def document_summary(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    p = o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 13).alias("n_regions"), (F.col("o_orderkey") % 4).alias("n_tables"), F.least(F.col("o_orderkey") % 4, F.col("o_orderkey") % 3).alias("n_ok"))
    return R.document_summary(p).withColumns({"success_rate": near("success_rate")})


@query("""WITH t AS (SELECT o_custkey % 50 AS page_number, o_orderkey % 9 + 1 AS rows, o_orderkey % 5 + 1 AS cols, (0.5 + (o_orderkey % 10) / 25::DOUBLE + 0.8) / 2 AS confidence, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' END AS error FROM orders)
SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed, round(coalesce(avg(confidence) FILTER (error IS NULL), 0), 6) AS avg_confidence, (sum(rows * cols) FILTER (error IS NULL))::BIGINT AS total_size, count(DISTINCT page_number) FILTER (error IS NULL) AS pages_with_tables FROM t""")
def table_status_summary(spark, sf_dir):
    k = F.col("o_orderkey")
    conf = R.combined_confidence(F.lit(0.5) + (k % 10) / F.lit(25.0), F.lit(0.8))
    t = S.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("page_number"), (k % 9 + 1).alias("rows"), (k % 5 + 1).alias("cols"), conf.alias("confidence"), F.when(k % 11 == 0, "failed").alias("error"))
    return R.table_summary(t).withColumns({"avg_confidence": near("avg_confidence")})


@query("""SELECT round(avg(c), 6) AS avg_confidence, string_agg(DISTINCT s, ',' ORDER BY s) AS languages, string_agg(DISTINCT p, ',' ORDER BY p) AS table_types, 'simple' AS complexitys, string_agg(DISTINCT s, ',' ORDER BY s) AS document_types, count(*) FILTER (NOT f) AS structured, count(*) FILTER (f) AS fallback
FROM (SELECT (o_orderkey % 7) / 10::DOUBLE AS c, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 6 = 0 AS f FROM orders)""")
def extraction_stats(spark, sf_dir):
    k = F.col("o_orderkey")
    t = S.table(spark, sf_dir, "orders").select(((k % 7) / F.lit(10.0)).alias("confidence"), F.col("o_orderstatus").alias("language"), F.col("o_orderpriority").alias("table_type"), F.lit("simple").alias("complexity"), F.col("o_orderstatus").alias("document_type"), (k % 6 == 0).alias("is_fallback"))
    return R.extraction_stats(t).withColumns({"avg_confidence": near("avg_confidence")})


@query("""SELECT o_custkey AS doc_id, round(sum(o_totalprice), 2) AS seconds, count(*) FILTER (o_orderkey % 8 <> 0) AS successes, round(coalesce(avg(CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 10) / 10::DOUBLE END), 0.7), 6) AS improvement, bool_and(o_orderkey % 8 <> 0) AS success, min(o_orderkey) AS first_page FROM orders GROUP BY o_custkey""")
def preprocessing_result(spark, sf_dir):
    k = F.col("o_orderkey")
    p = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("page_number"), (k % 8 != 0).alias("success"), F.col("o_totalprice").alias("seconds"), F.when(k % 5 != 0, (k % 10) / F.lit(10.0)).alias("improvement"))
    return R.preprocessing_result(p).withColumns({"seconds": F.round("seconds", 2), "improvement": near("improvement")})


# Table structure

PARSED = (BOX, "parsed")
GRID = (*PARSED, "lines", "grid", "grid_cells")


@query(sql(*PARSED, select="SELECT label, kind, count(*) AS n FROM parsed GROUP BY ALL"))
def detection_classes(spark, sf_dir):
    return M.parsed(S.detections(spark, sf_dir)).groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(sql(*PARSED, "lines", select="SELECT table_id, kind, idx, pos FROM lines"))
def table_grid(spark, sf_dir):
    return M.lines(M.parsed(S.detections(spark, sf_dir))).select("table_id", "kind", "idx", "pos")


@query(sql(*GRID, select='SELECT table_id, "row", col, x, y, w, h, cell_type, 0.8::DOUBLE AS confidence FROM grid_cells'))
def grid_cells(spark, sf_dir):
    return M.cells(M.parsed(S.detections(spark, sf_dir)))


@query(sql(*GRID, "spanned", select="SELECT * EXCLUDE (span_main), span_main // 100000 AS main_row, span_main % 100000 AS main_col FROM spanned"))
def spanning_cells(spark, sf_dir):
    s = M.spanned(M.parsed(S.detections(spark, sf_dir)))
    return s.select("*", F.col("span_main.row").alias("main_row"), F.col("span_main.col").alias("main_col")).drop("span_main")


@query(sql(*PARSED, select="""SELECT table_id, pos, level, 'Header_L' || level AS text, array_to_string(range(trunc(x * 10)::INT, trunc((x + w) * 10)::INT + 1), ',') AS columns
FROM (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY round_even(y * 10, 0)) - 1 AS level FROM parsed WHERE kind = 'header')"""))
def header_levels(spark, sf_dir):
    return M.headers(M.parsed(S.detections(spark, sf_dir))).withColumn("columns", F.array_join(F.col("columns").cast("array<string>"), ","))


@query(sql(*PARSED, "grid", select="SELECT table_id, unnest(range(n_cols)) AS col, 'Column_' || unnest(range(1, n_cols + 1)) AS header FROM grid WHERE n_cols > 0"))
def placeholder_headers(spark, sf_dir):
    return M.placeholder_headers(M.parsed(S.detections(spark, sf_dir)))


@query(sql(*PARSED, "grid", "records", select="SELECT table_id, rows, cols, n_headers, has_spans, round(structure_confidence, 6) AS structure_confidence FROM records"))
def structure_confidence(spark, sf_dir):
    return M.records(M.parsed(S.detections(spark, sf_dir))).withColumns({"structure_confidence": near("structure_confidence")})


@query(sql(*GRID, "spanned", "records", select="""SELECT table_id, rows || 'x' || cols AS dimensions, coalesce(t, 0) AS total_cells, coalesce(hd, 0) AS header_cells, coalesce(mg, 0) AS merged_cells, round(structure_confidence, 6) AS structure_confidence, n_headers > 0 AS has_multi_level_headers
FROM records LEFT JOIN (SELECT table_id, count(*) AS t, count(*) FILTER (cell_type = 'header') AS hd, count(*) FILTER (cell_type = 'merged') AS mg FROM spanned GROUP BY table_id) USING (table_id)"""))
def table_summary(spark, sf_dir):
    return M.summary(M.parsed(S.detections(spark, sf_dir))).withColumns({"structure_confidence": near("structure_confidence")})


@query(sql(*PARSED, "grid", "records", select="""SELECT count(*) AS tables, sum(rows * cols)::BIGINT AS total_cells, round(avg(structure_confidence), 6) AS avg_confidence, count(*) FILTER (n_headers > 0) AS with_headers, count(*) FILTER (has_spans) AS with_merged,
(SELECT table_id FROM records ORDER BY rows * cols DESC, table_id LIMIT 1) AS largest_id, (SELECT rows || 'x' || cols FROM records ORDER BY rows * cols DESC, table_id LIMIT 1) AS largest FROM records"""))
def largest_table(spark, sf_dir):
    return M.overall(M.records(M.parsed(S.detections(spark, sf_dir)))).withColumns({"avg_confidence": near("avg_confidence")})


@query(sql(*PARSED, "lines", select="""SELECT b.table_id, b.pos, (SELECT 0) * 0 + r AS "row", c AS col FROM (SELECT b.table_id, b.pos, arg_min(l.idx, (abs(b.y + b.h / 2 - (l.y + l.h / 2)), l.idx)) FILTER (l.kind = 'row') AS r, arg_min(l.idx, (abs(b.x + b.w / 2 - (l.x + l.w / 2)), l.idx)) FILTER (l.kind = 'column') AS c
FROM parsed b JOIN lines l USING (table_id) WHERE b.kind = 'span' GROUP BY ALL) b"""))
def nearest_lines(spark, sf_dir):
    p = M.parsed(S.detections(spark, sf_dir))
    return M.nearest_lines(p.where("kind = 'span'"), M.lines(p))


@query(sql("cells", select="""SELECT table_id, "row", col, regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^\\s+', ''), '\\s+$', '') AS text FROM cells"""))
def coordinate_cells(spark, sf_dir):
    return M.coordinates(S.cells(spark, sf_dir))


@query(sql("cells", "filled", select='SELECT table_id, "row", col, t.t AS text FROM filled'))
def span_fill(spark, sf_dir):
    return M.filled(S.cells(spark, sf_dir))


@query(sql("cells", "filled", select='SELECT table_id, min("row")::BIGINT AS header_row FROM filled WHERE t.t IS NOT NULL GROUP BY table_id'))
def header_row(spark, sf_dir):
    return M.header_rows(S.cells(spark, sf_dir)).select("table_id", F.col("header_row").cast("long").alias("header_row"))


@query(sql("cells", "filled", select="""SELECT table_id, "row", coalesce(flag, '') AS flag, coalesce(status, '') AS status, coalesce(option, '') AS option FROM (SELECT table_id, "row", max(coalesce(t.t, '')) FILTER (col = 0) AS flag, max(coalesce(t.t, '')) FILTER (col = 1) AS status, max(coalesce(t.t, '')) FILTER (col = 3) AS option, count(t.t) AS n FROM filled WHERE "row" > 0 GROUP BY ALL)
WHERE n > 0"""))
def span_fill_rows(spark, sf_dir):
    s = M.structured(S.cells(spark, sf_dir))
    return s.select("table_id", "row", *(F.coalesce(F.try_element_at("values", F.lit(k)), F.lit("")).alias(k) for k in ("flag", "status", "option")))


LOOKUP = 'SELECT table_id, "row", col, text, column_header, row_header FROM (SELECT *, max(text) FILTER ("row" = 0) OVER (PARTITION BY table_id, col) AS column_header, max(text) FILTER (col = 0) OVER (PARTITION BY table_id, "row") AS row_header FROM cells) WHERE "row" > 0 AND col > 0'


@query(sql("cells", select=LOOKUP))
def column_header_lookup(spark, sf_dir):
    return M.with_headers(S.cells(spark, sf_dir)).select("table_id", "row", "col", "text", "column_header", "row_header")


@query(sql("cells", select=f"SELECT table_id, \"row\", row_header, column_header FROM ({LOOKUP}) WHERE text = '●'"))
def compat_matrix(spark, sf_dir):
    return M.marked(S.cells(spark, sf_dir))


@query(sql("cells", select=f"""SELECT table_id, "row", arg_min(column_header, col) FILTER (text = '●') AS value, string_agg(column_header, '; ' ORDER BY col) AS notes FROM ({LOOKUP}) GROUP BY ALL"""))
def option_rows(spark, sf_dir):
    return M.options(S.cells(spark, sf_dir))


@query(sql("sparse", select="""SELECT table_id, "row", title FROM (SELECT table_id, "row", bool_or(col = 0 AND trim(coalesce(text, '')) <> '') AS f, count(*) FILTER (col > 0 AND trim(coalesce(text, '')) <> '') AS o, arg_min(text, col) AS title FROM sparse GROUP BY ALL) WHERE f AND o = 0"""))
def section_titles(spark, sf_dir):
    return M.section_titles(S.sparse_cells(spark, sf_dir))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS "row", l_linenumber % 3 AS col, (l_suppkey % 3 + 1) AS rowspan, (l_partkey % 2 + 1) AS colspan FROM lineitem""")
def raw_cell_spans(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return M.raw_spans(li.select("l_orderkey", "l_partkey", "l_suppkey", n.alias("row_start"), (n + F.col("l_suppkey") % 3).alias("row_end"), (n % 3).alias("col_start"), (n % 3 + F.col("l_partkey") % 2).alias("col_end")))


# Text


@query(r"""SELECT doc_id, i AS order_in_page, line AS content, len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) AS word_count, length(line) AS character_count, 0.8::DOUBLE AS confidence
FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))""")
def text_blocks(spark, sf_dir):
    return R.text_blocks(S.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, substr(text, 1, 4000) AS head, substr(text, 1, 100) AS evidence, md5(substr(text, 1, 200)) AS md5_head, md5(text) AS md5 FROM documents")
def doc_truncate(spark, sf_dir):
    t = F.col("text")
    return S.table(spark, sf_dir, "documents").select("doc_id", F.substring(t, 1, 4000).alias("head"), F.substring(t, 1, 100).alias("evidence"), F.md5(F.substring(t, 1, 200).cast("binary")).alias("md5_head"), F.md5(t.cast("binary")).alias("md5"))


SPECIAL = "(contains(lower(t), 'conformity') OR contains(t, '✓') OR contains(t, 'Δ') OR contains(t, 'Ra'))"
MARKED = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '✓ ' || text WHEN 1 THEN text || ' ΔT Ra 0.8' WHEN 2 THEN 'Declaration of Conformity ' || text ELSE text END AS t FROM documents)"


@query(f"SELECT doc_id, {SPECIAL} AS is_special, md5(CASE WHEN {SPECIAL} THEN replace(replace(replace(t, '✓', '[CE_MARK]'), 'Δ', '[DELTA]'), 'Ra', '[ROUGHNESS_Ra]') ELSE t END) AS standardized FROM {MARKED}")
def symbol_standardize(spark, sf_dir):
    k, t = F.col("doc_id") % 4, F.col("text")
    marked = F.when(k == 0, F.concat(F.lit("✓ "), t)).when(k == 1, F.concat(t, F.lit(" ΔT Ra 0.8"))).when(k == 2, F.concat(F.lit("Declaration of Conformity "), t)).otherwise(t)
    d = S.table(spark, sf_dir, "documents").select("doc_id", marked.alias("t"))
    return d.select("doc_id", TX.special(F.col("t")).alias("is_special"), F.md5(TX.standardized(F.col("t")).cast("binary")).alias("standardized"))


@query(r"""SELECT conv_id AS doc_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS merged, min(turn) AS start_page, max(turn) AS end_page, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS word_count, string_agg(DISTINCT role, ',' ORDER BY role) AS languages FROM conversations GROUP BY conv_id""")
def cross_page_merge(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("text").alias("content"), F.col("role").alias("language"))
    return R.cross_page(c).select("doc_id", F.md5(F.col("merged_content").cast("binary")).alias("merged"), "start_page", "end_page", "word_count", "languages")


@query(r"""WITH r AS (SELECT doc_id, unnest(range(3)) AS pos FROM documents), p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM documents)
SELECT doc_id, pos, 'region_' || pos AS region_id, regexp_replace(regexp_replace(part, '^\s+', ''), '\s+$', '') AS extracted_text, len(list_filter(regexp_split_to_array(part, '\s+'), lambda w: w <> '')) AS word_count, 0.5::DOUBLE AS confidence
FROM (SELECT r.doc_id, pos, CASE WHEN pos < len(parts) THEN parts[pos + 1] ELSE 'Extraction failed' END AS part FROM r JOIN p USING (doc_id))""")
def fallback_text_extraction(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    regions = d.select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("pos")).withColumn("region_id", F.concat(F.lit("region_"), F.col("pos").cast("string")))
    return R.parts_for_regions(regions, d)


CLASS_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(s, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in L.CLASS_RULES) + " ELSE 'Other' END"


@query(f"SELECT doc_id, {CLASS_CASE} AS doc_class FROM (SELECT doc_id, lower(substr(coalesce(text, ''), 1, 4000)) AS s FROM documents)")
def doc_class_stub(spark, sf_dir):
    return L.classified(S.table(spark, sf_dir, "documents")).select("doc_id", "doc_class")


@query("""SELECT page_id, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) AS suffix, CASE WHEN page_id % 3 = 0 THEN 'pdf' ELSE 'image' END AS kind, 'page' || page_id AS stem, 'page' || page_id || '_page_' || printf('%03d', page_id) || '_original.png' AS page_name
FROM (SELECT page_id, '/in/page' || page_id || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' ELSE '.Jpeg' END AS name FROM pages)""")
def input_dispatch(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/page"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".png").otherwise(".Jpeg")).alias("name"))
    n = F.col("name")
    return p.select("page_id", TX.suffix(n).alias("suffix"), TX.input_kind(n).alias("kind"), TX.stem(n).alias("stem"), TX.page_name(TX.stem(n), F.col("page_id"), "original").alias("page_name"))


# Pixels

MEASURED = ("pixels", "measures")


@query(sql(*MEASURED, select=f"SELECT image_id, {rd('contrast brightness sharpness noise overall')} FROM measures"))
def pixel_quality(spark, sf_dir):
    return J.quality(S.pixels(spark, sf_dir)).select("image_id", *r6("contrast", "brightness", "sharpness", "noise", "overall"))


@query(sql(*MEASURED, select="SELECT image_id, round(noise, 6) AS noise FROM noisy"))
def pixel_noise(spark, sf_dir):
    return J.noise(S.pixels(spark, sf_dir)).select("image_id", *r6("noise"))


@query(sql(*MEASURED, select="""SELECT image_id, condition, severity, 0.8::DOUBLE AS confidence, action FROM (
SELECT image_id, 'low_contrast' AS condition, CASE WHEN contrast < 0.2 THEN 'severe' ELSE 'moderate' END AS severity, 'enhance_contrast' AS action FROM measures WHERE contrast < 0.4
UNION ALL SELECT image_id, 'dark_background', 'moderate', 'gamma_correction' FROM measures WHERE brightness < 0.3
UNION ALL SELECT image_id, 'blurry', 'moderate', 'sharpen' FROM measures WHERE sharpness < 0.3
UNION ALL SELECT image_id, 'poor_quality', 'moderate', 'denoise' FROM measures WHERE noise > 0.6)"""))
def quality_conditions(spark, sf_dir):
    q = J.quality(S.pixels(spark, sf_dir))
    found = q.select("image_id", F.explode(C.of_quality(*(F.col(c) for c in ("contrast", "brightness", "sharpness", "noise")))).alias("c"))
    return found.select("image_id", "c.condition", "c.severity", "c.confidence", F.col("c.actions")[0].alias("action"))


@query(sql("pixels", "profile", select="""SELECT image_id, greatest(count(*) FILTER (w > n // 10), 1) AS columns FROM (SELECT image_id, n, island, count(*) FILTER (NOT valley) AS w FROM (SELECT *, sum(valley::INT) OVER (PARTITION BY image_id ORDER BY x) AS island FROM (SELECT *, smooth < 0.3 * avg(smooth) OVER (PARTITION BY image_id) AS valley FROM profile)) GROUP BY ALL) WHERE TRUE GROUP BY image_id"""))
def column_count(spark, sf_dir):
    return J.column_count(S.pixels(spark, sf_dir))


@query(sql("pixels", "profile", select="SELECT image_id, x, round(smooth, 6) AS smooth FROM profile"))
def ink_profile(spark, sf_dir):
    return J.moving_average(J.ink_columns(S.pixels(spark, sf_dir))).select("image_id", "x", *r6("smooth"))


OTSU = """h AS (SELECT image_id, g, count(*) AS n FROM pixels GROUP BY ALL), s AS (SELECT image_id, g, sum(n) OVER a AS n0, sum(n * g) OVER a AS s0, sum(n) OVER b AS n, sum(n * g) OVER b AS s FROM h WINDOW a AS (PARTITION BY image_id ORDER BY g), b AS (PARTITION BY image_id)),
o AS (SELECT image_id, arg_max(g, (CASE WHEN n0 = n THEN 0.0 ELSE (s0 * n - s * n0)::DOUBLE * (s0 * n - s * n0)::DOUBLE / (n0::DOUBLE * (n - n0)::DOUBLE) END, -g)) AS threshold FROM s GROUP BY image_id)"""


@query(sql("pixels", select="").rstrip() + ",\n" + OTSU + " SELECT * FROM o")
def otsu_threshold(spark, sf_dir):
    return J.otsu(S.pixels(spark, sf_dir))


@query(sql("pixels", select="").rstrip() + ",\n" + OTSU + " SELECT image_id, y, x, CASE WHEN g > threshold THEN 255 ELSE 0 END AS g FROM pixels JOIN o USING (image_id)")
def binarize(spark, sf_dir):
    return J.binarized(S.pixels(spark, sf_dir))


@query(sql("pixels", select="").rstrip() + """, h AS (SELECT image_id, g, count(*) AS n FROM pixels GROUP BY ALL), c AS (SELECT image_id, g, sum(n) OVER (PARTITION BY image_id ORDER BY g) AS cdf, sum(n) OVER (PARTITION BY image_id) AS n FROM h), l AS (SELECT *, min(cdf) OVER (PARTITION BY image_id) AS low FROM c)
SELECT image_id, y, x, CASE WHEN n = low THEN g ELSE round_even((cdf - low) * 255::DOUBLE / (n - low), 0)::INT END AS g FROM pixels JOIN l USING (image_id, g)""")
def hist_equalize(spark, sf_dir):
    return J.equalized(S.pixels(spark, sf_dir)).select("image_id", "y", "x", "g")


@query(sql("pixels", select="SELECT image_id, y, x, floor(pow(g / 255::DOUBLE, 1::DOUBLE / 1.2::DOUBLE) * 255)::INT AS g FROM pixels"))
def gamma(spark, sf_dir):
    return J.gamma(S.pixels(spark, sf_dir))


@query(sql("pixels", select="SELECT image_id, x AS y, 7 - y AS x, g FROM pixels"))
def rotate90(spark, sf_dir):
    return J.rotated(S.pixels(spark, sf_dir), 90)


HALF_LAP = " + ".join(f"floor({t}.g / 2)::BIGINT" for t in "abcd") + " - 4 * floor(p.g / 2)::BIGINT"


@query(sql("pixels", "measures", select=f"""SELECT image_id, round(least(greatest(0.6 * ((c1 - c0) / greatest(c0, 1)) + 0.4 * ((l1 - l0) / greatest(l0, 1)) + 0.5, 0), 1), 6) AS improvement FROM
(SELECT image_id, sqrt({variance("g")}) AS c0, sqrt({variance("floor(g / 2)::BIGINT")}) AS c1 FROM pixels GROUP BY image_id) JOIN (SELECT image_id, laplacian AS l0 FROM sharp) USING (image_id) JOIN
(SELECT p.image_id, {variance(HALF_LAP)} AS l1 FROM pixels p
 JOIN pixels a ON a.image_id = p.image_id AND a.x = p.x AND a.y = abs(p.y - 1) JOIN pixels b ON b.image_id = p.image_id AND b.x = p.x AND b.y = CASE WHEN p.y = 7 THEN 6 ELSE p.y + 1 END
 JOIN pixels c ON c.image_id = p.image_id AND c.y = p.y AND c.x = abs(p.x - 1) JOIN pixels d ON d.image_id = p.image_id AND d.y = p.y AND d.x = CASE WHEN p.x = 7 THEN 6 ELSE p.x + 1 END GROUP BY p.image_id) USING (image_id)"""))
def quality_improvement(spark, sf_dir):
    p = S.pixels(spark, sf_dir)
    return J.improvement(p, p.withColumn("g", F.floor(F.col("g") / 2).cast("int"))).select("image_id", *r6("improvement"))


@query("""SELECT p_partkey, CASE WHEN greatest(w, h) > 4096 THEN trunc(w * (4096::DOUBLE / greatest(w, h)))::INT ELSE w END AS width, CASE WHEN greatest(w, h) > 4096 THEN trunc(h * (4096::DOUBLE / greatest(w, h)))::INT ELSE h END AS height, round(w::DOUBLE / h, 6) AS aspect
FROM (SELECT p_partkey, (p_size * 200)::INT AS w, (p_partkey % 5000 + 1)::INT AS h FROM part)""")
def resize_size(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 200).cast("int").alias("w"), (F.col("p_partkey") % 5000 + 1).cast("int").alias("h"))
    w, h = J.resized(F.col("w"), F.col("h"))
    return p.select("p_partkey", w.alias("width"), h.alias("height"), near(G.aspect(F.col("w"), F.col("h"))).alias("aspect"))


# Lines, rotation, skew


@query(sql("line_votes", select="""SELECT page_id, round(CASE WHEN s > 0 THEN bin * 5 - 87.5 ELSE 0 END::DOUBLE, 6) AS angle FROM (SELECT page_id, arg_max(bin, (w, -bin)) AS bin, sum(w) AS s FROM (SELECT page_id, least(floor((CASE WHEN deg > 90 THEN deg - 180 ELSE deg END + 90) / 5), 35) AS bin, sum(floor(abs(rho) * 10 / 64)) AS w FROM line_votes GROUP BY ALL) GROUP BY page_id)"""))
def edge_vote(spark, sf_dir):
    return J.edge_vote(S.line_votes(spark, sf_dir), F.lit(64)).select("page_id", *r6("angle"))


SKEW = """sk AS (SELECT page_id, coalesce(m, 0) AS angle, coalesce(least(least(greatest(1 - s / 10, 0), 1) + CASE WHEN abs(m) > 1 THEN 0.1 ELSE 0 END, 1), 0) AS confidence, n FROM (SELECT page_id, median(deg - 90) FILTER (abs(deg - 90) < 45) AS m, stddev_pop(deg - 90) FILTER (abs(deg - 90) < 45) AS s, count(*) FILTER (abs(deg - 90) < 45) AS n FROM line_votes GROUP BY page_id))"""


@query(sql("line_votes", select="").rstrip() + ",\n" + SKEW + " SELECT page_id, round(angle, 6) AS angle, round(confidence, 6) AS confidence, n FROM sk")
def skew_estimate(spark, sf_dir):
    return J.skew(S.line_votes(spark, sf_dir)).select("page_id", *r6("angle", "confidence"), "n")


TURN = """t AS (SELECT *, 0.7::DOUBLE * te + 0.3::DOUBLE * ed AS c FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 361 - 180)::DOUBLE AS te, (l_suppkey % 181 - 90)::DOUBLE AS ed, l_quantity / 25 AS asp FROM lineitem)),
a AS (SELECT *, CASE WHEN c BETWEEN -15 AND 15 THEN 0 WHEN c > 15 AND c <= 105 THEN 270 WHEN c >= -105 AND c < -15 THEN 90 ELSE 180 END AS angle, CASE WHEN c BETWEEN -15 AND 15 THEN 0.9 WHEN c > 15 AND c <= 75 THEN 0.85 WHEN c > 75 AND c <= 105 THEN 0.9 WHEN c >= -75 AND c < -15 THEN 0.85 WHEN c >= -105 AND c < -75 THEN 0.9 ELSE 0.8 END::DOUBLE AS base FROM t),
d AS (SELECT *, least(greatest(base + CASE WHEN (asp < 0.7::DOUBLE OR asp > 1.4::DOUBLE) AND angle IN (90, 270) THEN 0.05 ELSE 0 END + CASE WHEN abs(te - ed) < 15 THEN 0.05 WHEN abs(te - ed) > 45 THEN -0.1 ELSE 0 END, 0), 1) AS confidence FROM a)"""


def _turns(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    te, ed = (F.col("l_partkey") % 361 - 180).cast("double"), (F.col("l_suppkey") % 181 - 90).cast("double")
    angle, conf = C.rotation_decision(te, ed, F.col("l_quantity") / 25)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", angle.alias("angle"), conf.alias("confidence"))


@query("WITH " + TURN + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, angle, round(confidence, 6) AS confidence FROM d")
def rotation_decision(spark, sf_dir):
    return _turns(spark, sf_dir).withColumns({"confidence": near("confidence")})


@query("WITH " + TURN + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE angle WHEN 90 THEN 'rotated_90_ccw' WHEN 180 THEN 'rotated_180' ELSE 'rotated_90_cw' END AS condition, CASE WHEN angle = 180 THEN 'moderate' ELSE 'severe' END AS severity, CASE angle WHEN 90 THEN 'rotate_90_cw' WHEN 180 THEN 'rotate_180' ELSE 'rotate_90_ccw' END AS action FROM d WHERE angle <> 0 AND confidence >= 0.5""")
def rotation_conditions(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("c", C.of_rotation(F.col("angle"), F.col("confidence"))).where("c is not null")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c.condition", "c.severity", F.col("c.actions")[0].alias("action"))


UPRIGHT = SKEW.replace("FROM line_votes", "FROM upright_votes")


@query(sql("upright_votes", select="").rstrip() + ",\n" + UPRIGHT + " SELECT page_id, CASE WHEN abs(angle) >= 10 THEN 'severe' ELSE 'moderate' END AS severity, 'deskew' AS action FROM sk WHERE abs(angle) >= 2 AND confidence >= 0.5")
def skew_conditions(spark, sf_dir):
    s = J.skew(S.upright_votes(spark, sf_dir)).withColumn("c", C.of_skew(F.col("angle"), F.col("confidence"))).where("c is not null")
    return s.select("page_id", "c.severity", F.col("c.actions")[0].alias("action"))


PARTS = "(SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos, l_extendedprice AS area, l_quantity * 20 AS perimeter, l_quantity AS w, (l_suppkey % 40 + 1)::DOUBLE AS h, (l_partkey % 180 - 90)::DOUBLE AS deg FROM lineitem)"


def _parts(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(S.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    return li.select(F.col("l_orderkey").alias("page_id"), pos.alias("pos"), F.col("l_extendedprice").alias("area"), (F.col("l_quantity") * 20).alias("perimeter"), F.col("l_quantity").alias("w"), (F.col("l_suppkey") % 40 + 1).cast("double").alias("h"), (F.col("l_partkey") % 180 - 90).cast("double").alias("deg"))


USABLE = "area > 50 AND area < 20000 AND w / h > 0.1 AND w / h < 10"


@query(f"""SELECT page_id, round(coalesce(sum(f * area) FILTER (ok AND n <= 100) / sum(area) FILTER (ok AND n <= 100), 0), 6) AS angle FROM (SELECT *, {USABLE} AS ok, CASE WHEN deg > 45 THEN deg - 90 WHEN deg < -45 THEN deg + 90 ELSE deg END AS f, count(*) FILTER ({USABLE}) OVER (PARTITION BY page_id ORDER BY pos) AS n FROM {PARTS}) GROUP BY page_id""")
def text_orientation(spark, sf_dir):
    return J.text_orientation(_parts(spark, sf_dir)).select("page_id", *r6("angle"))


@query(f"""SELECT page_id, round(coalesce(score, 0), 6) AS score, coalesce(score > 0.3, FALSE) AS handwritten FROM (SELECT page_id, CASE WHEN count(*) FILTER (ok) > 0 THEN least(greatest(0.7 * avg(1 - 4 * pi() * area / (perimeter * perimeter)) FILTER (ok) + 0.3 * (1 - avg(least(w / h, 1 / (w / h))) FILTER (ok)), 0), 1) END AS score FROM (SELECT *, area > 20 AND area < 5000 AND perimeter > 0 AS ok FROM {PARTS}) GROUP BY page_id)""")
def handwriting_score(spark, sf_dir):
    return J.handwriting(_parts(spark, sf_dir)).select("page_id", *r6("score"), "handwritten")


@query(f"""SELECT page_id, CASE WHEN n = 0 OR m IS NULL THEN 'simple' WHEN n < 20 AND cv < 1 THEN 'simple' WHEN n < 100 AND cv < 2 THEN 'moderate' ELSE 'complex' END AS layout FROM (SELECT page_id, count(*) * 4 AS n, avg(area) FILTER (area > 100) AS m, coalesce(stddev_pop(area) FILTER (area > 100) / avg(area) FILTER (area > 100), 0) AS cv FROM {PARTS} GROUP BY page_id)""")
def layout_complexity(spark, sf_dir):
    big = F.when(F.col("area") > 100, F.col("area"))
    s = _parts(spark, sf_dir).groupBy("page_id").agg((F.count(F.lit(1)) * 4).alias("n"), F.avg(big).alias("m"), F.stddev_pop(big).alias("s"))
    return s.select("page_id", C.layout_complexity(F.col("n"), F.col("m"), F.col("s")).alias("layout"))


@query("""SELECT user_id, condition, severity, confidence FROM (
SELECT user_id, 'handwritten' AS condition, 'moderate' AS severity, round(a, 6) AS confidence FROM t WHERE a > 0.5 UNION ALL SELECT user_id, 'multi_column', 'mild', 0.8::DOUBLE FROM t WHERE n % 3 > 1 UNION ALL SELECT user_id, 'complex_layout', 'mild', 0.7::DOUBLE FROM t WHERE n % 2 = 0)
""".replace("FROM t", "FROM (SELECT user_id, count(*) AS n, (sum(event_id) % 100)::DOUBLE / 100 AS a FROM events GROUP BY user_id) t"))
def content_conditions(spark, sf_dir):
    t = S.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), ((F.sum("event_id") % 100).cast("double") / 100).alias("a"))
    layout = F.when(F.col("n") % 2 == 0, "complex").otherwise("simple")
    found = t.select("user_id", F.explode(C.of_content(F.col("a") > 0.5, F.col("a"), F.col("n") % 3, layout)).alias("c"))
    return found.select("user_id", "c.condition", "c.severity", near("c.confidence").alias("confidence"))


# Conditions and assessments


def _found(spark, sf_dir):
    return C.by_page(S.conditions(spark, sf_dir))


TURNED = f"condition IN ({', '.join(repr(r) for r in ROTATIONS)})"


@query(sql("conditions", select=f"""SELECT page_id, CASE WHEN sv > 0 THEN 'Poor' WHEN md > 0 THEN 'Fair' ELSE 'Good' END AS quality, CASE WHEN sv > 0 THEN 1 WHEN md > 2 THEN 2 WHEN md > 0 THEN 3 ELSE 4 END AS priority,
round(CASE WHEN tn THEN greatest(b, 0.6) ELSE b END, 6) AS success_rate, tn AS rotation_detected, sv + md AS n_primary, ml AS n_secondary
FROM (SELECT *, CASE WHEN sv > 0 THEN 0.4 WHEN md > 0 THEN 0.7 ELSE 0.9 END::DOUBLE AS b FROM (SELECT page_id, count(*) FILTER (severity = 'severe') AS sv, count(*) FILTER (severity = 'moderate') AS md, count(*) FILTER (severity = 'mild') AS ml, bool_or({TURNED}) AS tn FROM conditions GROUP BY page_id))"""))
def assessment_cv(spark, sf_dir):
    a = C.assessed(_found(spark, sf_dir))
    return a.select("page_id", "quality", "priority", near("success_rate").alias("success_rate"), "rotation_detected", F.size("primary_issues").cast("long").alias("n_primary"), F.size("secondary_issues").cast("long").alias("n_secondary"))


CV_GROUP = {k: v for k, v in ACTION_GROUP.items() if k not in ("straighten_perspective", "histogram_equalization")}


@query(sql("conditions", "actions", select=f"SELECT page_id, string_agg(action, ',' ORDER BY {case(CV_GROUP, 'action', 99)}, k) AS recommendations FROM once GROUP BY page_id"))
def cv_recommendations(spark, sf_dir):
    return C.assessed(_found(spark, sf_dir)).select("page_id", F.array_join("recommendations", ",").alias("recommendations"))


@query(sql("conditions", "actions", select=f"SELECT page_id, string_agg(action, ',' ORDER BY {case(ACTION_RANK, 'action', 99)}, action) AS by_rank, string_agg(action, ',' ORDER BY {case(ACTION_GROUP, 'action', 99)}, k) AS by_group FROM once GROUP BY page_id"))
def action_order(spark, sf_dir):
    a = C.all_actions(F.col("found"))
    return _found(spark, sf_dir).select("page_id", F.array_join(C.ranked_order(a), ",").alias("by_rank"), F.array_join(C.grouped_order(a), ",").alias("by_group"))


@query(sql("conditions", select=f"""SELECT page_id, round(greatest(0.25::DOUBLE, 1 - least(sum({case(SEVERITY_IMPACT, "severity", 0.2)}::DOUBLE * CASE WHEN is_primary THEN 1 ELSE 0.6 END::DOUBLE * {case(CONDITION_MODIFIER, "condition", 1.0)}::DOUBLE * confidence), 0.7)), 6) AS success_rate FROM conditions GROUP BY page_id"""))
def assessment_success_rate(spark, sf_dir):
    return _found(spark, sf_dir).select("page_id", near(C.success_rate(F.col("found"))).alias("success_rate"))


PRIORITY = f"""CASE WHEN count(*) FILTER (is_primary AND severity = 'critical') > 0 THEN 1 WHEN count(*) FILTER (is_primary AND (severity = 'severe' OR {TURNED})) > 0 THEN 2 WHEN count(*) FILTER (is_primary) > 2 THEN 3 WHEN count(*) FILTER (is_primary) > 0 THEN 4 ELSE 5 END"""


@query(sql("conditions", select=f"SELECT page_id, {PRIORITY} AS priority FROM conditions GROUP BY page_id"))
def assessment_priority(spark, sf_dir):
    return _found(spark, sf_dir).select("page_id", C.priority(F.col("found")).alias("priority"))


@query(sql("conditions", "actions", select=f"""SELECT page_id, n > 0 AND priority <= 3 AND success <= 0.8 AS process, CASE WHEN n > 6 THEN 'high' WHEN n > 3 THEN 'medium' ELSE 'low' END AS complexity FROM (SELECT page_id, {PRIORITY} AS priority, greatest(0.25::DOUBLE, 1 - least(sum({case(SEVERITY_IMPACT, "severity", 0.2)}::DOUBLE * CASE WHEN is_primary THEN 1 ELSE 0.6 END::DOUBLE * {case(CONDITION_MODIFIER, "condition", 1.0)}::DOUBLE * confidence), 0.7)) AS success FROM conditions GROUP BY page_id)
JOIN (SELECT page_id, count(*) AS n FROM once GROUP BY page_id) USING (page_id)"""))
def preprocess_gate(spark, sf_dir):
    e = C.enhanced(_found(spark, sf_dir))
    return e.select("page_id", C.worth_processing(F.col("recommendations"), F.col("priority"), F.col("success_rate")).alias("process"), "complexity")


@query(sql("conditions", select="SELECT condition, count(*) AS n FROM conditions WHERE is_primary GROUP BY condition"))
def common_issues(spark, sf_dir):
    return S.conditions(spark, sf_dir).where("is_primary").groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


@query(sql("conditions", "actions", select="SELECT action, count(*) AS n, count(*) FILTER (action IN ('rotate_90_cw', 'rotate_90_ccw', 'rotate_180', 'deskew')) AS rotations FROM once GROUP BY action"))
def preprocess_summary(spark, sf_dir):
    a = _found(spark, sf_dir).select(F.explode(C.all_actions(F.col("found"))).alias("action"))
    return a.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action").isin("rotate_90_cw", "rotate_90_ccw", "rotate_180", "deskew")).alias("rotations"))


NOTE_LIST = ", ".join(f"CASE WHEN bool_or(condition = '{n}') THEN '{note}' END" for n, note in NOTES.items())
NOTE_SQL = f"""list_filter([{NOTE_LIST}, '{TURN_NOTE}' || string_agg({case(TURN_NAMES, "condition")}, ', ' ORDER BY pos) FILTER ({TURNED}),
CASE WHEN count(*) FILTER (condition IN ('poor_quality', 'blurry', 'low_contrast', 'dark_background')) > 2 THEN '{QUALITY_NOTE}' END], lambda e: e IS NOT NULL)"""


@query(sql("conditions", select=f"SELECT page_id, CASE WHEN len(n) > 0 THEN array_to_string(n, '; ') END AS notes FROM (SELECT page_id, {NOTE_SQL} AS n FROM conditions GROUP BY page_id)"))
def special_notes(spark, sf_dir):
    return _found(spark, sf_dir).select("page_id", C.special_notes(F.col("found")).alias("notes"))


HITS = lambda ws: " + ".join(f"contains(lower(ev), '{w}')::INT" for w in ws)


@query(sql("conditions", select=f"""SELECT page_id, fixed AS was_repaired, string_agg(c2, ',' ORDER BY pos) FILTER (NOT is_turn OR turns <= 1 OR pos = best) AS conditions FROM (
SELECT *, count(*) FILTER (is_turn) OVER (PARTITION BY page_id) AS turns, first_value(pos) OVER (PARTITION BY page_id ORDER BY is_turn DESC, {case({"rotated_180": 0, "rotated_90_ccw": 1, "rotated_90_cw": 2, "skewed": 3}, "c2", 9)}, NOT is_primary, pos) AS best FROM (
SELECT *, CASE WHEN fixed AND condition IN ('rotated_90_cw', 'rotated_90_ccw') THEN 'rotated_180' ELSE condition END AS c2, condition IN ('rotated_90_cw', 'rotated_90_ccw', 'rotated_180', 'skewed') AS is_turn FROM conditions JOIN (
SELECT page_id, coalesce(NOT half AND (up >= 2 OR (up >= 1 AND flat >= 1)), FALSE) AS fixed FROM (SELECT page_id, half, {HITS(UPSIDE_DOWN)} AS up, {HITS(HORIZONTAL)} AS flat FROM (SELECT page_id, bool_or(condition = 'rotated_180') AS half, arg_max(evidence, pos) FILTER (condition IN ('rotated_90_cw', 'rotated_90_ccw')) AS ev FROM conditions GROUP BY page_id))) USING (page_id))) GROUP BY page_id, fixed"""))
def orientation_repair(spark, sf_dir):
    r = C.repaired(_found(spark, sf_dir))
    return r.select("page_id", "was_repaired", F.when(F.size("found") > 0, F.array_join(C.names(F.col("found")), ",")).alias("conditions"))


# Beyond SQL: kernels, providers


@query()
def kernel_actions(spark, sf_dir):
    """The action engine over every image, with each image's own list of actions."""
    from ..operators import kernels

    p = S.pixels(spark, sf_dir)
    lot = p.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "g"))), lambda s: F.lpad(F.hex(s["g"]), 2, "0")).alias("v"))
    names = F.array(*map(F.lit, sorted(kernels.KERNELS)))
    chosen = F.array_distinct(F.array(*[F.get(names, F.pmod(F.col("image_id") * k + k, F.lit(len(kernels.KERNELS))).cast("int")) for k in (1, 3, 5)]))
    images = lot.select("image_id", "height", "width", F.unhex(F.array_join("v", "")).alias("data"), C.grouped_order(chosen).alias("actions"))
    return kernels.apply_actions(images).select("image_id", "height", "width", F.md5("data").alias("md5"), F.array_join("applied", ",").alias("applied"), "success")


@query("SELECT page_id, 'model' AS source, CASE WHEN trim(html) <> '' THEN 1 ELSE 0 END AS total_regions FROM pages")
def offline_layout(spark, sf_dir):
    """Layout inference of every page by the offline provider, its answers parsed against the layout's schema."""
    from ..schemas import LAYOUT

    p = S.table(spark, sf_dir, "pages").select("page_id", "html")
    out = L.inferred(p, F.col("html"), LAYOUT)
    return out.select("page_id", "source", F.col("answer.total_regions").alias("total_regions"))


from . import catalog_flows, catalog_kernels, catalog_values  # noqa: E402, F401  their queries register themselves
