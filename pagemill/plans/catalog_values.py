"""Registered queries: values, constraints, file names, prompts and stand-ins, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import prompts
from ..operators import conditions as C
from ..operators import knowledge as N
from ..operators import models
from ..operators import regions as R
from ..schemas import FAILED_QUALITY, FALLBACK_TABLE, TYPE_COLOURS
from ..sources import files, sinks
from ..sources import tables as S
from .adapter_sql import sql
from .registry import near, query

EXPORTED = "(SELECT page_id, reading_order, region_type, CASE WHEN confidence = 0 THEN 0.0005 ELSE confidence / 7 END AS confidence FROM page_regions)"


@query(sql("page_regions", select=f"""SELECT '{{"page_id":' || page_id || ',"reading_order":' || reading_order || ',"region_type":"' || region_type || '","confidence":' || (round_even(confidence, 3)::DOUBLE)::VARCHAR || '}}' AS json FROM {EXPORTED}"""))
def export_rows(spark, sf_dir):
    p = S.page_regions(spark, sf_dir)
    some = F.when(F.col("confidence") == 0, 0.0005).otherwise(F.col("confidence") / 7)
    return sinks.export_rows(p.select("page_id", "reading_order", "region_type", some.alias("confidence")))


MODEL = {
    "confidence": ("l_discount * 12", "confidence BETWEEN 0 AND 1"), "page_number": ("l_linenumber - 2", "page_number >= 1"), "row": ("l_suppkey % 5 - 1", '"row" >= 0'), "col": ("l_partkey % 5 - 1", "col >= 0"),
    "rowspan": ("l_suppkey % 3", "rowspan >= 1"), "colspan": ("l_partkey % 3", "colspan >= 1"), "priority": ("l_suppkey % 8", "priority BETWEEN 1 AND 5"), "weight": ("l_tax - 0.02", "weight >= 0"),
    "width": ("l_quantity - 5", "width > 0"), "height": ("l_quantity - 45", "height > 0"),
}
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"SELECT {LINE}, array_to_string(list_filter([{', '.join(f'CASE WHEN NOT ({rule}) THEN {k!r} END' for k, (_, rule) in MODEL.items())}], lambda e: e IS NOT NULL), ',') AS errors FROM (SELECT {LINE}, " + ", ".join(f'{e} AS "{k}"' for k, (e, _) in MODEL.items()) + " FROM lineitem)")
def model_constraints(spark, sf_dir):
    """The value constraints of the document model over every line."""
    li = S.table(spark, sf_dir, "lineitem")
    d = li.select(*LINE.split(", "), *(F.expr(e).alias(k) for k, (e, _) in MODEL.items()))
    return R.checked(d, R.model_rules(d)).select(*LINE.split(", "), F.array_join("errors", ",").alias("errors"))


@query(sql("conditions", "actions", select="SELECT page_id, bool_or(action <> 'no_action' AND first) AS go FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY grp, k) = 1 AS first FROM (SELECT *, CASE action WHEN 'rotate_180' THEN 1 WHEN 'rotate_90_cw' THEN 1 WHEN 'rotate_90_ccw' THEN 1 WHEN 'deskew' THEN 2 WHEN 'crop_margins' THEN 3 WHEN 'remove_shadows' THEN 4 WHEN 'enhance_contrast' THEN 5 WHEN 'gamma_correction' THEN 5 WHEN 'denoise' THEN 6 WHEN 'sharpen' THEN 7 WHEN 'binarize' THEN 8 WHEN 'adaptive_threshold' THEN 8 ELSE 99 END AS grp FROM once)) GROUP BY page_id"))
def measured_gate(spark, sf_dir):
    """Whether a measured page is worked on: its first recommendation is an action."""
    a = C.assessed(C.by_page(S.conditions(spark, sf_dir)))
    return a.select("page_id", C.first_is_action(F.col("recommendations")).alias("go"))


@query(sql("detections", select="SELECT table_id, pos, CASE WHEN top - 22 < 0 THEN top + 10 ELSE top - 22 END AS label_y FROM (SELECT *, trunc(y * 100)::INT AS top FROM detections)"))
def detector_label(spark, sf_dir):
    d = S.detections(spark, sf_dir)
    return d.select("table_id", "pos", R.detector_label_top(G.pixels(F.col("y"), F.lit(100)), F.lit(12)).alias("label_y"))


@query(sql("detections", select="SELECT table_id, pos, score, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, pos) AS k FROM detections WHERE label_id = 0) WHERE k = 1"))
def best_table(spark, sf_dir):
    return models.best_table(S.detections(spark, sf_dir))


(H0, H1), (V0, V1) = FALLBACK_TABLE


@query(f"""SELECT p_partkey AS table_id, r AS "row", c AS col, CASE WHEN r = 0 THEN CASE WHEN c = 0 THEN '{H0}' ELSE '{H1}' END ELSE CASE WHEN c = 0 THEN '{V0}' ELSE '{V1}' END END AS content, CASE WHEN r = 0 THEN 'header' ELSE 'data' END AS cell_type, 0.3::DOUBLE AS confidence
FROM part, range(2) a(r), range(2) b(c)""")
def fallback_tables(spark, sf_dir):
    t = N.fallback_tables(S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("table_id")))
    return t.select("table_id", F.explode("cells").alias("c")).select("table_id", F.col("c.row").cast("long").alias("row"), F.col("c.col").cast("long").alias("col"), "c.content", "c.cell_type", "c.confidence")


@query(f"SELECT page_id, '{FAILED_QUALITY}' AS quality, 'poor_quality' AS issue, 'moderate' AS severity, 0.3::DOUBLE AS confidence, 3 AS priority, 0.5::DOUBLE AS success_rate, 'enhance_contrast,denoise,sharpen' AS recommendations FROM pages")
def fallback_assessment(spark, sf_dir):
    p = C.fallback(S.table(spark, sf_dir, "pages").select("page_id"))
    return p.withColumn("recommendations", F.array_join("recommendations", ","))


IMPACT = """greatest(0.25::DOUBLE, 1 - least(sum(CASE severity WHEN 'none' THEN 0.0 WHEN 'mild' THEN 0.03 WHEN 'moderate' THEN 0.12 WHEN 'severe' THEN 0.25 WHEN 'critical' THEN 0.45 ELSE 0.2 END::DOUBLE * CASE WHEN is_primary THEN 1 ELSE 0.6 END::DOUBLE
* CASE condition WHEN 'rotated_180' THEN 0.8 WHEN 'rotated_90_cw' THEN 0.8 WHEN 'rotated_90_ccw' THEN 0.8 WHEN 'skewed' THEN 0.9 WHEN 'handwritten' THEN 1.2 WHEN 'poor_quality' THEN 1.1 WHEN 'blurry' THEN 1.3 WHEN 'shadow_distortion' THEN 1.1 ELSE 1.0 END::DOUBLE * confidence), 0.7))"""


@query(sql("conditions", select=f"SELECT page_id, round({IMPACT} * 100, 6) AS percent, arg_max(condition, pos) FILTER (is_primary AND condition IN ('rotated_180', 'rotated_90_ccw', 'rotated_90_cw', 'skewed')) AS orientation FROM conditions GROUP BY page_id"))
def readable_assessment(spark, sf_dir):
    """Assessments for people: success in percent (compared before it is cut to one decimal) and the page's turn."""
    r = C.readable(C.enhanced(C.by_page(S.conditions(spark, sf_dir))))
    checked = F.abs(F.regexp_replace("success", "%$", "").cast("double") - F.col("success_rate") * 100) <= 0.05 + 1e-9
    return r.select("page_id", F.when(checked, near(F.col("success_rate") * 100)).alias("percent"), "orientation")


NOTED = "CASE WHEN event_id % 4 = 0 THEN 'note ' || event_id END"


def _responses(spark, sf_dir):
    """Saved responses with one table of one row each, from semantic_rows."""
    r = S.semantic_rows(spark, sf_dir)
    line = F.struct("row_header", "values", "single_value", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("row_notes"))
    page = F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("page_number")
    return r.select(page, F.col("event_id").alias("table_index"), F.struct(F.array(line).alias("data_relationships")).alias("table"))


SINGLE = "coalesce(single_value, '') <> '' AND len(ks) = 0"


@query(sql("semantic_rows", select=f"""SELECT 'page_' || event_id || '_table_' || event_id AS table_id, event_id AS page_number, 1 AS pos, row_header,
array_to_string(list_concat(CASE WHEN {SINGLE} THEN ['value=' || single_value] ELSE list_transform(list_zip(ks, vs), lambda z: z[1] || '=' || z[2]) END, CASE WHEN {NOTED} IS NULL THEN [] ELSE ['notes=' || {NOTED}] END), ';') AS data FROM semantic_rows"""))
def response_rows(spark, sf_dir):
    rows = N.response_rows(_responses(spark, sf_dir))
    return rows.withColumn("data", F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


@query(sql("semantic_rows", select=f"""SELECT 'page_' || event_id || '_table_' || event_id AS table_id, row_header || ' has ' || k || ' of ' || v AS sentence FROM (SELECT event_id, row_header, unnest(CASE WHEN {SINGLE} THEN ['value', 'notes'] ELSE list_append(ks, 'notes') END) AS k, unnest(CASE WHEN {SINGLE} THEN [single_value, {NOTED}] ELSE list_append(vs, {NOTED}) END) AS v FROM semantic_rows) WHERE v <> ''"""))
def response_triplets(spark, sf_dir):
    return N.rule_triplets_of_maps(N.response_rows(_responses(spark, sf_dir))).select("table_id", "sentence")


@query(sql("entity_mentions", select="SELECT entity_type, name, count(DISTINCT doc_id) AS documents FROM entity_mentions GROUP BY ALL"))
def ontology_instances(spark, sf_dir):
    return N.instances(S.entity_mentions(spark, sf_dir))


@query("SELECT o_orderkey, o_orderpriority AS subject, 'owns' AS predicate, o_orderstatus AS object, 0.8::DOUBLE AS entity_confidence, 0.8::DOUBLE AS confidence, 0 AS aliases, o_clerk_text AS sentence FROM (SELECT *, 'order ' || o_orderkey AS o_clerk_text FROM orders)")
def triplet_structs(spark, sf_dir):
    """Constructed triplets: the model's defaults."""
    o = S.table(spark, sf_dir, "orders")
    t = N.triplet(N.entity(F.col("o_orderpriority"), F.lit("concept")), F.lit("owns"), N.entity(F.col("o_orderstatus"), F.lit("other")), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.lit(1))
    d = o.select("o_orderkey", t.alias("t"))
    return d.select("o_orderkey", F.col("t.subject.name").alias("subject"), "t.predicate", F.col("t.object.name").alias("object"), F.col("t.object.confidence").alias("entity_confidence"), "t.confidence", F.size("t.subject.aliases").alias("aliases"), F.col("t.source_sentence").alias("sentence"))


@query("""SELECT user_id AS path, count(*) AS pages, CASE WHEN count(*) > 50 THEN 'too many pages' ELSE '' END AS errors FROM events GROUP BY user_id""")
def pdf_page_counts(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    pages = e.select(F.col("user_id").alias("path"), F.row_number().over(S.Window.partitionBy("user_id").orderBy("event_id")).alias("page_number"))
    return files.pdf_errors(pages).select("path", F.col("pages").cast("long").alias("pages"), F.array_join("errors", ",").alias("errors"))


@query("SELECT conv_id AS document, md5(string_agg(t, chr(10) || chr(10) ORDER BY p)) AS text FROM (SELECT conv_id, turn // 2 AS p, string_agg(text, chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def recognized_texts(spark, sf_dir):
    """Recognised lines -> page texts -> document texts."""
    c = S.table(spark, sf_dir, "conversations")
    lines = c.select(F.col("conv_id").alias("document"), F.floor(F.col("turn") / 2).alias("page_number"), F.col("turn").alias("line_number"), "text")
    return files.document_texts(files.recognized(lines)).withColumn("text", F.md5(F.col("text").cast("binary")))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("SELECT page_id, md5(printf(" + _sql(prompts.REGIONS) + ", page_id, 1448, 2048)) AS regions, md5(printf(" + _sql(prompts.CONDITION) + ", 1448, 2048, 'RGB')) AS condition, md5(printf(" + _sql(prompts.TEXT) + ", 'region_' || page_id || ', region_0')) AS texts, md5(" + _sql(prompts.TABLE) + ") AS tables, md5(" + _sql(prompts.CONTENT) + ") AS content FROM pages")
def prompt_texts(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages").select("page_id")
    ids = F.array(F.concat(F.lit("region_"), F.col("page_id").cast("string")), F.lit("region_0"))
    asked = {"regions": prompts.regions(F.col("page_id"), F.lit(1448), F.lit(2048)), "condition": prompts.condition(F.lit(1448), F.lit(2048), F.lit("RGB")), "texts": prompts.region_text(ids), "tables": prompts.table(), "content": prompts.content()}
    return p.select("page_id", *(F.md5(c.cast("binary")).alias(k) for k, c in asked.items()))


@query(sql("detections", select="SELECT table_id, pos, w * h * 100 > 4 AS is_large, round(w / h, 6) AS aspect FROM detections"))
def box_shape(spark, sf_dir):
    d = S.detections(spark, sf_dir)
    return d.select("table_id", "pos", G.large(F.col("w"), F.col("h"), 4).alias("is_large"), near(G.aspect(F.col("w"), F.col("h"))).alias("aspect"))


BOXES = "(SELECT *, 20 AS px, trunc((reading_order % 20)::DOUBLE / 32 * 400)::INT AS py, 100 AS pw, 12 AS ph FROM page_regions)"
STYLED = f"""SELECT page_id, reading_order, s AS style, CASE WHEN s = 'confidence_heatmap' THEN greatest(1, trunc(3 * confidence)::INT) ELSE 3 END AS line_width, CASE WHEN s = 'detailed' THEN region_type || '_' || (reading_order - 1) || ' | ' || printf('%.2f', confidence) END AS label,
CASE WHEN s = 'detailed' THEN px + pw // 2 END AS order_x, CASE WHEN s = 'detailed' THEN py + ph // 2 END AS order_y, CASE WHEN s = 'confidence_heatmap' AND confidence > 0.7 THEN py + ph - 2 END AS inner_bottom FROM {BOXES}, (SELECT unnest(['minimal', 'detailed', 'confidence_heatmap']) AS s)"""


@query(sql("page_regions", select=STYLED))
def draw_styles(spark, sf_dir):
    p = S.page_regions(spark, sf_dir).withColumns({"pos": F.col("reading_order") - 1, "x": F.lit(0.1), "y": (F.col("reading_order") % 20).cast("double") / 32, "w": F.lit(0.5), "h": F.lit(0.03125)})
    parts = [R.drawn(p, 200, 400, TYPE_COLOURS, s).select("page_id", "reading_order", F.lit(s).alias("style"), "line_width", "label", "order_x", "order_y", F.col("inner.bottom").alias("inner_bottom")) for s in R.STYLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
