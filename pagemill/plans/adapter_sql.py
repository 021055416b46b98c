"""The adapters of sources/tables.py as DuckDB common table expressions, for the oracles."""

from __future__ import annotations

from ..schemas import CONDITIONS, SEVERITIES
from ..sources.tables import ACTION_OF_CONDITION, ENTITY_OF_SEGMENT, EVIDENCE, REGION_OF_TAG


def quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def case(values: dict, key: str, default="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {key} = {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {default} END"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def variance(x: str) -> str:
    n, s, q = f"count({x})::DOUBLE", f"sum({x})::DOUBLE", f"sum(({x}) * ({x}))::DOUBLE"
    return f"(({n} * {q} - {s} * {s}) / ({n} * {n}))"


LINE_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

CTES = {
    "pixels": """pixels AS (SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x,
        least(greatest(floor(14::DOUBLE * (label + 1) + 20::DOUBLE * (1 + 10 * (vec_id % 5)) * v::DOUBLE), 0), 255)::INT AS g
        FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings))""",
    "detections": f"""detections AS (SELECT l_partkey AS table_id, row_number() OVER (PARTITION BY l_partkey ORDER BY {LINE_ORDER}) AS pos, (l_suppkey % 6)::INT AS label_id,
        0.5::DOUBLE + 5::DOUBLE * l_discount AS score, (l_orderkey % 70)::DOUBLE / 100 AS x, (l_suppkey % 90)::DOUBLE / 100 AS y,
        (trunc(l_quantity)::BIGINT % 30 + 1)::DOUBLE / 100 AS w, (trunc(l_quantity)::BIGINT % 20 + 1)::DOUBLE / 100 AS h FROM lineitem)""",
    "parsed": """parsed AS (SELECT *, CASE label_id WHEN 0 THEN 'table' WHEN 1 THEN 'table column' WHEN 2 THEN 'table row' WHEN 3 THEN 'table column header' WHEN 4 THEN 'table projected row header' WHEN 5 THEN 'table spanning cell' ELSE 'unknown' END AS label,
        CASE WHEN label_id = 1 THEN 'column' WHEN label_id = 2 THEN 'row' WHEN label_id IN (3, 4) THEN 'header' WHEN label_id = 5 THEN 'span' END AS kind FROM detections WHERE score > 0.7)""",
    "lines": """lines AS (SELECT table_id, kind, row_number() OVER (PARTITION BY table_id, kind ORDER BY CASE WHEN kind = 'row' THEN y ELSE x END, pos) - 1 AS idx, pos, x, y, w, h FROM parsed WHERE kind IN ('row', 'column'))""",
    "grid": """grid AS (SELECT table_id, count(*) FILTER (kind = 'row') AS n_rows, count(*) FILTER (kind = 'column') AS n_cols, count(*) FILTER (kind = 'header') AS n_headers, count(*) FILTER (kind = 'span') > 0 AS has_spans,
        coalesce(avg(score) FILTER (kind IS NOT NULL), 0.5) AS structure_confidence FROM parsed GROUP BY table_id)""",
    "grid_cells": """grid_cells AS (SELECT r.table_id, r.idx AS "row", c.idx AS col, c.x, r.y, c.w, r.h, CASE WHEN n_headers > 0 AND r.idx <= 1 THEN 'header' ELSE 'data' END AS cell_type
        FROM lines r JOIN lines c ON r.table_id = c.table_id AND r.kind = 'row' AND c.kind = 'column' JOIN grid g ON g.table_id = r.table_id)""",
    "spanned": """hit AS (SELECT s.table_id, s.pos AS span, s.score, c."row", c.col FROM parsed s JOIN grid_cells c ON s.table_id = c.table_id AND s.kind = 'span'
        WHERE NOT (s.x + s.w <= c.x OR c.x + c.w <= s.x OR s.y + s.h <= c.y OR c.y + c.h <= s.y)),
    extent AS (SELECT table_id, span, score, min("row" * 100000 + col) AS main, max("row") - min("row") + 1 AS rs, max(col) - min(col) + 1 AS cs FROM hit GROUP BY ALL),
    marked AS (SELECT h.table_id, h.span, h."row", h.col, e.score, e.main, e.rs, e.cs, e.main = h."row" * 100000 + h.col AS is_main FROM hit h JOIN extent e USING (table_id, span)),
    last AS (SELECT table_id, "row", col, max_by(CASE WHEN is_main THEN 'merged' ELSE 'empty' END, span) AS kind, max_by(rs, span) FILTER (is_main) AS rs, max_by(cs, span) FILTER (is_main) AS cs, max_by(score, span) FILTER (is_main) AS score, max_by(main, span) FILTER (NOT is_main) AS span_main FROM marked GROUP BY ALL),
    spanned AS (SELECT c.table_id, c."row", c.col, coalesce(rs, 1) AS rowspan, coalesce(cs, 1) AS colspan, coalesce(kind, cell_type) AS cell_type, coalesce(score, 0.8::DOUBLE) AS confidence, span_main FROM grid_cells c LEFT JOIN last USING (table_id, "row", col))""",
    "records": """records AS (SELECT table_id, greatest(n_rows, 1) AS rows, greatest(n_cols, 1) AS cols, n_headers, has_spans, structure_confidence FROM grid)""",
    "kv_rows": """kv_rows AS (SELECT p_brand AS table_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, p_name AS row_header, p_type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS p_size FROM part)""",
    "semantic_rows": """semantic_rows AS (SELECT event_id, event_type AS row_header, CASE WHEN event_id % 2 = 1 THEN json_keys(props) ELSE [] END AS ks, CASE WHEN event_id % 2 = 1 THEN list_transform(json_keys(props), lambda k: json_extract_string(props, '$.' || k)) ELSE [] END AS vs, CASE WHEN event_id % 3 <> 0 THEN user_id::VARCHAR END AS single_value FROM events)""",
    "entity_mentions": f"""entity_mentions AS (SELECT c_nationkey AS doc_id, c_custkey AS pos, c_name AS name, {case(ENTITY_OF_SEGMENT, "c_mktsegment", "'other'")} AS entity_type FROM customer WHERE c_acctbal > 0
        UNION ALL SELECT c_nationkey, c_custkey + 1000000000, c_name, 'event' FROM customer WHERE c_acctbal > 0 AND c_custkey % 7 = 0)""",
    "relation_mentions": """relation_mentions AS (SELECT c_nationkey AS doc_id, o_orderkey AS pos, c_name AS subject_name, CASE WHEN o_totalprice > 100000 THEN 'owns' ELSE 'related_to' END AS predicate, n_name AS object_name, o_orderpriority AS evidence
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "triplets": """known AS (SELECT doc_id, name, max_by(entity_type, pos) AS entity_type FROM entity_mentions GROUP BY doc_id, name),
    ends AS (SELECT doc_id, subject_name AS name, pos, evidence FROM relation_mentions UNION ALL SELECT doc_id, object_name, pos, evidence FROM relation_mentions),
    missing AS (SELECT doc_id, name, min(pos) AS first_pos, min_by(evidence, pos) AS evidence FROM ends ANTI JOIN known USING (doc_id, name) GROUP BY doc_id, name),
    named AS (SELECT doc_id, name, entity_type, FALSE AS auto, NULL AS source FROM known UNION ALL SELECT doc_id, name, 'other', TRUE, evidence FROM missing),
    triplets AS (SELECT r.doc_id, r.pos, subject_name, s.entity_type AS subject_type, s.auto AS subject_auto, predicate, object_name, o.entity_type AS object_type, o.auto AS object_auto, coalesce(s.source, o.source) AS auto_source,
        max(CASE WHEN s.auto OR o.auto THEN 1 ELSE 0 END) OVER (PARTITION BY r.doc_id ORDER BY r.pos ROWS UNBOUNDED PRECEDING) = 1 AS has_auto_created
        FROM relation_mentions r JOIN named s ON s.doc_id = r.doc_id AND s.name = subject_name JOIN named o ON o.doc_id = r.doc_id AND o.name = object_name)""",
    "page_regions": f"""page_regions AS (SELECT page_id, i + 1 AS reading_order, {case(REGION_OF_TAG, "tag")} AS region_type, ((i * 7 + page_id) % 101)::DOUBLE / 100 AS confidence
        FROM (SELECT page_id, unnest(range(len(tags))) AS i, unnest(tags) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<(title|h1|p|li|footer|nav)[ >]', 1) AS tags FROM pages)))""",
    "line_votes": """line_votes AS (SELECT vec_id AS page_id, pos, v * 100 AS rho, ((floor((v + 1) * 900)::BIGINT % 180 + 180) % 180)::DOUBLE AS deg FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings))""",
    "cells": f"""body AS (SELECT l_partkey AS table_id, row_number() OVER (PARTITION BY l_partkey ORDER BY {LINE_ORDER}) AS "row", [l_returnflag, CASE WHEN l_suppkey % 5 <> 0 THEN ' ' || l_linestatus || chr(10) END, CASE WHEN l_linenumber % 3 = 0 THEN '●' END, l_linenumber::VARCHAR] AS texts FROM lineitem),
    plain AS (SELECT table_id, "row", unnest(range(4)) AS col, unnest(texts) AS text FROM body UNION ALL SELECT table_id, 0, unnest(range(4)), unnest(['flag', 'status', 'option', 'option']) FROM (SELECT DISTINCT l_partkey AS table_id FROM lineitem)),
    cells AS (SELECT *, CASE WHEN "row" > 0 AND "row" % 7 = 0 AND col = 0 THEN 2 ELSE 1 END AS rowspan, CASE WHEN "row" > 0 AND "row" % 11 = 0 AND col = 1 THEN 2 ELSE 1 END AS colspan FROM plain)""",
    "filled": """filled AS (SELECT table_id, r AS "row", c AS col, max_by(text_or, k) AS t FROM (SELECT table_id, "row" * 1000 + col AS k, {'t': text} AS text_or, r, unnest(range(col, col + colspan)) AS c FROM (SELECT *, unnest(range("row", "row" + rowspan)) AS r FROM cells)) GROUP BY ALL)""",
    "conditions": f"""conditions AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos,
        {listed(CONDITIONS)}[l_suppkey % {len(CONDITIONS)} + 1] AS condition, {listed(SEVERITIES)}[l_partkey % 5 + 1] AS severity, 0.5::DOUBLE + 4::DOUBLE * l_discount AS confidence, l_linenumber % 2 = 1 AS is_primary,
        {listed(EVIDENCE)}[l_suppkey % 5 + 1] AS evidence, {case(ACTION_OF_CONDITION, f"{listed(CONDITIONS)}[l_suppkey % {len(CONDITIONS)} + 1]", "'no_action'")} AS own_action, l_partkey % 3 = 0 AS more FROM lineitem)""",
    "actions": """actions AS (SELECT page_id, pos * 2 AS k, own_action AS action FROM conditions UNION ALL SELECT page_id, pos * 2 + 1, 'binarize' FROM conditions WHERE more),
    once AS (SELECT page_id, action, min(k) AS k FROM actions GROUP BY ALL)""",
    "measures": f"""sized AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY image_id),
    lap AS (SELECT p.image_id, a.g + b.g + c.g + d.g - 4 * p.g AS lap FROM pixels p JOIN sized s USING (image_id)
        JOIN pixels a ON a.image_id = p.image_id AND a.x = p.x AND a.y = CASE WHEN p.y = 0 THEN 1 ELSE p.y - 1 END JOIN pixels b ON b.image_id = p.image_id AND b.x = p.x AND b.y = CASE WHEN p.y = h - 1 THEN h - 2 ELSE p.y + 1 END
        JOIN pixels c ON c.image_id = p.image_id AND c.y = p.y AND c.x = CASE WHEN p.x = 0 THEN 1 ELSE p.x - 1 END JOIN pixels d ON d.image_id = p.image_id AND d.y = p.y AND d.x = CASE WHEN p.x = w - 1 THEN w - 2 ELSE p.x + 1 END),
    sharp AS (SELECT image_id, {variance('lap')} AS laplacian, least({variance('lap')} / 1000, 1.0) AS sharpness FROM lap GROUP BY image_id),
    med AS (SELECT p.image_id, p.y, p.x, p.g, median(q.g) AS m FROM pixels p JOIN sized s USING (image_id), unnest(range(-2, 3)) dy(dy), unnest(range(-2, 3)) dx(dx) JOIN pixels q ON q.image_id = p.image_id AND q.y = greatest(0, least(p.y + dy, h - 1)) AND q.x = greatest(0, least(p.x + dx, w - 1)) GROUP BY ALL),
    noisy AS (SELECT image_id, least(avg(abs(g - m)) / 20, 1.0) AS noise FROM med GROUP BY image_id),
    basic AS (SELECT image_id, least(sqrt({variance('g')}) / 80, 1.0) AS contrast, CASE WHEN avg(g) < 120 THEN avg(g) / 120 WHEN avg(g) > 200 THEN greatest(0.0, 1 - (avg(g) - 200) / 55) ELSE 1.0 END AS brightness FROM pixels GROUP BY image_id),
    measures AS (SELECT image_id, contrast, brightness, sharpness, noise, 0.3 * contrast + 0.2 * brightness + 0.3 * sharpness + 0.2 * (1 - noise) AS overall FROM basic JOIN sharp USING (image_id) JOIN noisy USING (image_id))""",
    "profile": """ink AS (SELECT image_id, x, count(*) FILTER (g < 128) AS ink FROM pixels GROUP BY ALL),
    profile AS (SELECT a.image_id, a.x, a.n, sum(b.ink)::DOUBLE / a.k AS smooth FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, greatest(5, least(20, count(*) OVER (PARTITION BY image_id) // 50)) AS k FROM ink) a
        JOIN ink b ON a.image_id = b.image_id AND b.x BETWEEN a.x - a.k // 2 AND a.x + (a.k - 1) // 2 GROUP BY a.image_id, a.x, a.n, a.k)""",
}


CTES["upright_votes"] = CTES["line_votes"] + """,
    upright_votes AS (SELECT page_id, pos, rho, 88::DOUBLE + deg % 17 AS deg FROM line_votes)"""
CTES["sparse"] = CTES["cells"] + """,
    sparse AS (SELECT table_id, "row", col, CASE WHEN col = 0 OR "row" % 2 = 0 THEN text END AS text FROM cells)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(CTES[c] for c in ctes) + "\n" + select
