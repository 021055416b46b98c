"""Operators on small literal fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions import geometry as G
from pagemill.functions import text as TX
from pagemill.operators import conditions as C
from pagemill.operators import grids as M
from pagemill.operators import inference as L
from pagemill.operators import kernels as K
from pagemill.operators import knowledge as N
from pagemill.operators import pixels as J
from pagemill.operators import regions as R


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("text,edge,aspect,angle,conf", [
    (0.0, 0.0, 1.0, 0, 0.95), (40.0, 40.0, 1.0, 270, 0.9), (-40.0, -40.0, 0.5, 90, 0.95), (90.0, 90.0, 1.0, 270, 0.95), (-90.0, -90.0, 1.0, 90, 0.95), (130.0, 130.0, 1.0, 180, 0.85), (-150.0, -80.0, 1.0, 180, 0.7),
])
def test_rotation_decision(spark, text, edge, aspect, angle, conf):
    a, c = C.rotation_decision(F.lit(text), F.lit(edge), F.lit(aspect))
    row = one(spark, a.alias("a"), c.alias("c"))
    assert row.a == angle and row.c == pytest.approx(conf)


def test_conditions_of_measures(spark):
    row = one(spark, C.of_rotation(F.lit(180), F.lit(0.8)).alias("r"), C.of_rotation(F.lit(90), F.lit(0.4)).alias("n"), C.of_skew(F.lit(-12.0), F.lit(0.6)).alias("s"), C.of_quality(F.lit(0.1), F.lit(0.2), F.lit(0.9), F.lit(0.7)).alias("q"), C.of_content(F.lit(True), F.lit(0.4), F.lit(2), F.lit("complex")).alias("c"))
    assert (row.r.condition, row.r.severity, row.r.actions) == ("rotated_180", "moderate", ["rotate_180"])
    assert row.n is None and row.s.severity == "severe"
    assert [(c.condition, c.severity) for c in row.q] == [("low_contrast", "severe"), ("dark_background", "moderate"), ("poor_quality", "moderate")]
    assert [c.condition for c in row.c] == ["handwritten", "multi_column", "complex_layout"]


def found(spark, rows):
    full = [(1, i, c, s, p, pr, e, [a]) for i, (c, s, p, pr, e, a) in enumerate(rows, 1)]
    return C.by_page(spark.createDataFrame(full, "page_id long, pos int, condition string, severity string, confidence double, is_primary boolean, evidence string, actions array<string>"))


def test_repair_keeps_the_half_turn_beside_a_skew(spark):
    f = found(spark, [("skewed", "mild", 0.6, True, "tilt", "deskew"), ("rotated_90_cw", "severe", 0.85, True, "Header at the BOTTOM, text line", "rotate_90_ccw")])
    row = C.repaired(f).first()
    assert row.was_repaired and [(c.condition, c.actions) for c in row.found] == [("rotated_180", ["rotate_180"])]
    assert row.found[0].confidence == pytest.approx(0.9)
    kept = C.repaired(found(spark, [("rotated_90_cw", "mild", 0.5, True, "header", "rotate_90_ccw")])).first()
    assert not kept.was_repaired and kept.found[0].condition == "rotated_90_cw"


def test_assessments(spark):
    none = spark.createDataFrame([(1, [])], found(spark, []).schema)
    row = C.assessed(none).first()
    assert (row.quality, row.priority, row.success_rate, row.recommendations, row.notes) == ("Good", 5, 0.9, ["no_action"], schemas.GOOD_NOTE)
    f = found(spark, [("rotated_180", "severe", 0.9, True, "", "rotate_180"), ("blurry", "moderate", 0.8, False, "", "sharpen"), ("blurry", "mild", 0.5, False, "", "sharpen")])
    row = C.assessed(f).first()
    assert (row.quality, row.priority, row.success_rate, row.recommendations) == ("Poor", 1, 0.6, ["rotate_180", "sharpen"])
    row = C.enhanced(f).first()
    impact = 0.25 * 0.8 * 0.9 + 0.12 * 0.6 * 1.3 * 0.8 + 0.03 * 0.6 * 1.3 * 0.5
    assert row.success_rate == pytest.approx(1 - impact) and row.priority == 2 and row.complexity == "low"
    order = one(spark, C.grouped_order(F.array(*map(F.lit, ["binarize", "unknown", "sharpen", "rotate_180", "sharpen"]))).alias("g"), C.ranked_order(F.array(*map(F.lit, ["binarize", "rotate_90_cw", "rotate_180", "rotate_90_ccw"]))).alias("r"))
    assert order.g == ["rotate_180", "sharpen", "binarize", "unknown"] and order.r == ["rotate_180", "rotate_90_ccw", "rotate_90_cw", "binarize"]
    assert C.fallback(none).first().priority == 3
    row = C.readable(C.enhanced(f)).first()
    assert row.success == f"{(1 - impact) * 100:.1f}%" and row.orientation == "rotated_180"


def test_table_grid_with_spans(spark):
    rows = [("t", 1, 2, 0.9, 0.0, 0.0, 1.0, 0.2), ("t", 2, 2, 0.9, 0.0, 0.2, 1.0, 0.2), ("t", 3, 1, 0.9, 0.0, 0.0, 0.5, 0.4), ("t", 4, 1, 0.9, 0.5, 0.0, 0.5, 0.4), ("t", 5, 3, 0.8, 0.0, 0.0, 0.45, 0.2), ("t", 6, 5, 0.75, 0.0, 0.0, 0.6, 0.1), ("t", 7, 5, 0.95, 0.6, 0.0, 0.1, 0.4), ("t", 8, 2, 0.5, 0, 0.9, 1, 0.1)]
    rows = [tuple(map(lambda v: float(v) if isinstance(v, int) and i > 2 else v, r)) for r in rows for i in [3]]
    d = spark.createDataFrame([(r[0], int(r[1]), int(r[2]), float(r[3]), *map(float, r[4:])) for r in rows], "table_id string, pos int, label_id int, score double, x double, y double, w double, h double")
    p = M.parsed(d)
    cells = {(r.row, r.col): (r.rowspan, r.colspan, r.cell_type, r.confidence, r.span_main) for r in M.spanned(p).collect()}
    assert cells == {(0, 0): (1, 2, "merged", 0.75, None), (0, 1): (2, 1, "merged", 0.95, (0, 0)), (1, 0): (1, 1, "header", 0.8, None), (1, 1): (1, 1, "empty", 0.8, (0, 1))}
    s = M.summary(p).first()
    assert (s.dimensions, s.total_cells, s.header_cells, s.merged_cells, s.has_multi_level_headers) == ("2x2", 4, 1, 2, True)
    assert M.headers(p).first().columns == [0, 1, 2, 3, 4]
    assert [r.header for r in M.placeholder_headers(p).orderBy("col").collect()] == ["Column_1", "Column_2"]


def test_structured_rows(spark):
    rows = [("t", 0, 0, None, 1, 1), ("t", 1, 0, "a", 1, 1), ("t", 1, 1, "a", 1, 1), ("t", 1, 2, "b", 1, 1), ("t", 2, 0, "x", 2, 1), ("t", 2, 1, "y", 1, 2), ("t", 4, 0, None, 1, 1)]
    c = spark.createDataFrame(rows, "table_id string, row int, col int, text string, rowspan int, colspan int")
    assert [(r.row, r["values"]) for r in M.structured(c).orderBy("row").collect()] == [(2, {"a": "y", "b": "y"}), (3, {"a": "", "b": ""})]
    assert M.header_rows(c).first().header_row == 1


def test_triplets(spark):
    e = spark.createDataFrame([(1, 1, "A", "person"), (1, 2, "A", "product"), (1, 3, "B", "event")], "doc_id int, pos int, name string, entity_type string")
    r = spark.createDataFrame([(1, 1, "A", "owns", "B", "e1"), (1, 2, "A", "owns", "C", "e2"), (1, 3, "C", "owns", "B", "e3")], "doc_id int, pos int, subject_name string, predicate string, object_name string, evidence string")
    got = [(t.pos, t.subject_type, t.object_type, t.auto_source, t.has_auto_created) for t in N.resolved(e, r).orderBy("pos").collect()]
    assert got == [(1, "product", "event", None, False), (2, "product", "other", "e2", True), (3, "other", "event", "e2", True)]
    rows = spark.createDataFrame([("t", 1, None, "v", None), ("t", 2, "h", "", "w"), ("t", 4, "x", "y", "z")], "table_id string, pos int, row_header string, a string, b string")
    assert {(t.subject, t.object, t.sentence) for t in N.rule_triplets(rows, ["a", "b"]).collect()} == {("parameter_0", "v", "parameter_0 has a of v"), ("h", "w", "h has b of w")}


def test_semantic_rows(spark):
    rows = spark.createDataFrame([(1, "h", {}, "7"), (2, "h", {"a": None, "b": "2"}, "7"), (3, "h", None, None)], "id int, row_header string, values map<string,string>, single_value string")
    got = sorted((r.id, r.col, r.content) for r in N.semantic_cells(rows).collect())
    assert got == [(1, 0, "h"), (1, 1, "7"), (2, 0, "h"), (2, 1, ""), (2, 2, "2"), (3, 0, "h")]


def test_text_and_boxes(spark):
    row = one(spark, TX.standardized(F.lit("✓ Ra")).alias("s"), TX.standardized(F.lit("plain")).alias("p"), TX.cell_text(F.lit(" a\nb ")).alias("c"), TX.confidence_level(F.lit(0.8)).alias("l"), TX.stem(F.lit("/x/a.b.pdf")).alias("t"))
    assert tuple(row) == ("[CE_MARK] [ROUGHNESS_Ra]", "plain", "a b", "high", "a.b")
    box = G.clamped_box(*(F.lit(x) for x in (1.5, -0.2, 0.0, 2.0)), F.lit(10), F.lit(20))
    assert tuple(one(spark, *box.values())) == (9, 0, 1, 20)
    rel = G.relative_box(*(F.lit(x) for x in (1.0, 2.0, 3.0, 6.0, 0.0, 10.0)))
    assert tuple(one(spark, *rel.values())) == (None, 0.2, None, 0.4)
    with pytest.raises(Exception, match="unsupported input"):
        one(spark, TX.input_kind(F.lit("a.tif")))


def test_split_valid_and_summaries(spark):
    d = spark.createDataFrame([(0.5, 1), (1.5, 1), (None, 0)], "confidence double, page_number int")
    good, bad = R.split_valid(d, R.model_rules(d))
    assert good.count() == 1 and sorted(map(str, (r.errors for r in bad.collect()))) == ["['confidence', 'page_number']", "['confidence']"]
    empty = spark.createDataFrame([], "page_number int, rows int, cols int, confidence double, error string")
    assert R.table_summary(empty).first().avg_confidence == 0.0
    hist = R.confidence_histogram(spark.createDataFrame([(1.0,), (0.0,), (0.6,)], "confidence double"))
    assert [r.n for r in hist.orderBy("bin").collect()] == [1, 0, 0, 1, 1]


def image(spark, arrays):
    rows = [(i, y, x, int(g)) for i, a in enumerate(arrays) for (y, x), g in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id int, y int, x int, g int")


def back(df, i, shape):
    a = np.zeros(shape, int)
    for r in df.where(F.col("image_id") == i).collect():
        a[r.y, r.x] = r.g
    return a


def test_pixels_agree_with_kernels(spark):
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 256, (9, 12)), np.full((5, 4), 7), np.array([[0, 255]])]
    p = image(spark, arrays)
    for i, a in enumerate(arrays):
        a = a.astype(np.uint8)
        assert (back(J.rotated(p, 90), i, a.T.shape) == np.rot90(a, -1)).all() and (back(J.rotated(p, 270), i, a.T.shape) == np.rot90(a)).all()
        assert (back(J.gamma(p), i, a.shape) == K.gamma(a)).all()
        assert (back(J.equalized(p), i, a.shape) == K.equalize(a)).all()
        assert {r.image_id: r.threshold for r in J.otsu(p).collect()}[i] == K.threshold(a) or len(set(a.ravel())) == 1
    q = {r.image_id: r for r in J.quality(p.where("image_id < 2")).collect()}
    a = arrays[0].astype(float)
    pad = np.pad(a, 1, mode="reflect")
    lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * a
    med = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(arrays[0], 2, mode="edge"), (5, 5)), axis=(2, 3))
    assert q[0].sharpness == pytest.approx(min(lap.var() / 1000, 1)) and q[0].noise == pytest.approx(min(np.abs(a - med).mean() / 20, 1)) and q[1].noise == 0


@pytest.mark.parametrize("n", [3, 8, 60, 400])
def test_moving_average_is_a_convolution(spark, n):
    rng = np.random.default_rng(n)
    ink = rng.integers(0, 50, n)
    df = spark.createDataFrame([(1, x, int(v)) for x, v in enumerate(ink)], "image_id int, x int, ink int")
    k = max(5, min(20, n // 50))
    full = np.convolve(ink, np.ones(k) / k)
    want = full[(k - 1) // 2 : (k - 1) // 2 + n]
    assert np.allclose([r.smooth for r in J.moving_average(df).orderBy("x").collect()], want)


def test_sharpening_and_presets():
    a = np.random.default_rng(3).integers(0, 256, (6, 7)).astype(np.uint8)
    wide = np.pad(a.astype(int), 1, mode="reflect")
    want = np.array([[9 * wide[y, x] - (wide[y - 1 : y + 2, x - 1 : x + 2].sum() - wide[y, x]) for x in range(1, 8)] for y in range(1, 7)]).clip(0, 255)
    assert (K.crisp(a) == want).all() and (K.sharpen(a) == np.rint(0.3 * a + 0.7 * want)).all()
    assert K.basic(a).shape == a.shape and set(schemas.PRESETS["advanced"]) <= set(K.KERNELS)


def test_parts_of_pages_without_any_use(spark):
    p = spark.createDataFrame([(1, 1, 10.0, 8.0, 1.0, 1.0, 5.0), (2, 1, 100.0, 40.0, 4.0, 2.0, 80.0), (2, 2, 300.0, 80.0, 4.0, 2.0, -20.0)], "page_id int, pos int, area double, perimeter double, w double, h double, deg double")
    assert {r.page_id: r.angle for r in J.text_orientation(p).collect()} == {1: 0.0, 2: pytest.approx((-10 * 100 - 20 * 300) / 400)}
    got = {r.page_id: (r.score, r.handwritten) for r in J.handwriting(p).collect()}
    assert got[1] == (0.0, False) and got[2][1]
    row = one(spark, C.layout_complexity(F.lit(50), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("a"), C.layout_complexity(F.lit(50), F.lit(1.0), F.lit(1.5)).alias("b"), R.detector_label_top(F.lit(5), F.lit(10)).alias("t"))
    assert tuple(row) == ("simple", "moderate", 15)


def test_action_engine(spark):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    rows = [(1, 3, 4, bytearray(a.tobytes()), ["rotate_90_cw", "nothing", "broken", "rotate_90_ccw"]), (2, 3, 4, bytearray(b"short"), ["rotate_180"]), (3, 3, 4, None, None), (4, 3, 4, bytearray(a.tobytes()), None)]
    df = spark.createDataFrame(rows, "image_id int, height int, width int, data binary, actions array<string>")

    def broken(img):
        raise RuntimeError("no")

    got = {r.image_id: r for r in K.apply_actions(df, {**K.KERNELS, "broken": broken}).collect()}
    assert bytes(got[1].data) == a.tobytes() and got[1].applied == ["rotate_90_cw", "nothing", "rotate_90_ccw"] and got[1].success and "broken" in got[1].error
    assert not got[2].success and bytes(got[2].data) == b"short" and not got[3].success and got[4].success
    for name, f in K.KERNELS.items():
        out = f(np.random.default_rng(1).integers(0, 256, (32, 40)).astype(np.uint8))
        assert out.ndim == 2 and np.asarray(out).dtype == np.uint8, name


def test_providers_fall_back(spark):
    class Silent:
        def answer(self, requests):
            if any("boom" in r for r in requests):
                raise RuntimeError("down")
            return [None if "skip" in r else "{not json" for r in requests]

    d = spark.createDataFrame([(1, "a"), (2, "skip"), (3, "boom"), (4, None)], "id int, t string")
    got = L.inferred(d, F.col("t"), schemas.LAYOUT, Silent)
    assert {r.source for r in got.collect()} == {"fallback"}
    got = {r.id: r for r in L.inferred(d, F.col("t"), schemas.LAYOUT).collect()}
    assert got[1].source == "model" and got[1].answer.total_regions == 1 and got[4].answer.total_regions == 0
    assert L.classified(spark.createDataFrame([("An INVOICE",), ("x" * 4001 + " invoice",), (None,)], "text string")).select("doc_class").collect() == [("Purchase Order",), ("Other",), ("Other",)]
