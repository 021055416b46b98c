"""Flows with providers that see the page, PDF files of many pages, preprocessing from pixels, pages of real size."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions.images import decode_png, encode_png
from pagemill.operators import inference, kernels, models, parts
from pagemill.operators import knowledge as N
from pagemill.plans import workflows as W
from pagemill.sources import files


def test_every_page_of_a_pdf(spark, tmp_path):
    def pages_51(content, dpi):
        for i in range(51):
            yield np.full((6, 5), i, np.uint8)
        if b"broken" in content:
            raise ValueError("breaks off")

    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    (tmp_path / "b.pdf").write_bytes(b"%PDF- broken")
    (tmp_path / "c.png").write_bytes(encode_png(np.full((3, 4), 9, np.uint8)))
    got = files.pages_of(spark, [str(tmp_path / n) for n in ("a.pdf", "b.pdf", "c.png")], pages_51)
    rows = got.collect()
    by = {d: sorted(r.page_number for r in rows if r.document == d and r.error is None) for d in "abc"}
    assert by == {"a": list(range(1, 52)), "b": list(range(1, 52)), "c": [1]}
    assert [(r.document, r.error, r.data) for r in rows if r.error] == [("b", "breaks off", None)]
    assert {r.path[-5:]: (r.pages, r.errors) for r in files.pdf_errors(got.where("document <> 'c'")).collect()} == {"a.pdf": (51, ["too many pages"]), "b.pdf": (51, ["too many pages"])}
    plain = files.pdf_pages(spark, [str(tmp_path / "a.pdf")], sharpen=False, render=pages_51).where("page_number = 51").first()
    assert bytes(plain.data) == bytes([50] * 30) and (plain.height, plain.width) == (6, 5)


def counting(folder, answers):
    """A provider that notes each request that it gets, and what picture came with it."""

    class Counting:
        def answer(self, requests):
            out = []
            for r in requests:
                seen = None if r.image is None else decode_png(r.image)
                with open(os.path.join(folder, "log"), "a") as f:
                    f.write(json.dumps([r[:30], None if seen is None else [*seen.shape, int(seen.sum())]]) + "\n")
                out.append(answers(r, seen))
            return out

    return Counting


def logged(folder):
    return sorted(json.loads(x) for x in open(os.path.join(folder, "log")))


def test_providers_see_each_page_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/p{k}.png").write_bytes(encode_png(np.full((20, 30), 40 * k, np.uint8)))
    box = {"x": 0.1, "y": 0.1, "width": 0.5, "height": 0.5}

    def answers(r, seen):
        if "regions of page" in r:
            return json.dumps({"page_number": 1, "regions": {"region_id": "t", "region_type": "table", "bbox": box, "confidence": 0.9}})  # one region, not in a list
        return json.dumps({"document_id": "d", "detections": [{"label_id": k, "score": 0.9, "x1": 0, "y1": 0, "x2": 9, "y2": 5} for k in (1, 2)]})

    out = W.analyze(spark, f"{tmp_path}/in", f"{tmp_path}/out", counting(str(tmp_path), answers))
    assert out["tables"].count() == 3 and out["regions"].count() == 3 and out["documents"].count() == 3
    drawn = decode_png(bytes(spark.read.parquet(f"{tmp_path}/out/annotated").where("document = 'p0'").first().content))
    assert drawn.shape == (20, 30) and (drawn[2, 3:19] > 0).all() and (drawn[2:13, 3] > 0).all() and not drawn[6:9, 8:15].any() and not drawn[:2].any()
    log = logged(tmp_path)
    assert len(log) == 6 and len({json.dumps(x) for x in log}) == 6  # three pages and three crops, each once
    assert [20, 30, 40 * 600] in [x[1] for x in log] and [10, 15, 80 * 150] in [x[1] for x in log]


def test_each_request_once_in_other_flows(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", 1, "h", {"a": str(i % 2)}) for i in range(4)], "table_id string, pos int, row_header string, data map<string,string>")
    good = {"quality_assessment": "ok", "entities": [{"name": "V", "entity_type": "concept"}], "relations": [{"subject_name": "V", "predicate": "owns", "object_name": "W", "evidence": "e"}]}
    got = W.model_triplets(rows, counting(str(tmp_path), lambda r, i: json.dumps(good)))
    assert got.count() == 4 and got.count() == 4 and len(logged(tmp_path)) == 2
    (tmp_path / "log").unlink()
    regions = spark.createDataFrame([("p", "a1", "title", 1), ("q", "b1", "text", 1)], "path string, region_id string, region_type string, reading_order int")
    texts = W.region_texts(regions, counting(str(tmp_path), lambda r, i: "some text"))
    assert {(r.region_id, r.extracted_text) for r in texts.collect()} == {("a1", "some text"), ("b1", "some text")}
    assert len(logged(tmp_path)) == 2


def test_table_contents(spark):
    table = {
        "table_id": "x", "headers": {"column_headers": ["Min", "Max"]}, "structure": {"columns": 3},
        "data_relationships": [{"row_header": "Size", "values": {"Min": "1", "Max": "2"}}, {"row_header": "Mass", "single_value": "5 kg"}],
    }

    class Reader:
        def answer(self, requests):
            return [json.dumps({"table_summary": {"main_topic": "sizes"}, "tables": [table], "extraction_metadata": {"confidence": 0.9}}) if decode_png(r.image)[0, 0] == 7 else "no" for r in requests]

    crops = spark.createDataFrame([("a", 2, 2, bytearray([7] * 4)), ("b", 2, 2, bytearray([9] * 4))], "table_id string, height int, width int, data binary")
    got = {r.table_id: r for r in W.table_contents(crops, Reader).collect()}
    a, b = got["a"], got["b"]
    assert (a.rows, a.cols, a.structure_confidence, a.headers, a.main_topic, a.method) == (2, 3, 0.9, ["Min", "Max"], "sizes", "structured_semantic")
    assert [(c.row, c.col, c.content) for c in a.cells] == [(0, 1, "Min"), (0, 2, "Max"), (1, 0, "Size"), (1, 1, "1"), (1, 2, "2"), (2, 0, "Mass"), (2, 1, "5 kg")]
    assert a.data_rows == [{"Min": "1", "Max": "2"}, {"value": "5 kg"}]
    assert b.method == "simple_fallback" and [c.content for c in b.cells] == ["Parameter", "Value", "Extraction Failed", "Unable to parse table"] and b.structure_confidence == 0.3


def test_classes_and_texts_through_providers(spark):
    class Labels:
        def answer(self, requests):
            return [json.dumps({"document_id": None, "doc_class": " Contract \n"}) if "alpha" in r else None for r in requests]

    docs = spark.createDataFrame([(1, "alpha"), (2, "the invoice"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.doc_class, r.source) for r in W.document_classes(docs, Labels).collect()} == {(1, "Contract", "model"), (2, "Purchase Order", "fallback"), (3, "Other", "fallback")}
    texts = spark.createDataFrame([("a", "some words"), ("b", "")], "table_id string, text string")
    assert {(r.subject, r.object, r.method) for r in W.text_triplets(texts).collect()} == {("parameter_0", "some words", "rules")}


def test_one_value_where_a_list_is_due(spark):
    schema = models.TASKS["triplets"]
    df = spark.createDataFrame([('{"quality_assessment": "ok", "entities": {"name": "A", "aliases": "x"}, "relations": []}',), ('{"entities": [{"name": "B"}]}',)], "raw string")
    got = [r.a for r in df.select(inference.parsed(F.col("raw"), schema).alias("a")).collect()]
    assert got[0].entities[0].name == "A" and got[0].quality_assessment == "ok" and got[0].relations == [] and got[1].entities[0].name == "B"


def test_zero_and_false_are_no_values(spark):
    d = spark.createDataFrame([("t", 1, "h", 0, 0.0, False, "", "0"), ("t", 2, "h", 3, 0.5, True, "x", None)], "table_id string, pos int, row_header string, a int, b double, c boolean, d string, e string")
    got = sorted((r.pos, r.object) for r in N.rule_triplets(d, ["a", "b", "c", "d", "e"]).collect())
    assert got == [(1, "0"), (2, "0.5"), (2, "3"), (2, "true"), (2, "x")]


def test_parts_and_outlines():
    ink = np.zeros((30, 40), bool)
    ink[3:10, 4:12] = True
    ink[5:8, 6:10] = False  # a hole is not an outline of its own
    ink[20, 5] = True
    ink[21, 6] = ink[22, 7] = True  # touches at corners
    found = parts.parts(ink)
    assert [(p["box"], p["area"], round(p["perimeter"], 6)) for p in found] == [((5, 20, 8, 23), 0.0, round(4 * 2**0.5, 6)), ((4, 3, 12, 10), 42.0, 26.0)]
    rng = np.random.default_rng(3)
    for _ in range(20):
        dots = rng.random((12, 15)) < 0.35
        seen, count = np.zeros_like(dots), 0
        for y, x in zip(*np.nonzero(dots)):
            if not seen[y, x]:
                count, todo = count + 1, [(y, x)]
                seen[y, x] = True
                while todo:
                    a, b = todo.pop()
                    for c in range(max(0, a - 1), min(12, a + 2)):
                        for d in range(max(0, b - 1), min(15, b + 2)):
                            if dots[c, d] and not seen[c, d]:
                                seen[c, d] = True
                                todo.append((c, d))
        assert len(parts.parts(dots)) == count
    turned = np.array([(x, y) for x, y in [(0, 10), (20, 0), (30, 20), (10, 30)]], float)
    assert parts.smallest_box_angle(turned) == pytest.approx(np.degrees(np.arctan2(20, 10)), abs=1e-6)


def lines_page():
    img = np.full((400, 300), 255, np.uint8)
    for y in range(30, 370, 25):
        img[y : y + 6, 30:270] = 0
    return img


@pytest.mark.parametrize("degrees", [-7.0, 3.0, 6.0])
def test_a_skewed_page_is_measured_and_set_straight(degrees):
    tilted = kernels.turned(lines_page(), degrees)
    angle, sure = parts.skew_angle(tilted)
    assert angle == pytest.approx(-degrees, abs=1) and sure >= 0.5
    assert abs(parts.skew_angle(kernels.deskew(tilted))[0]) <= 1


def test_preprocessing_sees_the_page(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(encode_png(kernels.turned(lines_page(), 6.0)))
    (tmp_path / "in/b.png").write_bytes(b"broken")
    out = W.preprocess(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    found = out["assessments"].first()
    assert "skewed" in {c.condition for c in found.found} and "deskew" in found.recommendations
    pages = {r.path[-5:]: r for r in out["pages"].collect()}
    assert "deskew" in pages["a.png"].applied and 0 <= pages["a.png"].improvement <= 1 and pages["a.png"].aspect == pytest.approx(pages["a.png"].width / pages["a.png"].height)
    assert pages["b.png"].error and pages["b.png"].applied == [] and pages["b.png"].improvement is None
    assert {(r.document, r.total_pages, r.pages_preprocessed, r.pages_skipped) for r in out["documents"].collect()} == {("a", 1, 1, 0), ("b", 1, 0, 1)}
    basic = W.preprocess(spark, f"{tmp_path}/in", level="basic")["images"].first()
    assert basic.applied == ["basic"] and basic.success
    own = W.preprocess(spark, f"{tmp_path}/in", level="custom", custom=("binarize", "rotate_180"))["images"].first()
    assert own.applied == ["rotate_180", "binarize"]
    with pytest.raises(ValueError):
        W.preprocess(spark, f"{tmp_path}/in", level="custom")


def test_preprocessing_by_a_model(spark, tmp_path):
    (tmp_path / "in").mkdir()
    page = np.arange(60 * 40, dtype=np.uint32).reshape(60, 40) % 251
    for k, name in enumerate(("turned", "good", "silent")):
        (tmp_path / f"in/{name}.png").write_bytes(encode_png((page + k).astype(np.uint8)))

    def answers(r, seen):
        if seen[0, 0] == 0:
            turn = {"condition": "rotated_90_cw", "severity": "critical", "confidence": 0.9, "evidence": "vertical text", "recommended_actions": ["rotate_90_ccw"]}
            return json.dumps({"overall_quality": "Poor", "primary_issues": [turn], "secondary_issues": []})
        return json.dumps({"overall_quality": "Good", "primary_issues": []}) if seen[0, 0] == 1 else None

    out = W.preprocess(spark, f"{tmp_path}/in", f"{tmp_path}/out", provider=counting(str(tmp_path), answers))
    got = {r.document: r for r in out["images"].collect()}
    assert got["turned"].applied == ["rotate_90_ccw"] and (got["turned"].height, got["turned"].width) == (40, 60)
    assert (np.frombuffer(got["turned"].data, np.uint8).reshape(40, 60) == np.rot90(page.astype(np.uint8))).all()
    assert got["good"].applied == [] and got["silent"].applied == ["enhance_contrast", "denoise", "sharpen"]
    a = {r.path.rsplit("/", 1)[1]: (r.source, r.process, r.quality) for r in out["assessments"].collect()}
    assert a["turned.png"] == ("model", True, "Poor") and a["good.png"] == ("model", False, "Good") and a["silent.png"][:2] == ("fallback", True)
    assert len(logged(tmp_path)) == 3


def test_a_page_of_real_size_fits(tmp_path):
    """2,480 by 3,508 pixels with 1,500 parts: all measures and kernels stay within 1,500 MB."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from pagemill.operators import kernels, parts
rng = np.random.default_rng(1)
img = np.full((3508, 2480), 255, np.uint8)
for _ in range(1500):
    y, x = rng.integers(0, 3480), rng.integers(0, 2450)
    img[y : y + 20, x : x + 15] = 0
assert len(parts.page_measures(img.tobytes(), 3508, 2480)) == len(parts.MEASURES)
for k in kernels.KERNELS.values():
    k(img)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert int(done.stdout.split()[-1]) < 1500, done.stderr[-500:]


def test_local_contrast_has_no_steps():
    ramp = np.tile(np.linspace(60, 190, 160).astype(np.uint8), (160, 1))
    out = kernels.local_contrast(ramp).astype(int)
    assert out.shape == ramp.shape and np.abs(np.diff(out, axis=1)).max() < 40 and out.std() > ramp.std() * 0.5
