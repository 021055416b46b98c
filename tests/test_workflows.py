"""Whole runs over small folders, and model tasks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions.images import decode_png, encode_png
from pagemill.operators import models
from pagemill.operators import pixels as J
from pagemill.plans import workflows as W
from pagemill.sources import files, sinks


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    page = np.full((60, 80), 255, np.uint8)
    page[10:50, 5:35] = rng.integers(0, 2, (40, 30)) * 255
    page[10:50, 45:75] = rng.integers(0, 2, (40, 30)) * 255
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(encode_png(page))
    (tmp_path / "in/b.png").write_bytes(encode_png(np.full((40, 40), 30, np.uint8)))
    (tmp_path / "in/c.png").write_bytes(b"broken")
    return tmp_path


def test_png_round_trip():
    img = np.random.default_rng(2).integers(0, 256, (7, 5)).astype(np.uint8)
    assert (decode_png(encode_png(img)) == img).all()
    with pytest.raises(ValueError):
        decode_png(b"GIF89a")


class_rows = "table_id string, pos int, row_header string, data map<string,string>"


def test_analyze(spark, folder):
    class Tables:
        def answer(self, requests):
            out = []
            for r in requests:
                if "regions of page" in r:
                    box = lambda x, w: {"x": x, "y": 0.1, "width": w, "height": 0.5}
                    out.append(json.dumps({"page_number": 1, "regions": [{"region_id": "t", "region_type": "table", "bbox": box(0.1, 0.5), "confidence": 0.9}, {"region_type": "title", "bbox": box(0.9, 0.5), "confidence": 0.8}, {"region_type": "text", "bbox": box(0.0, 0.2), "confidence": 0.7}]}))
                else:
                    out.append(json.dumps({"detections": [{"label_id": k, "score": 0.9, "x1": 0, "y1": 0, "x2": 10, "y2": 5} for k in (1, 1, 2, 3)]}))
            return out

    out = W.analyze(spark, f"{folder}/in", f"{folder}/out", Tables)
    assert {r.path.rsplit("/", 1)[1]: r.error is None for r in out["pages"].collect()} == {"a.png": True, "b.png": True, "c.png": False}
    assert sorted(r.region_type for r in out["regions"].collect()) == ["table", "table", "text", "text"]
    t = out["tables"].collect()
    assert {(r.rows, r.cols, r.error) for r in t} == {(1, 2, None)} and t[0].confidence == pytest.approx(0.9)
    assert {(r.doc_id, r.regions, r.tables, r.ok_tables) for r in out["documents"].collect()} == {("a", 2, 1, 1), ("b", 2, 1, 1)}
    assert spark.read.json(f"{folder}/out/table_summary").first().successful == 2
    assert W.analyze(spark, f"{folder}/in")["tables"].count() == 0


def test_preprocess(spark, folder):
    out = W.preprocess(spark, f"{folder}/in", f"{folder}/out")
    got = {r.path.rsplit("/", 1)[1]: r for r in out["assessments"].collect()}
    assert got["a.png"].columns == 2 and "multi_column" not in [c.condition for c in got["a.png"].primary_issues]
    assert {c.condition for c in got["b.png"].primary_issues} == {"low_contrast", "dark_background", "blurry"}
    images = {r.document: r for r in out["images"].collect()}
    assert set(images) == {"a", "b"} and images["b"].applied == ["enhance_contrast", "gamma_correction", "sharpen"] and images["b"].success
    saved = spark.read.parquet(f"{folder}/out/images").where("document = 'b'").first()
    assert saved.file_name == "b_page_002_preprocessed.png" and decode_png(bytes(saved.content)).shape == (40, 40)
    assert "sharpen" in W.preprocess(spark, f"{folder}/in", level="advanced")["images"].first().applied
    with pytest.raises(ValueError):
        W.preprocess(spark, f"{folder}/in", level="all")


def test_measures_agree_with_pixel_operators(spark, folder):
    pages = files.page_images(spark, f"{folder}/in")
    rows = W.pixel_rows(pages)
    a = {r.path: r for r in W.measured(pages).collect()}
    for r in J.quality(rows).collect():
        for c in ("contrast", "brightness", "sharpness", "noise"):
            assert a[r.image_id][c] == pytest.approx(r[c]), c
    assert {r.image_id: r["columns"] for r in J.column_count(rows).collect()} == {k: v["columns"] for k, v in a.items()}
    assert W.quality_gain(rows, rows).select(F.min("improvement")).first()[0] == 0.5


def test_page_files(spark, folder):
    pages = files.page_images(spark, f"{folder}/in").where("error is null")
    sinks.files(sinks.png_rows(pages, "original"), f"{folder}/dump")
    assert sorted(p.name for p in (folder / "dump").iterdir()) == ["a_page_001_original.png", "b_page_002_original.png"]
    assert files.writable(spark, f"{folder}/new") and not files.writable(spark, "/proc/none")


def test_triplets_of_responses(spark, folder):
    table = {"data_relationships": [{"row_header": "Voltage", "single_value": "5 V", "row_notes": "max"}, {"row_header": "Size", "values": {"Min": "1", "Max": ""}}]}
    (folder / "llm_response_page_2.json").write_text(json.dumps({"page_number": 2, "raw_semantic_result": {"tables": [table]}}))
    out = W.response_triplets(spark, str(folder))
    assert {r.sentence for r in out["triplets"].collect()} == {"Voltage has value of 5 V", "Voltage has notes of max", "Size has Min of 1"}

    class Half:
        def answer(self, requests):
            good = {"quality_assessment": "ok", "entities": [{"name": "V", "entity_type": "concept"}], "relations": [{"subject_name": "V", "predicate": "owns", "object_name": "W", "evidence": "e"}]}
            return [json.dumps(good) if "good" in r else None for r in requests]

    rows = spark.createDataFrame([("t1", 1, "good", {"a": "1"}), ("t2", 1, "bad", {"a": "1"})], class_rows).withColumn("data", F.map_concat("data", F.create_map(F.lit("h"), F.col("row_header"))))
    got = {(r.table_id, r.subject, r.object, r.method) for r in W.model_triplets(rows, Half).collect()}
    assert got == {("t1", "V", "W", "model"), ("t2", "bad", "1", "rules"), ("t2", "bad", "bad", "rules")}


def test_parameters_and_best_table(spark):
    models.Parameters("m", ("m",))
    for bad in ({"model": "x"}, {"temperature": 3.0}, {"max_tokens": 50}):
        with pytest.raises(ValueError):
            models.Parameters(**{"model": "m", "models": ("m",), **bad})
    d = spark.createDataFrame([("t", 1, 0, 0.5, 0.1, 0.1, 0.1, 0.1), ("t", 2, 0, 0.9, 0.2, 0.1, 0.1, 0.1), ("t", 3, 0, 0.9, 0.3, 0.1, 0.1, 0.1)], "table_id string, pos int, label_id int, score double, x double, y double, w double, h double")
    assert models.best_table(d).first().pos == 2


def test_texts(spark):
    lines = spark.createDataFrame([("d", 1, 2, "of sale"), ("d", 1, 1, "Invoice"), ("d", 2, 1, "end"), ("e", 1, 1, "x")], "document string, page_number int, line_number int, text string")
    got = {r.document: (r.text, r.doc_class) for r in W.classify(spark, lines).collect()}
    assert got == {"d": ("Invoice\nof sale\n\nend", "Purchase Order"), "e": ("x", "Other")}

    class Reader:
        def answer(self, requests):
            return [json.dumps({"texts": [{"region_id": "a1", "extracted_text": "A", "confidence": 0.9}]}) if "a1" in r else "first\n\n second " if "b1" in r else None for r in requests]

    rows = [("p", "a1", "title", 1), ("q", "b2", "text", 2), ("q", "b1", "text", 1), ("q", "b3", "footer", 3), ("q", "t", "table", 4), ("r", "c1", "text", 1)]
    regions = spark.createDataFrame(rows, "path string, region_id string, region_type string, reading_order int")
    got = {(r.path, r.region_id, r.extracted_text) for r in W.region_texts(regions, Reader).collect()}
    assert got == {("p", "a1", "A"), ("q", "b1", "first"), ("q", "b2", "second"), ("q", "b3", "Extraction failed")}


def test_settings(monkeypatch):
    from pagemill.settings import Settings

    monkeypatch.setenv("MAX_WORKERS", "7")
    assert Settings().max_workers == 7 and Settings().table_confidence == 0.7


def test_every_task_parses_and_falls_back(spark):
    minimal = {
        "layout": {"page_number": 1}, "table_structure": {"rows": 2}, "region_text": {"texts": []}, "condition": {"primary_issues": []}, "table_content": {"tables": [{"table_id": "x"}]}, "insights": {"insights": [{"subject": "s"}]},
        "triplets": {"entities": []}, "document_class": {"doc_class": "Contract"}, "structure_boxes": {"detections": []}, "layout_boxes": {"detections": []}, "cell_text": {"cells": [{"row_start": 0, "row_end": 1, "col_start": 0, "col_end": 0, "text": "a"}]},
    }
    assert set(minimal) == set(models.TASKS)

    class Echo:
        def answer(self, requests):
            return [r if r.startswith("{") else "no" for r in requests]

    for task, body in minimal.items():
        d = spark.createDataFrame([(1, json.dumps(body)), (2, "else")], "id int, r string")
        got = {r.id: r.source for r in models.ask(d, task, F.col("r"), Echo).collect()}
        assert got == {1: "model", 2: "fallback"}, task


def test_broken_recognition_and_failed_tables(spark):
    from pagemill.operators import grids, knowledge

    raw = spark.createDataFrame([("t", 2, 4, 1, 1)], "table_id string, row_start int, row_end int, col_start int, col_end int")
    assert grids.raw_spans(raw).first().asDict() == {"table_id": "t", "row": 2, "col": 1, "rowspan": 3, "colspan": 1}
    row = knowledge.fallback_tables(spark.createDataFrame([("t",)], "table_id string")).first()
    assert (row.rows, row.cols, row.structure_confidence) == (2, 2, 0.3)
    pages = spark.createDataFrame([("a", 1), ("a", 51), ("b", 3)], "path string, page_number int")
    assert {r.path: r.errors for r in files.pdf_errors(pages).collect()} == {"a": ["too many pages"], "b": []}


def filtered_png(img, kinds):
    """A PNG whose rows use the given filters."""
    import struct
    import zlib

    h, w, size = img.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[size]
    flat, raw = img.reshape(h, w * size).astype(int), b""
    for y in range(h):
        kind = kinds[y % len(kinds)]
        line = bytearray([kind])
        for i in range(w * size):
            a = flat[y, i - size] if i >= size else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - size] if y and i >= size else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((flat[y, i] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        raw += bytes(line)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_png_filters_and_channels(size):
    img = np.random.default_rng(size).integers(0, 256, (11, 6, size)).astype(np.uint8)
    x = img.astype(float)
    if size in (2, 4):
        x = x[:, :, :-1] * (x[:, :, -1:] / 255) + 255 * (1 - x[:, :, -1:] / 255)
    want = np.clip(np.rint(x @ np.array([0.299, 0.587, 0.114]) if x.shape[2] == 3 else x[:, :, 0]), 0, 255)
    assert (decode_png(filtered_png(img, [0, 1, 2, 3, 4])) == want).all()
