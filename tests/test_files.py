"""File sources, sinks, streaming and the driver's entry points."""

import json
import struct
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill.sources import files, sinks
from pagemill.streaming import ingest

REPO = Path(__file__).resolve().parent.parent


def test_image_facts(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 5000))
    (tmp_path / "b.bmp").write_bytes(b"BM" + b"\0" * 16 + struct.pack("<ii", 300, 200))
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {Path(r.path).name: r for r in files.image_facts(spark, str(tmp_path)).collect()}
    assert (got["a.PNG"].width, got["a.PNG"].height, got["a.PNG"].errors) == (640, 5000, ["too many pixels"])
    assert (got["b.bmp"].width, got["b.bmp"].height, got["b.bmp"].errors) == (300, 200, [])
    assert got["c.txt"].errors == ["format"] and got["c.txt"].width is None
    kinds = files.inputs(spark, f"{tmp_path}/[ab]*").select("document", "kind").collect()
    assert sorted(map(tuple, kinds)) == [("a", "image"), ("b", "image")]


def test_saved_responses(spark, tmp_path):
    body = {"page_number": 3, "raw_semantic_result": {"table_summary": {"total_tables": 2}, "tables": [{"table_id": "x", "data_relationships": [{"row_header": "r", "values": {"a": "1"}}]}, {"table_id": "y"}], "extraction_metadata": {"confidence": 0.7}}}
    (tmp_path / "llm_response_page_3.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "other.json").write_text("{}")
    got = files.saved_responses(spark, str(tmp_path)).orderBy("table_index").collect()
    assert [(r.page_number, r.table_index, r.table.table_id) for r in got] == [(3, 1, "x"), (3, 2, "y")]
    assert got[0].table.data_relationships[0]["values"] == {"a": "1"}


def test_pdf_source_without_a_library(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    df = files.pdf_pages(spark, [str(tmp_path / "a.pdf")])
    assert df.columns == ["path", "document", "page_number", "height", "width", "data", "error"]
    row = df.collect()
    assert len(row) == 1 and row[0].error and row[0].data is None and row[0].document == "a"


def test_sinks(spark, tmp_path):
    regions = spark.createDataFrame([(1, "r", "title", (0.1, 0.2, 0.3, 0.4), 0.12345, 1, "d")], "page_number int, region_id string, region_type string, bbox struct<x double, y double, width double, height double>, confidence double, reading_order int, content_description string")
    sinks.regions_csv(regions, f"{tmp_path}/csv", one_file=True)
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == list(sinks.REGION_COLUMNS) and back.first().width == "0.3"
    assert json.loads(sinks.export_rows(regions).first().json)["confidence"] == 0.123
    sinks.responses_json(regions.select("page_number", "region_id"), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().page_number == 1
    assert not sinks.table_summary_json(regions.limit(0), regions, f"{tmp_path}/none") and not (tmp_path / "none").exists()


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = ingest.arriving(spark, f"{tmp_path}/in", events.schema)
    ingest.run_available(ingest.tumbling_counts(stream, width="1 day"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out")
    whole = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert got.count() > 0 and got.subtract(whole.select(got.columns)).count() == 0
    twice = ingest.arriving(spark, f"{tmp_path}/in", events.schema).withColumn("c", F.encode(F.col("event_type"), "utf-8"))
    ingest.run_available(ingest.once_per_image(twice, "ts", "c", "4000 days"), f"{tmp_path}/once", f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/once").count() == events.select("event_type").distinct().count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [("pagemill/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    for p in REPO.iterdir():
        if p.name in ("pagemill", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", str(p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", *(str(tmp_path / g) for g in gone)], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
