"""Sinks: results as JSON or CSV directories, written by executors in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.images import encode_png
from ..functions.text import page_name

#: Columns of the regions file, in order.
REGION_COLUMNS = ("page_number", "region_id", "region_type", "x", "y", "width", "height", "confidence", "reading_order", "content_description")


def results_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def responses_json(responses: DataFrame, path: str) -> None:
    """One directory per page."""
    responses.write.mode("overwrite").partitionBy("page_number").json(path)


def region_rows(regions: DataFrame) -> DataFrame:
    """Regions with their box flattened, in the file's columns."""
    flat = regions.withColumns({c: F.col(f"bbox.{c}") for c in ("x", "y", "width", "height")}) if "bbox" in regions.columns else regions
    return flat.select(*REGION_COLUMNS)


def regions_csv(regions: DataFrame, path: str, one_file: bool = False) -> None:
    """One file only where it is asked for: that is one task's work."""
    rows = region_rows(regions)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def export_rows(regions: DataFrame) -> DataFrame:
    """Regions as JSON strings, confidence with three decimals (halves to even)."""
    return regions.select(F.to_json(F.struct(*[F.bround("confidence", 3).alias(c) if c == "confidence" else F.col(c) for c in regions.columns])).alias("json"))


def table_summary_json(tables: DataFrame, summary: DataFrame, path: str) -> bool:
    """The summary, only if there is a table."""
    if tables.isEmpty():
        return False
    summary.write.mode("overwrite").json(path)
    return True


def images(pages: DataFrame, path: str) -> None:
    """Encoded images as rows of Parquet with their file names: small files are poor for a store."""
    pages.write.mode("overwrite").parquet(path)


@F.pandas_udf(BinaryType())
def png(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
    """Gray bytes as a PNG file; null for null."""
    return pd.Series([None if d is None else encode_png(np.frombuffer(d, np.uint8).reshape(int(h), int(w))) for h, w, d in zip(height, width, data)], dtype=object)


def png_rows(images: DataFrame, kind: str = "preprocessed") -> DataFrame:
    """Images (document, page_number, height, width, data) as files: file_name and content, a PNG; base64 for requests."""
    out = images.select("document", "page_number", page_name(F.col("document"), F.col("page_number"), kind).alias("file_name"), png("height", "width", "data").alias("content"))
    return out.withColumn("base64", F.base64("content"))


def files(rows: DataFrame, path: str) -> None:
    """Write rows (file_name, content) as files of their own in a folder: a path, or an address of a store that Arrow
    writes (file, hdfs, s3, gs), which executors share."""

    def put(batch):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(folder, recursive=True)
        for r in batch:
            if r.content is not None:
                with store.open_output_stream(f"{folder}/{r.file_name.rsplit('/', 1)[-1]}") as f:
                    f.write(bytes(r.content))

    rows.select("file_name", "content").foreachPartition(put)
