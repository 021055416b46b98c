"""File sources: images, PDF pages, saved model responses. Files are listed and read by executors, not by the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import input_kind, stem, suffix
from ..schemas import SAVED_RESPONSE

# Fixed limits of the document model.
MOST_BYTES, MOST_PIXELS, MOST_PAGES = 20 * 1024 * 1024, 4096, 50
IMAGE_FORMATS = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif")


def inputs(spark: SparkSession, path: str) -> DataFrame:
    """Input files with kind (pdf or image; another suffix is an error when it is read), document name and hash."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", input_kind(F.col("path")).alias("kind"), stem(F.col("path")).alias("document"), "length", F.md5("content").alias("md5"))


def _number(data, at: int, size: int, big: bool):
    """An unsigned number of a header, from 1-based place at."""
    part = F.substring(data, at, size)
    if not big:
        part = F.concat(*[F.substring(data, at + k, 1) for k in reversed(range(size))])
    return F.conv(F.hex(part), 16, 10).cast("long")


def _jpeg_size(data, at: int):
    """Two bytes of a JPEG file's frame header (height at 3, width at 5 after its marker); markers stand in the first 64 KB."""
    text = F.hex(F.substring(data, 1, 1 << 16))
    frame = F.regexp_extract(text, r"^FFD8(?:FF(?!C[0-35-7])[0-9A-F]{2}(?:[0-9A-F]{2})*?)*?FFC[0-35-7]([0-9A-F]{14})", 1)
    return F.when(frame != "", F.conv(F.substring(frame, 2 * at + 1, 4), 16, 10).cast("long"))


def image_facts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Image files with width, height and mode (from the headers of PNG, BMP and JPEG), format, size, md5 and errors.

    Headers are read with column functions, so no image library is needed; a file whose header can't be read has null
    sizes and, if its suffix is an image's, the error `unreadable`, but for TIFF, which is checked for suffix and length.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    c, head = F.col("content"), F.hex(F.substring("content", 1, 8))
    png, bmp, jpeg = head == "89504E470D0A1A0A", head.startswith("424D"), head.startswith("FFD8FF")
    width = F.when(png, _number(c, 17, 4, True)).when(bmp, _number(c, 19, 4, False)).when(jpeg, _jpeg_size(c, 5))
    height = F.when(png, _number(c, 21, 4, True)).when(bmp, _number(c, 23, 4, False)).when(jpeg, _jpeg_size(c, 3))
    kind = F.hex(F.substring(c, 26, 1))
    mode = F.when(png, F.when(kind == "00", "L").when(kind == "02", "RGB").when(kind == "03", "P").when(kind == "04", "LA").when(kind == "06", "RGBA"))
    out = f.select("path", suffix(F.col("path")).alias("format"), "length", width.alias("width"), height.alias("height"), mode.alias("mode"), F.md5("content").alias("md5"))
    known = F.col("format").isin(*IMAGE_FORMATS)
    errors = F.array_compact(F.array(
        F.when(F.col("length") > MOST_BYTES, "too large"), F.when(~known, "format"), F.when(F.greatest("width", "height") > MOST_PIXELS, "too many pixels"),
        F.when(known & F.col("width").isNull() & ~F.col("format").isin(".tiff", ".tif"), "unreadable"),
    ))
    return out.withColumn("errors", errors)


def saved_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved table responses, one row per table, in order of their files: path, page_number, table_index, table, and the
    response's summary and metadata."""
    r = spark.read.schema(SAVED_RESPONSE).option("multiLine", True).option("pathGlobFilter", "llm_response_page_*.json").json(path)
    flat = r.select(F.col("_metadata.file_path").alias("path"), "page_number", "raw_semantic_result.table_summary", "raw_semantic_result.extraction_metadata", F.posexplode("raw_semantic_result.tables").alias("i", "table"))
    return flat.select("path", "page_number", (F.col("i") + 1).alias("table_index"), "table", "table_summary", "extraction_metadata")


def rendered(content: bytes, dpi: int):
    """The pages of a PDF file as gray arrays, one by one. Needs a PDF library on executors, absent here; any other
    function of this form can take its place."""
    import fitz
    import numpy as np

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            px = page.get_pixmap(dpi=dpi, colorspace="gray", alpha=False)  # without alpha: on white
            yield np.frombuffer(px.samples, np.uint8).reshape(px.height, px.width)


def pdf_pages(spark: SparkSession, paths: list[str], dpi: int = 300, sharpen: bool = True, render=rendered) -> DataFrame:
    """One row per page of PDF files, every page: path, document, page_number, height, width, data (gray bytes, sharpened
    unless sharpen is false) and error. A file that can't be opened, or breaks off, gives a row with an error and no
    pixels after the pages before. Files are read by executors from any store that Spark reads; pages are handed on one
    by one."""
    f = spark.read.format("binaryFile").load(paths).select("path", "content")

    def read(batches):
        import pandas as pd

        from ..operators.kernels import crisp

        def row(path, number, img, error):
            size = (None, None, None) if img is None else (*img.shape, (crisp(img) if sharpen else img).tobytes())
            return pd.DataFrame([(path, number, *size, error)], columns=["path", "page_number", "height", "width", "data", "error"]).astype({"height": "Int32", "width": "Int32", "page_number": "Int32"})

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                number = 0
                try:
                    for img in render(bytes(content), dpi):
                        number += 1
                        yield row(path, number, img, None)
                except Exception as e:  # an unreadable file is a row with an error
                    yield row(path, None, None, str(e)[:200] or "unreadable")

    out = f.mapInPandas(read, "path string, page_number int, height int, width int, data binary, error string")
    return out.select("path", stem(F.col("path")).alias("document"), "page_number", "height", "width", "data", "error")


def pages_of(spark: SparkSession, paths: list[str], render=rendered) -> DataFrame:
    """Pages of PDF files and of images alike, in the columns of page_images(): the kind follows from the suffix."""
    pdf = [p for p in paths if p.lower().endswith(".pdf")]
    other = [p for p in paths if p not in pdf]
    parts = ([pdf_pages(spark, pdf, render=render)] if pdf else []) + ([page_images(spark, other, "*")] if other else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page_images(spark: SparkSession, path: str | list[str], glob: str = "*.png") -> DataFrame:
    """Image files as pages: document (the file's stem), page_number (its place by name within its folder), height, width,
    data (gray bytes) and error. A file that can't be read has null sizes and an error."""
    import pandas as pd
    from pyspark.sql import Window

    from ..functions.images import decode_png

    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    # numbering moves names only; a folder is a document's
    numbered = f.select("path").withColumn("page_number", F.row_number().over(Window.partitionBy(folder).orderBy("path")))

    def read(batches):
        for b in batches:
            for p, c in zip(b["path"], b["content"]):  # handed on one by one
                try:
                    img = decode_png(bytes(c))
                    row = (p, img.shape[0], img.shape[1], img.tobytes(), None)
                except Exception as e:  # an unreadable image is a row with an error
                    row = (p, None, None, None, str(e)[:200])
                yield pd.DataFrame([row], columns=["path", "height", "width", "data", "error"]).astype({"height": "Int32", "width": "Int32"})

    pixels = f.select("path", "content").mapInPandas(read, "path string, height int, width int, data binary, error string")
    return pixels.join(numbered, "path").select("path", stem(F.col("path")).alias("document"), "page_number", "height", "width", "data", "error")


def pdf_errors(pages: DataFrame) -> DataFrame:
    """Per PDF file the number of its pages and what is wrong with it: 1 to 50 pages pass this check. It is a report; no
    page is left out for it."""
    n = pages.groupBy("path").agg(F.coalesce(F.max("page_number"), F.lit(0)).alias("pages"))
    return n.withColumn("errors", F.array_compact(F.array(F.when(F.col("pages") < 1, "no page"), F.when(F.col("pages") > MOST_PAGES, "too many pages"))))


def recognized(lines: DataFrame) -> DataFrame:
    """Recognised lines (document, page_number, line_number, text) -> one text per page, lines joined."""
    ordered = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    return lines.groupBy("document", "page_number").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))


def document_texts(pages: DataFrame) -> DataFrame:
    """Page texts (document, page_number, text) -> one text per document, pages parted by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("document").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n").alias("text"))


def writable(spark: SparkSession, path: str) -> bool:
    """Whether a folder can be made and written, tried on the cluster's own file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    probe = jvm.org.apache.hadoop.fs.Path(folder, "_probe")
    try:
        fs.mkdirs(folder)
        fs.create(probe, True).close()
        return bool(fs.delete(probe, False))
    except Exception:  # the answer is no, whatever the store says
        return False
