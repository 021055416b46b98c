"""Whole runs: analysis of page images, their preprocessing, texts, and triplets from saved responses.

Each is a plan over all documents at once; a page's or table's failure is a row with an error, never a failed run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import prompts
from ..functions.text import stripped
from ..operators import conditions as C
from ..operators import grids as M
from ..operators import inference, kernels, models
from ..operators import knowledge as N
from ..operators import pixels as J
from ..operators import regions as R
from ..schemas import DOCUMENT_CLASSES, FAILED_QUALITY, PRESETS, TYPE_COLOURS
from ..sources import files, sinks
from ..sources.shared import kept


def cropped_pages(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pixels of relative boxes (path, region_id, x, y, width, height): path, region_id, height, width, data."""
    import numpy as np
    import pandas as pd

    j = pages.select("path", F.col("height").alias("ph"), F.col("width").alias("pw"), "data").join(boxes.select("path", "region_id", *("x", "y", F.col("width").alias("w"), F.col("height").alias("h"))), "path")
    box = G.clamped_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("pw"), F.col("ph"))
    cut_at = j.select("path", "region_id", *(v.alias(f"b_{k}") for k, v in box.items()), "ph", "pw", "data")

    def cut(batches):
        for b in batches:
            out = [(r.path, r.region_id, r.b_ph, r.b_pw, np.frombuffer(r.data, np.uint8).reshape(r.ph, r.pw)[r.b_py : r.b_py + r.b_ph, r.b_px : r.b_px + r.b_pw].tobytes()) for r in b.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["path", "region_id", "height", "width", "data"])

    return cut_at.mapInPandas(cut, "path string, region_id string, height int, width int, data binary")


def analyze(spark: SparkSession, input_dir: str, output_dir: str | None = None, provider: type[inference.Provider] = inference.Offline) -> dict[str, DataFrame]:
    """Layout of every page image, structure of every table region, and summaries; written where output_dir is given."""
    pages = files.page_images(spark, input_dir)
    asked = pages.where("error is null").select("path", "document", "page_number", "height", "width", prompts.regions(F.col("page_number"), F.col("width"), F.col("height")).alias("request"), sinks.png("height", "width", "data").alias("image"))
    layout = models.ask(asked, "layout", F.col("request"), provider, image="image").drop("request")
    regions = models.layout_regions(layout, "path", "document", "page_number")
    tables = regions.where("region_type = 'table'").select("path", "document", "page_number", "region_id", "x", "y", "width", "height", "confidence")
    crops = cropped_pages(pages, tables).select("path", "region_id", "height", "width", sinks.png("height", "width", "data").alias("image"))
    boxes = models.ask(crops, "structure_boxes", prompts.table(), provider, image="image")
    key = F.concat_ws("#", "path", "region_id")
    found = models.detected_boxes(boxes.withColumn("table_id", key), F.col("width"), F.col("height"), "table_id")
    summary = M.summary(M.parsed(found))
    failed = boxes.select(key.alias("table_id"), F.when(F.col("source") == "fallback", "no answer").alias("error"))
    joined = tables.withColumn("table_id", key).join(failed, "table_id").join(summary, "table_id", "left").withColumns({
        "rows": F.split_part("dimensions", F.lit("x"), F.lit(1)).try_cast("int"), "cols": F.split_part("dimensions", F.lit("x"), F.lit(2)).try_cast("int"),
        "confidence": R.combined_confidence(F.col("confidence"), F.coalesce("structure_confidence", F.lit(0.5))),
    })
    per_page = regions.groupBy("path", "document").agg(F.count(F.lit(1)).alias("n_regions"), F.count_if(F.col("region_type") == "table").alias("n_tables"))
    ok = joined.where("error is null").groupBy("path").agg(F.count(F.lit(1)).alias("n_ok"))
    documents = R.document_summary(per_page.join(ok, "path", "left").select(F.col("document").alias("doc_id"), "n_regions", "n_tables", F.coalesce("n_ok", F.lit(0)).alias("n_ok")))
    out = {"pages": pages, "regions": regions, "tables": joined, "documents": documents, "table_summary": R.table_summary(joined)}
    if output_dir:
        sinks.results_json(documents, f"{output_dir}/documents")
        sinks.regions_csv(regions, f"{output_dir}/regions")
        sinks.table_summary_json(joined, out["table_summary"], f"{output_dir}/table_summary")
        sinks.images(sinks.png_rows(annotated_pages(pages, regions), "annotated"), f"{output_dir}/annotated")
    return out


def pixel_rows(pages: DataFrame) -> DataFrame:
    """Pages as (image_id, y, x, g)."""
    p = pages.where("error is null").select(F.col("path").alias("image_id"), "width", "data")
    at = p.select("image_id", "width", "data", F.explode(F.sequence(F.lit(0), F.length("data") - 1)).alias("i"))
    return at.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), F.conv(F.hex(F.substring("data", F.col("i") + 1, F.lit(1))), 16, 10).cast("int").alias("g"))


def annotated_pages(pages: DataFrame, regions: DataFrame, style: str = "detailed") -> DataFrame:
    """Pages with the boxes of their regions (path, region_id, region_type, x, y, width, height, confidence, reading_order)
    drawn on them: path, document, page_number, height, width, data. Pages without regions stay as they are. A page's
    regions are few by nature."""
    import numpy as np
    import pandas as pd

    own = regions.select("path", "region_type", "x", "y", F.col("width").alias("w"), F.col("height").alias("h"), "confidence", (F.col("reading_order") - 1).alias("pos"))
    sized = own.join(pages.select("path", F.col("width").alias("pw_"), F.col("height").alias("ph_")), "path")
    box = G.clamped_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("pw_"), F.col("ph_"))
    line = F.greatest(F.lit(1), (F.lit(3) * F.col("confidence")).cast("int")) if style == "confidence_heatmap" else F.lit(3)
    lists = sized.withColumns({**box, "line": line}).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "px", "py", "pw", "ph", "line", "region_type"))).alias("boxes"))
    j = pages.where("error is null").select("path", "document", "page_number", "height", "width", "data").join(lists, "path", "left")
    gray = {k: round(0.299 * int(v[1:3], 16) + 0.587 * int(v[3:5], 16) + 0.114 * int(v[5:7], 16)) for k, v in TYPE_COLOURS.items()}

    def draw(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
                boxes = [(z["px"], z["py"], z["pw"], z["ph"], z["line"], gray.get(z["region_type"], 0)) for z in (r.boxes if r.boxes is not None else [])]
                yield pd.DataFrame([(r.path, r.document, r.page_number, r.height, r.width, kernels.outlined(img, boxes).tobytes())], columns=["path", "document", "page_number", "height", "width", "data"])

    return j.mapInPandas(draw, "path string, document string, page_number int, height int, width int, data binary")


def measured(pages: DataFrame) -> DataFrame:
    """Everything that the conditions need of a page, measured image by image: quality, ink columns, parts, lines, and
    from these the quarter turn, the skew, handwriting and layout. A page is worked on in strips, so memory does not grow
    with copies of its neighbourhoods. Quality agrees with operators/pixels.py, which has a row per pixel."""
    import pandas as pd

    from ..operators import parts

    def measure(batches):
        for b in batches:
            rows = [(r.path, *parts.page_measures(r.data, r.height, r.width)) for r in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", *parts.MEASURES])

    small = pages.where("error is null").select("path", "height", "width", "data")
    raw = small.mapInPandas(measure, "path string, " + ", ".join(f"{k} {v}" for k, v in parts.MEASURES.items()))
    angle, sure = C.rotation_decision(F.col("text_angle"), F.col("edge_angle"), F.col("aspect"))
    layout = C.layout_complexity(F.col("contours"), F.col("area_mean"), F.col("area_std"))
    return raw.withColumns({"turn": angle, "turn_confidence": sure, "layout": layout, "handwritten": F.col("handwriting") > 0.3})


def model_conditions(pages: DataFrame, provider: type[inference.Provider] = inference.Offline) -> DataFrame:
    """Conditions that a provider finds on page images: path, quality, found, recommendations, priority, success_rate,
    process (whether the page is worth working on), source. Turns are repaired and conflicts resolved; pages without an
    answer get the stand-in assessment."""
    asked = pages.where("error is null").select("path", prompts.condition(F.col("width"), F.col("height"), F.lit("gray")).alias("request"), sinks.png("height", "width", "data").alias("image"))
    answered = models.ask(asked, "condition", F.col("request"), provider, image="image")
    typed = lambda field, first: F.transform(F.coalesce(F.col(f"answer.{field}"), F.array()), lambda c: F.struct(c["condition"].alias("condition"), c["severity"].alias("severity"), c["confidence"].alias("confidence"), c["evidence"].alias("evidence"), F.coalesce(c["recommended_actions"], F.array()).alias("actions"), F.lit(first).alias("is_primary")))
    every = F.transform(F.concat(typed("primary_issues", True), typed("secondary_issues", False)), lambda c, i: F.struct((i + 1).alias("pos"), *[c[k].alias(k) for k in ("condition", "severity", "confidence", "evidence", "actions", "is_primary")]))
    good = answered.where("source = 'model'").select("path", F.coalesce("answer.overall_quality", F.lit(FAILED_QUALITY)).alias("quality"), every.alias("found"), "source")
    good = C.enhanced(C.repaired(good))
    failed = C.fallback(answered.where("source <> 'model'").select("path", "source")).withColumn("found", F.lit(None).cast(good.schema["found"].dataType))
    columns = ("path", "quality", "found", "recommendations", "priority", "success_rate", "source")
    both = good.select(*columns).unionByName(failed.select(*columns))
    return both.withColumn("process", C.worth_processing(F.col("recommendations"), F.col("priority"), F.col("success_rate")))


LEVELS = ("basic", *PRESETS, "custom")


def preprocess(spark: SparkSession, input_dir: str, output_dir: str | None = None, level: str | None = None, custom: tuple[str, ...] = (), provider: type[inference.Provider] | None = None) -> dict[str, DataFrame]:
    """Measure every page, assess its condition, and apply the actions where that is worth it.

    With a provider the conditions are those that it finds on the page, and a page is worked on if there is a
    recommendation, its priority is high and it is not good as it is (conditions.worth_processing).

    level does something else to every page: basic (contrast, sharpness, gamma), the fixed actions of intermediate and
    advanced, or custom, the given actions in the engine's order. Pages that need nothing, or can't be read, come back as
    they are. improvement is estimated for pages that were worked on; documents counts pages preprocessed and skipped.
    """
    if level is not None and level not in LEVELS:
        raise ValueError(f"level: one of {LEVELS}")
    if level == "custom" and not custom:
        raise ValueError("custom: the actions of the level")
    pages = kept(files.page_images(spark, input_dir), "pages")
    m = kept(measured(pages), "measures")
    content = C.of_content(F.col("handwritten"), F.col("handwriting"), F.col("columns"), F.col("layout"))
    turn = F.array_compact(F.array(C.of_rotation(F.col("turn"), F.col("turn_confidence")), C.of_skew(F.col("skew"), F.col("skew_confidence"))))
    every = F.concat(turn, C.of_quality(*(F.col(c) for c in ("contrast", "brightness", "sharpness", "noise"))), content)
    typed = F.transform(every, lambda c, i: F.struct((i + 1).alias("pos"), c["condition"].alias("condition"), c["severity"].alias("severity"), c["confidence"].alias("confidence"), c["evidence"].alias("evidence"), c["actions"].alias("actions"), c["severity"].isin("severe", "moderate").alias("is_primary")))
    assessed = C.assessed(m.withColumn("found", typed))
    gate = C.first_is_action(F.col("recommendations"))
    if provider is not None:
        assessed, gate = kept(model_conditions(pages, provider), "assessed"), F.col("process")
        assessed = assessed.withColumns({"primary_issues": F.filter("found", lambda c: c["is_primary"]), "notes": C.special_notes(F.col("found"))})
    fixed = {"basic": ("basic",), "custom": custom, **PRESETS}.get(level)
    actions = F.array(*map(F.lit, fixed)) if level else F.when(gate, F.col("recommendations")).otherwise(F.array().cast("array<string>"))
    images = pages.where("error is null").join(assessed.select("path", C.grouped_order(actions).alias("actions")), "path").select(F.col("path").alias("image_id"), "height", "width", "data", "actions")
    done = kept(kernels.apply_actions(images), "images")
    named = done.join(pages.select(F.col("path").alias("image_id"), "document", "page_number"), "image_id")
    issues = assessed.select(F.explode("primary_issues").alias("c")).groupBy("c.condition").agg(F.count(F.lit(1)).alias("n"))
    report = page_report(pages, m, done)
    documents = report.groupBy("document").agg(F.count(F.lit(1)).alias("total_pages"), F.count_if(F.size("applied") > 0).alias("pages_preprocessed"), F.count_if(F.size("applied") == 0).alias("pages_skipped"), F.avg("improvement").alias("improvement"))
    if output_dir:
        sinks.images(sinks.png_rows(named), f"{output_dir}/images")
        sinks.results_json(assessed.select("path", "quality", "priority", "success_rate", "recommendations", "notes"), f"{output_dir}/assessments")
        sinks.results_json(report, f"{output_dir}/pages")
    return {"assessments": assessed, "images": named, "issues": issues, "pages": report, "documents": documents}


def page_report(pages: DataFrame, measures: DataFrame, done: DataFrame) -> DataFrame:
    """One row per page: size, aspect, what was measured (as JSON), what was applied, the estimated improvement (0.5 where
    it can't be told, null for pages not worked on), error, and when the report was made."""
    facts = measures.select("path", F.to_json(F.struct([c for c in measures.columns if c not in ("path", "laplacian", "deviation")])).alias("results"), "laplacian", "deviation")
    again = measured(done.where(F.size("applied") > 0).select(F.col("image_id").alias("path"), "height", "width", "data", F.lit(None).cast("string").alias("error")))
    gain = lambda a, b: (F.col(b) - F.col(a)) / F.greatest(F.col(a), F.lit(1.0))
    after = again.select("path", F.col("deviation").alias("deviation_"), F.col("laplacian").alias("laplacian_"))
    j = pages.select("path", "document", "page_number", "width", "height", "error").join(facts, "path", "left").join(done.select(F.col("image_id").alias("path"), "applied"), "path", "left").join(after, "path", "left")
    value = F.least(F.greatest(0.6 * gain("deviation", "deviation_") + 0.4 * gain("laplacian", "laplacian_") + 0.5, F.lit(0.0)), F.lit(1.0))
    applied = F.coalesce("applied", F.array().cast("array<string>"))
    return j.select(
        "path", "document", "page_number", "width", "height", G.aspect(F.col("width"), F.col("height")).alias("aspect"), "results", applied.alias("applied"),
        F.when(F.size(applied) > 0, F.coalesce(value, F.lit(0.5))).alias("improvement"), "error", F.current_timestamp().alias("made_at"),
    )


def quality_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """Estimated improvement of each image; both as (image_id, y, x, g)."""
    return J.improvement(before, after)


def response_triplets(spark: SparkSession, responses_dir: str) -> dict[str, DataFrame]:
    """Rule-based triplets of all tables of saved responses, and their distributions."""
    rows = N.response_rows(files.saved_responses(spark, responses_dir))
    triplets = N.rule_triplets_of_maps(rows)
    return {"rows": rows, "triplets": triplets, "by_predicate": N.distribution(triplets, "predicate"), "by_table": N.distribution(triplets, "table_id")}


def model_triplets(rows: DataFrame, provider: type[inference.Provider]) -> DataFrame:
    """Triplets that a provider finds in tables' rows (table_id, pos, row_header, data), resolved; tables without an
    answer get rule-based ones."""
    line = F.concat(F.lit("Row "), F.col("pos").cast("string"), F.lit(": "), F.to_json("data"))
    asked = N.shown_rows(rows).withColumn("line", line).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]).alias("lines"))
    answered = models.ask(asked, "triplets", prompts.triplets(F.lit("table"), F.col("lines")), provider)
    entities, relations = models.mention_tables(answered.where("source = 'model'"), "table_id")
    good = N.resolved(entities, relations).select(F.col("doc_id").alias("table_id"), F.col("subject_name").alias("subject"), "predicate", F.col("object_name").alias("object"), F.lit("model").alias("method"))
    rest = rows.join(answered.where("source <> 'model'").select("table_id"), "table_id", "left_semi")
    return good.unionByName(N.rule_triplets_of_maps(rest).select("table_id", "subject", "predicate", "object", F.lit("rules").alias("method")))


def text_triplets(texts: DataFrame, provider: type[inference.Provider] = inference.Offline) -> DataFrame:
    """Triplets of plain texts (table_id, text): each is a table of one row with the key `content`."""
    rows = texts.select("table_id", F.lit(1).alias("pos"), F.lit(None).cast("string").alias("row_header"), F.create_map(F.lit("content"), F.col("text")).alias("data"))
    return model_triplets(rows, provider)


def document_classes(docs: DataFrame, provider: type[inference.Provider] = inference.Offline) -> DataFrame:
    """doc_id, doc_class, source: the provider's label, stripped, of each text's first characters (the classifier's reach);
    the rules' where it gives none."""
    asked = docs.select("doc_id", prompts.classify(DOCUMENT_CLASSES, F.coalesce("text", F.lit(""))).alias("request"), inference.rule_class(F.col("text")).alias("by_rule"))
    answered = models.ask(asked, "document_class", F.col("request"), provider)
    return answered.select("doc_id", F.coalesce(stripped(F.col("answer.doc_class")), F.col("by_rule")).alias("doc_class"), "source")


def table_contents(crops: DataFrame, provider: type[inference.Provider] = inference.Offline) -> DataFrame:
    """What table regions say: table_id, rows, cols, structure_confidence, headers, cells, data_rows, main_topic, method.

    crops: table_id, height, width, data. The provider reads each picture; of its tables the first counts. A region
    without an answer gets the fall-back table. Cells are row by row, the header row first.
    """
    asked = crops.select("table_id", sinks.png("height", "width", "data").alias("image"))
    answered = models.ask(asked, "table_content", prompts.content(), provider, image="image")
    good = answered.where("source = 'model' and size(answer.tables) > 0").select("table_id", F.col("answer.tables")[0].alias("t"), "answer.table_summary.main_topic", F.coalesce("answer.extraction_metadata.confidence", F.lit(0.8)).alias("sure"))
    lines = good.select("table_id", F.posexplode("t.data_relationships").alias("i", "r"))
    rows = lines.select("table_id", (F.col("i") + 1).alias("row"), "r.row_header", "r.values", "r.single_value")
    cells = N.semantic_cells(rows).select("table_id", "row", "col", "content", "cell_type", "confidence")
    cells = cells.unionByName(N.column_header_cells(good.select("table_id", F.col("t.headers").alias("headers"))))
    cell = F.struct("row", "col", "content", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), "cell_type", "confidence")
    lists = cells.groupBy("table_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))  # one picture's table
    data = N.data_rows(rows).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.map_entries("data").alias("d")))), lambda s: F.map_from_entries(s["d"])).alias("data_rows"))
    made = good.join(lists, "table_id", "left").join(data, "table_id", "left").select(
        "table_id", F.size(F.coalesce("t.data_relationships", F.array())).alias("rows"), F.coalesce("t.structure.columns", F.lit(2)).alias("cols"), F.col("sure").alias("structure_confidence"), F.col("t.headers.column_headers").alias("headers"),
        "cells", "data_rows", "main_topic", F.lit("structured_semantic").alias("method"),
    )
    failed = N.fallback_tables(answered.select("table_id").join(good.select("table_id"), "table_id", "left_anti"))
    return made.unionByName(failed.select("table_id", "rows", "cols", "structure_confidence", "headers", "cells", "data_rows", F.lit(None).cast("string").alias("main_topic"), F.lit("simple_fallback").alias("method")))


def classify(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Recognised lines (document, page_number, line_number, text) -> document, text, doc_class."""
    return inference.classified(files.document_texts(files.recognized(lines)))


def region_texts(regions: DataFrame, provider: type[inference.Provider]) -> DataFrame:
    """Texts of the text regions of layouts (path, region_id, region_type, reading_order): path, region_id, extracted_text,
    confidence. Where a provider's answer can't be parsed, its raw text is dealt out by blank lines; where there is none,
    regions have no text."""
    own = R.text_regions(regions)
    asked = own.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "region_id"))), lambda s: s["region_id"]).alias("ids"))
    answered = models.ask(asked, "region_text", prompts.region_text(F.col("ids")), provider)
    good = answered.where("source = 'model'").select("path", F.explode("answer.texts").alias("t")).select("path", "t.region_id", "t.extracted_text", "t.confidence")
    failed = answered.where("source <> 'model' and raw is not null")
    places = failed.select(F.col("path").alias("doc_id"), F.posexplode("ids").alias("pos", "region_id"))
    parts = R.parts_for_regions(places, failed.select(F.col("path").alias("doc_id"), F.col("raw").alias("text")))
    return good.unionByName(parts.select(F.col("doc_id").alias("path"), "region_id", "extracted_text", "confidence"))
