"""Knowledge: entities, relations, triplets, semantic table rows, graphs and ontologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FALLBACK_TABLE


def ends(relations: DataFrame) -> DataFrame:
    """Both names of each relation: (doc_id, name, pos, evidence)."""
    side = lambda c: F.struct(F.col(c).alias("name"), F.col("pos"), F.col("evidence"))
    return relations.select("doc_id", F.explode(F.array(side("subject_name"), side("object_name"))).alias("e")).select("doc_id", "e.*")


def names(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, name, entity_type, known, first_pos, evidence): every name of a document once, by one shuffle of mentions and
    relations together. Of a name's mentions the last one gives the type; a name that only relations use is not known."""
    said = entities.select("doc_id", "name", F.col("pos").alias("said_at"), "entity_type", F.lit(None).cast("struct<pos:bigint,evidence:string>").alias("used"))
    used = ends(relations).select("doc_id", "name", F.lit(None).cast("bigint").alias("said_at"), F.lit(None).cast("string").alias("entity_type"), F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("evidence").cast("string").alias("evidence")).alias("used"))
    every = said.withColumn("said_at", F.col("said_at").cast("bigint")).unionByName(used).groupBy("doc_id", "name")
    out = every.agg(F.max_by("entity_type", "said_at").alias("entity_type"), (F.count("said_at") > 0).alias("known"), F.min("used").alias("used"))
    return out.select("doc_id", "name", "entity_type", "known", F.col("used.pos").alias("first_pos"), F.col("used.evidence").alias("evidence"))


def missing(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Names in relations that no entity has, with the first relation that uses them and its evidence."""
    return names(entities, relations).where("not known").select("doc_id", "name", "first_pos", "evidence")


def resolved(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Triplets: each relation with the types of both ends; unknown names become entities of type other (confidence 0.7,
    with the evidence of the first relation that used them); has_auto_created tells whether one was met up to here.

    The running flag is a comparison with the document's first relation that has an unknown name, not a window, so a
    document with very many relations is not one task's.
    """
    every = names(entities, relations)
    start = every.where("not known").groupBy("doc_id").agg(F.min("first_pos").alias("start"))
    kind = F.when(F.col("known"), F.col("entity_type")).otherwise("other")
    end = lambda p: every.select("doc_id", F.col("name").alias(f"{p}_name"), kind.alias(f"{p}_type"), (~F.col("known")).alias(f"{p}_auto"), F.when(~F.col("known"), F.col("evidence")).alias(f"{p}_source"))
    out = relations.join(end("subject"), ["doc_id", "subject_name"], "left").join(end("object"), ["doc_id", "object_name"], "left").join(start, "doc_id", "left")
    return out.select("doc_id", "pos", "subject_name", "subject_type", "subject_auto", "predicate", "object_name", "object_type", "object_auto", F.coalesce("subject_source", "object_source").alias("auto_source"), F.coalesce(F.col("pos") >= F.col("start"), F.lit(False)).alias("has_auto_created"))


def rule_triplets(rows: DataFrame, keys: list[str], first: int = 3) -> DataFrame:
    """(table_id, pos, subject, predicate, object, confidence, sentence) from the first rows of each table: one per key
    with a value: not null, the empty text, zero or false. rows: table_id, pos (from 1), row_header, keys; a missing
    header is parameter_i (from 0)."""
    subject = F.coalesce("row_header", F.concat(F.lit("parameter_"), (F.col("pos") - 1).cast("string")))
    kinds = dict(rows.dtypes)

    def value(k):
        held = F.col(k) if kinds[k] == "boolean" else F.col(k) != ("" if kinds[k] == "string" else 0)
        return F.when(held, F.col(k).cast("string"))

    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in keys]))
    out = rows.where(F.col("pos") <= first).select("table_id", "pos", subject.alias("subject"), pairs.alias("p")).where("p.value <> ''")
    return out.select("table_id", "pos", "subject", F.lit("related_to").alias("predicate"), F.col("p.value").alias("object"), F.lit(0.6).alias("confidence"), F.concat_ws(" ", "subject", F.lit("has"), "p.key", F.lit("of"), "p.value").alias("sentence"))


def distribution(triplets: DataFrame, by: str) -> DataFrame:
    return triplets.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def end_types(triplets: DataFrame) -> DataFrame:
    """Entity types over both ends of triplets."""
    return triplets.select(F.explode(F.array("subject_type", "object_type")).alias("entity_type")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def distinct_entities(triplets: DataFrame) -> DataFrame:
    """Distinct (name, type) pairs over both ends, counted by type."""
    pairs = triplets.select(F.explode(F.array(F.struct(F.col("subject_name").alias("name"), F.col("subject_type").alias("entity_type")), F.struct(F.col("object_name").alias("name"), F.col("object_type").alias("entity_type")))).alias("e"))
    return pairs.select("e.*").distinct().groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def degrees(triplets: DataFrame) -> DataFrame:
    """Graph nodes with their out- and in-degree: (doc_id, name, out_degree, in_degree)."""
    side = triplets.select("doc_id", F.explode(F.array(F.struct(F.col("subject_name").alias("name"), F.lit(1).alias("o")), F.struct(F.col("object_name").alias("name"), F.lit(0).alias("o")))).alias("e"))
    return side.groupBy("doc_id", "e.name").agg(F.sum("e.o").alias("out_degree"), F.sum(1 - F.col("e.o")).alias("in_degree"))


def graph(triplets: DataFrame) -> DataFrame:
    """One row per document: entities, relations, distinct predicates."""
    nodes = degrees(triplets).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"))
    edges = triplets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_relations"), F.countDistinct("predicate").alias("n_predicates"))
    return nodes.join(edges, "doc_id")


def ontology(entities: DataFrame) -> DataFrame:
    """One class per entity type: its number of instances, its first and last name, its parent. The instances themselves
    are rows, see instances(): a type can have very many."""
    return instances(entities).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_instances"), F.min("name").alias("first_name"), F.max("name").alias("last_name")).withColumn("parent", F.lit("entity"))


def instances(entities: DataFrame) -> DataFrame:
    """(entity_type, name, documents): each instance of a class once, with how many documents name it."""
    return entities.groupBy("entity_type", "name").agg(F.count_distinct("doc_id").alias("documents"))


def entity(name: Column, entity_type: Column, source: Column | None = None, confidence: float = 0.8) -> Column:
    """An entity's struct; its aliases are none."""
    return F.struct(name.alias("name"), entity_type.alias("entity_type"), F.array().cast("array<string>").alias("aliases"), F.lit(confidence).alias("confidence"), (F.lit(None).cast("string") if source is None else source).alias("source_text"))


def triplet(subject: Column, predicate: Column, object_: Column, sentence: Column, page: Column, confidence: float = 0.8) -> Column:
    """A triplet's struct of two entities."""
    return F.struct(subject.alias("subject"), predicate.alias("predicate"), object_.alias("object"), F.lit(confidence).alias("confidence"), sentence.alias("source_sentence"), page.alias("page_number"))


def data_rows(rows: DataFrame) -> DataFrame:
    """Semantic rows as data rows: `value` from a single value where there are no values, else the values; notes last."""
    single = (F.coalesce("single_value", F.lit("")) != "") & (F.coalesce(F.size("values"), F.lit(0)) <= 0)
    body = F.when(single, F.create_map(F.lit("value"), F.col("single_value"))).otherwise(F.coalesce("values", F.create_map().cast("map<string,string>")))
    return rows.withColumn("data", body).withColumn("is_single", single)


def semantic_cells(rows: DataFrame) -> DataFrame:
    """(row key, col, content, cell_type, confidence): the row's header in column 0, its values from column 1 on; a null
    value is the empty string."""
    body = data_rows(rows)
    key = [c for c in rows.columns if c not in ("row_header", "values", "single_value")]
    head = body.select(*key, F.lit(0).alias("col"), F.col("row_header").alias("content"), F.lit("header").alias("cell_type"), F.lit(0.9).alias("confidence"))
    data = body.select(*key, F.posexplode(F.map_values("data")).alias("i", "v")).select(*key, (F.col("i") + 1).alias("col"), F.coalesce("v", F.lit("")).alias("content"), F.lit("data").alias("cell_type"), F.lit(0.85).alias("confidence"))
    return head.unionByName(data)


def column_header_cells(tables: DataFrame) -> DataFrame:
    """Column headers of semantic tables as cells of row 0, from column 1 on."""
    return tables.select("table_id", F.posexplode("headers.column_headers").alias("i", "content")).select("table_id", F.lit(0).alias("row"), (F.col("i") + 1).alias("col"), "content", F.lit("header").alias("cell_type"), F.lit(0.9).alias("confidence"))


def extractor_input(tables: DataFrame) -> DataFrame:
    """Semantic tables as extractor inputs, with the defaults of missing fields."""
    rel = F.coalesce("table.data_relationships", F.array())
    return tables.select(
        F.coalesce("table.table_id", F.lit("unknown")).alias("table_id"), F.size(rel).alias("rows"), F.coalesce("table.structure.columns", F.lit(2)).alias("cols"),
        F.coalesce("extraction_metadata.confidence", F.lit(0.8)).alias("confidence"), F.coalesce("extraction_metadata.detected_language", F.lit("unknown")).alias("language"),
        F.coalesce("table_summary.document_type", F.lit("unknown")).alias("document_type"), F.coalesce("table_summary.total_tables", F.lit(1)).alias("total_tables"),
    )


def shown_rows(rows: DataFrame, head: int = 20, tail: int = 3, over: int = 25) -> DataFrame:
    """The rows that a prompt shows: the first ones, and the last ones of tables longer than `over`."""
    n = F.count(F.lit(1)).over(Window.partitionBy("table_id"))
    return rows.withColumn("n", n).where((F.col("pos") <= head) | ((F.col("n") > over) & (F.col("pos") > F.col("n") - tail))).drop("n")


def row_line(pos: Column, keys: list[str]) -> Column:
    """A row as a prompt's line: its values as JSON with blanks after `:` and `,`; null values stay."""
    one = lambda k: F.concat(F.to_json(F.array(F.lit(k))), F.lit(": "), F.to_json(F.array(F.col(k)), {"ignoreNullFields": "false"}))
    body = F.concat_ws(", ", *[F.regexp_replace(one(k), r"^\[(.*)\]: \[((?s).*)\]$", "$1: $2") for k in keys])
    return F.concat(F.lit("Row "), pos.cast("string"), F.lit(": {"), body, F.lit("}"))


def shown_values(values: Column) -> Column:
    """The values of a row that a list shows: those with text."""
    return F.map_filter(values, lambda k, v: v != "")


def fallback_tables(failed: DataFrame) -> DataFrame:
    """What stands in for a table whose extraction failed: 2 by 2, confidence 0.3, its headers, cells and one data row."""
    cell = lambda r, c, text, kind: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(text).alias("content"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(kind).alias("cell_type"), F.lit(0.3).alias("confidence"))
    (h0, h1), (v0, v1) = FALLBACK_TABLE
    return failed.withColumns({
        "rows": F.lit(2), "cols": F.lit(2), "structure_confidence": F.lit(0.3), "headers": F.array(F.lit(h0), F.lit(h1)),
        "cells": F.array(cell(0, 0, h0, "header"), cell(0, 1, h1, "header"), cell(1, 0, v0, "data"), cell(1, 1, v1, "data")),
        "data_rows": F.array(F.create_map(F.lit(h0), F.lit(v0), F.lit(h1), F.lit(v1))), "extraction_method": F.lit("manual"),
    })


def rule_triplets_of_maps(rows: DataFrame, first: int = 3) -> DataFrame:
    """rule_triplets() for rows whose values are a map of texts (table_id, pos, row_header, data): one per key with a
    value, which is any text but the empty one."""
    subject = F.coalesce("row_header", F.concat(F.lit("parameter_"), (F.col("pos") - 1).cast("string")))
    out = rows.where(F.col("pos") <= first).select("table_id", "pos", subject.alias("subject"), F.explode("data").alias("key", "object")).where("key <> 'row_header' and object <> ''")
    return out.select("table_id", "pos", "subject", F.lit("related_to").alias("predicate"), "object", F.lit(0.6).alias("confidence"), F.concat_ws(" ", "subject", F.lit("has"), "key", F.lit("of"), "object").alias("sentence"))


def response_rows(responses: DataFrame) -> DataFrame:
    """Saved responses (one row per table) -> their rows as data rows: table_id, page_number, pos, row_header, data; a
    row's notes are a key of their own, last."""
    key = F.concat_ws("_", F.lit("page"), F.coalesce(F.col("page_number"), F.col("table_index")).cast("string"), F.lit("table"), F.col("table_index").cast("string"))
    r = responses.select(key.alias("table_id"), F.coalesce("page_number", "table_index").alias("page_number"), F.posexplode("table.data_relationships").alias("i", "r"))
    flat = data_rows(r.select("table_id", "page_number", (F.col("i") + 1).alias("pos"), "r.row_header", "r.values", "r.single_value", "r.row_notes"))
    noted = F.coalesce(F.col("row_notes"), F.lit("")) != ""
    plain = F.map_filter("data", lambda k, v: k != "notes")
    return flat.select("table_id", "page_number", "pos", "row_header", F.when(noted, F.map_concat(plain, F.create_map(F.lit("notes"), F.col("row_notes")))).otherwise(F.col("data")).alias("data"))
