"""The model tasks of the pipeline, each a request, an answer's schema and what stands in for a failed answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import geometry as G
from .inference import Offline, Provider, inferred

_STRING, _DOUBLE, _INT = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DETECTION = _struct(label_id=_INT, score=_DOUBLE, x1=_DOUBLE, y1=_DOUBLE, x2=_DOUBLE, y2=_DOUBLE)
EXTRACTED = _struct(name=_STRING, entity_type=_STRING, aliases=T.ArrayType(_STRING), confidence=_DOUBLE, value=_STRING, unit=_STRING)
RELATED = _struct(subject_name=_STRING, predicate=_STRING, object_name=_STRING, confidence=_DOUBLE, evidence=_STRING, context=_STRING)
FOUND = _struct(condition=_STRING, severity=_STRING, confidence=_DOUBLE, evidence=_STRING, recommended_actions=T.ArrayType(_STRING))

#: Task -> schema of its answer. The second field of each is the one that an answer must have.
TASKS: dict[str, T.StructType] = {
    "layout": S.LAYOUT,
    "table_structure": _struct(table_id=_STRING, rows=_INT, cols=_INT, cells=T.ArrayType(S.CELL), structure_confidence=_DOUBLE),
    "region_text": _struct(document_id=_STRING, texts=T.ArrayType(_struct(region_id=_STRING, extracted_text=_STRING, confidence=_DOUBLE))),
    "condition": _struct(overall_quality=_STRING, primary_issues=T.ArrayType(FOUND), secondary_issues=T.ArrayType(FOUND), estimated_success_rate=_DOUBLE),
    "table_content": S.SEMANTIC_RESULT,
    "insights": _struct(table_id=_STRING, insights=T.ArrayType(S.INSIGHT)),
    "triplets": _struct(quality_assessment=_STRING, entities=T.ArrayType(EXTRACTED), relations=T.ArrayType(RELATED)),
    "document_class": _struct(document_id=_STRING, doc_class=_STRING),
    "structure_boxes": _struct(document_id=_STRING, detections=T.ArrayType(DETECTION)),
    "layout_boxes": _struct(document_id=_STRING, detections=T.ArrayType(DETECTION)),
    "cell_text": _struct(document_id=_STRING, cells=T.ArrayType(_struct(row_start=_INT, row_end=_INT, col_start=_INT, col_end=_INT, text=_STRING))),
}


@dataclass(frozen=True)
class Parameters:
    """A model's settings; wrong ones are errors at once."""

    model: str
    models: tuple[str, ...]
    temperature: float = 0.0
    max_tokens: int = 4096

    def __post_init__(self):
        if self.model not in self.models:
            raise ValueError(f"model: one of {self.models}")
        if not 0 <= self.temperature <= 2:
            raise ValueError("temperature: 0 to 2")
        if not 100 <= self.max_tokens <= 8192:
            raise ValueError("max_tokens: 100 to 8192")


def ask(df: DataFrame, task: str, request: Column, provider: type[Provider] = Offline, fallback: Column | None = None, image: str | None = None) -> DataFrame:
    """df, without the image column, with the task's answer, its source (model or fallback) and raw text."""
    return inferred(df, request, TASKS[task], provider, fallback, image)


def layout_regions(answered: DataFrame, *keys: str) -> DataFrame:
    """Regions of layouts, without those whose box is not strictly valid: keys, region_id, region_type, x, y, width, height,
    confidence, content_description, reading_order."""
    r = answered.select(*keys, F.posexplode("answer.regions").alias("i", "r"))
    flat = r.select(
        *keys, F.coalesce("r.region_id", F.concat(F.lit("region_"), F.col("i").cast("string"))).alias("region_id"), "r.region_type", *(F.col(f"r.bbox.{c}").alias(c) for c in ("x", "y", "width", "height")),
        "r.confidence", "r.content_description", F.coalesce("r.reading_order", F.col("i") + 1).alias("reading_order"),
    )
    return flat.where(G.valid(F.col("x"), F.col("y"), F.col("width"), F.col("height")))


def detected_boxes(answered: DataFrame, width: Column, height: Column, *keys: str) -> DataFrame:
    """Detections in pixels -> relative boxes with their position: keys, pos, label_id, score, x, y, w, h."""
    d = answered.withColumns({"_w": width, "_h": height}).select(*keys, "_w", "_h", F.posexplode("answer.detections").alias("i", "d"))
    b = G.relative_box(F.col("d.x1"), F.col("d.y1"), F.col("d.x2"), F.col("d.y2"), F.col("_w"), F.col("_h"))
    return d.select(*keys, (F.col("i") + 1).alias("pos"), "d.label_id", "d.score", b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("w"), b["height"].alias("h"))


def best_table(detections: DataFrame) -> DataFrame:
    """The best-scoring table box of each table_id; the first on a tie."""
    return detections.where("label_id = 0").groupBy("table_id").agg(F.max_by(F.struct("pos", "score", "x", "y", "w", "h"), F.struct(F.col("score"), -F.col("pos"))).alias("b")).select("table_id", "b.*")


def mention_tables(answered: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of triplet answers, in the shape that knowledge.resolved() takes."""
    e = answered.select(F.col(doc).alias("doc_id"), F.posexplode("answer.entities").alias("pos", "e")).select("doc_id", "pos", "e.name", "e.entity_type")
    r = answered.select(F.col(doc).alias("doc_id"), F.posexplode("answer.relations").alias("pos", "r")).select("doc_id", "pos", "r.subject_name", "r.predicate", "r.object_name", "r.evidence")
    return e, r
