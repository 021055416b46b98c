"""Model calls as providers: an interface, an offline provider that is deterministic, and the fall-back path.

No model or network is assumed. A provider turns a batch of requests, each a prompt with the picture it is about, into
JSON strings; its answers are parsed against a schema, and those that do not parse go the fall-back way instead of
failing the job. Requests are deduplicated by hash before the provider sees them, so that copies of one image or text
cost one call, and answers are written once, so that using them several times does not ask again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import document_class
from ..sources.shared import kept


class Request(str):
    """A prompt; image: the bytes of the picture that it is about, or None."""

    image: bytes | None = None

    @classmethod
    def of(cls, text: str, image: bytes | None) -> Request:
        out = cls(text)
        out.image = None if image is None else bytes(image)
        return out


class Provider(Protocol):
    """Made once in each Python worker, on its first batch."""

    def answer(self, requests: list[Request]) -> list[str | None]:
        """One JSON answer per request; None where there is none."""


class Offline:
    """The deterministic provider: every text is one text region of the whole page."""

    def answer(self, requests: list[Request]) -> list[str | None]:
        out: list[str | None] = []
        for r in requests:
            region = {"region_id": "region_1_0", "region_type": "text", "bbox": {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0}, "confidence": 0.5, "content_description": r[:100], "page_number": 1, "reading_order": 1}
            out.append(json.dumps({"document_id": None, "page_number": 1, "regions": [region] if r.strip() else [], "total_regions": int(bool(r.strip()))}))
        return out


def parsed(raw: Column, schema: T.StructType) -> Column:
    """An answer against its schema, null fields where it does not fit. Where a list is due and one value stands, it is a
    list of one."""
    out = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    for name in [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)]:
        alone = T.StructType([T.StructField(f.name, f.dataType.elementType if f.name == name else f.dataType) for f in schema.fields])
        one = F.from_json(raw, alone, {"mode": "PERMISSIVE"})
        whole = F.struct(*[(F.array(one[f.name]) if f.name == name else one[f.name]).alias(f.name) for f in schema.fields])
        out = F.when(~F.get_json_object(raw, f"$.{name}").startswith("["), whole).otherwise(out)
    return out


def inferred(df: DataFrame, request: Column, schema: T.StructType, provider: type[Provider] = Offline, fallback: Column | None = None, image: str | None = None) -> DataFrame:
    """df with answer (schema), source (model or fallback) and raw. Failing batches give null answers, never a failed job.

    image: the column with the picture's bytes; it goes to the provider with the prompt and is not in the result, so
    that pictures are not joined back. Answers are asked for once for each different request and written before use. A
    null request counts as the empty one.
    """
    picture = F.col(image) if image else F.lit(None).cast("binary")
    text = F.coalesce(request, F.lit(""))
    keyed = df.withColumns({"_request": text, "_key": F.concat(F.sha2(text, 256), F.coalesce(F.sha2(picture, 256), F.lit("")))})

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = provider()
        for b in batches:
            try:
                raw = made.answer([Request.of(r, i) for r, i in zip(b["_request"], b["_image"])])
            except Exception:  # a provider's failure is the fall-back's case
                raw = [None] * len(b)
            yield pd.DataFrame({"_key": b["_key"], "raw": raw})

    # what a provider sees: one row for each different request
    once = keyed.select("_key", "_request", picture.alias("_image")).dropDuplicates(["_key"]).mapInPandas(call, "_key string, raw string")
    answers = kept(once, "answers").withColumn("answer", parsed(F.col("raw"), schema))
    rest = keyed.drop("_request", *([image] if image else []))
    out = rest.join(answers, "_key", "left")
    first = schema.fields[0].name if len(schema.fields) == 1 else schema.fields[1].name
    fits = F.col(f"answer.{first}").isNotNull()
    if fallback is not None:
        out = out.withColumn("answer", F.when(fits, F.col("answer")).otherwise(fallback))
    return out.withColumn("source", F.when(fits, "model").otherwise("fallback")).drop("_key")


#: Offline rules of the document classifier: class and the words that speak for it, in order.
CLASS_RULES = (
    ("Contract", ("agreement", "licensed", "contract")),
    ("Purchase Order", ("purchase order", "invoice", "order no")),
    ("Financial Report", ("balance sheet", "fiscal", "revenue")),
    ("Conference Paper", ("abstract", "proceedings", "references")),
    ("Technical Manual", ("manual", "voltage", "installation")),
)


def rule_class(text: Column) -> Column:
    return document_class(F.coalesce(text, F.lit("")), CLASS_RULES)


def classified(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with doc_class, by the offline rules over the classifier's reach."""
    return docs.withColumn("doc_class", rule_class(F.col(text_col)))
