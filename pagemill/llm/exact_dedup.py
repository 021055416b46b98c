"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its own bytes says so, so equal texts are cut alike wherever they lie.
Chunks are deduplicated by hash *and* bytes: a hash that stands for one content is a verified identifier, one that
stands for several (a clash) gets a rank for each content. Texts are equal exactly when their ordered lists of
identifiers are, so long texts move once, as chunks that are merged before the shuffle, and only lists meet after it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, without

MIN_CHUNK, MAX_CHUNK, MASK_BITS, SPAN = 1024, 16384, 12, 16
#: Clashing hashes that tasks are given as a list, so that only their chunks move; more are found by joins.
CLASHES = 1 << 16


def _gear() -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(b"chunk").digest(1024), np.uint32)


def cuts(data: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of data; each end depends only on the bytes before it within the chunk's reach."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    v = gear[np.frombuffer(data, np.uint8)]
    h = np.zeros(n - SPAN + 1, np.uint32)
    for k in range(SPAN):
        h += v[k : n - SPAN + 1 + k] << np.uint32(SPAN - 1 - k)
    marks = (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + SPAN).tolist()
    out, start = [], 0
    for m in marks:
        while m - start > MAX_CHUNK:
            start += MAX_CHUNK
            out.append(start)
        if m - start >= MIN_CHUNK and m < n:
            out.append(m)
            start = m
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        out.append(start)
    return [*out, n]


def _texts(column: pa.Array):
    for x in column.cast(pa.binary()):
        yield (x.as_py() or b"").lower()  # bytes.lower() changes A-Z only


def _signed(h: int, bits: int) -> int:
    h &= (1 << bits) - 1
    return h - (1 << 64) if h >= 1 << 63 else h


def _chunked(bits: int):
    gear = _gear()

    def parts(data: bytes) -> tuple[list[int], list[bytes]]:
        ends = cuts(data, gear)
        chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
        return [_signed(xxhash.xxh64_intdigest(c), bits) for c in chunks], chunks

    return parts


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: its columns but the text, and keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays.
    Nulls: a null text counts as the empty text; a null id never stays while its group has an id (keep_id is null, and
    kept true, where all ids of a group are null). Rows that repeat an id and a text count as one document, kept alike,
    and each adds to group_size. An empty table gives an empty result. Columns of docs that have an output's name give
    way to it. hash_bits narrows the chunk hash (tests use it to force clashes).
    """
    small_batches(docs.sparkSession)
    docs = without(docs, "keep_id", "group_size", "kept", "text_sha256", "recipe", "ranks")
    rest = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    at, others = docs.columns.index(text_col), [i for i, c in enumerate(docs.columns) if c != text_col]

    def recipe_rows(batches):
        parts = _chunked(hash_bits)
        for b in batches:
            shas, ids = [], []
            for data in _texts(b.column(at)):
                shas.append(hashlib.sha256(data).hexdigest())
                ids.append(parts(data)[0])
            cols = [b.column(i) for i in others] + [pa.array(shas, pa.string()), pa.array(ids, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in rest.fields] + ["text_sha256", "recipe"])

    def chunk_rows(batches, wanted=None):
        parts = _chunked(hash_bits)
        for b in batches:
            seen: dict = {}
            for data in _texts(b.column(0)):
                seen.update((x, None) for x in zip(*parts(data)) if wanted is None or x[0] in wanted)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.int64()), pa.array([c for _, c in seen], pa.binary())], names=["h", "chunk"])

    recipes = docs.mapInArrow(recipe_rows, T.StructType([*rest.fields, T.StructField("text_sha256", T.StringType()), T.StructField("recipe", T.ArrayType(T.LongType()))]))
    recipes = stored(recipes.withColumn("ranks", F.array().cast("array<int>")), "recipes")
    contents = docs.select(text_col).mapInArrow(chunk_rows, "h long, chunk binary").distinct()
    clashes = stored(contents.groupBy("h").count().where("count > 1").select("h"), "clashes")
    n = clashes.count()
    if n:
        wanted = frozenset(clashes.toArrow().column("h").to_pylist()) if n <= CLASHES else None
        if wanted:
            contents = docs.select(text_col).mapInArrow(lambda batches: chunk_rows(batches, wanted), "h long, chunk binary").distinct()
        recipes = _ranked(docs.select(text_col), recipes, clashes, contents, hash_bits, wanted)
    groups = recipes.groupBy("recipe", "ranks").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written, so that the join deals out both sides anew and Spark can split the tasks of a text that very many rows hold
    out = recipes.join(stored(groups, "groups"), ["recipe", "ranks"])
    return out.select(*[F.col(f"`{f.name}`") for f in rest.fields], "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _ranked(texts: DataFrame, recipes: DataFrame, clashes: DataFrame, contents: DataFrame, bits: int, wanted: frozenset | None) -> DataFrame:
    """Where hashes clash: rank the contents of each such hash, and give each recipe the ranks of its chunks.

    The sha256 of a text leads back to its chunks here; it is only an address, the ranks are by bytes. wanted: the
    clashing hashes, if they are few; then no other chunk leaves its task.
    """
    ranks = contents.join(clashes, "h").withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))

    def placed(batches):
        parts = _chunked(bits)
        for b in batches:
            rows = {}
            for data in _texts(b.column(0)):
                sha = hashlib.sha256(data).hexdigest()
                for i, (h, c) in enumerate(zip(*parts(data))):
                    if wanted is None or h in wanted:
                        rows[sha, i] = (h, c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int32()), pa.array([v[0] for v in rows.values()], pa.int64()), pa.array([v[1] for v in rows.values()], pa.binary())],
                names=["text_sha256", "pos", "h", "chunk"],
            )

    found = texts.mapInArrow(placed, "text_sha256 string, pos int, h long, chunk binary").join(ranks, ["h", "chunk"]).select("text_sha256", "pos", "rank").distinct()
    lists = found.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("r")).select("text_sha256", F.flatten(F.transform("r", lambda x: F.array(x.pos, x["rank"]))).alias("found"))
    return stored(recipes.drop("ranks").join(lists, "text_sha256", "left").withColumn("ranks", F.coalesce("found", F.array().cast("array<int>"))).select(recipes.columns), "ranked")
