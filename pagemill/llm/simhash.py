"""SimHash near-dedup with covering locality-sensitive hashing (Pagh, 2016).

Each of the 64 bit positions has a nonzero vector of F2^(r+1); table v, for each nonzero v, compares the positions
whose vector has an odd product with v. Up to r differing positions span at most r dimensions, so some v is orthogonal
to all of them: every pair within the radius collides in that table. No pair can be missed, whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, without
from .components import components

#: A bucket with more fingerprints is dealt out by a second covering over the bits that its table leaves free.
BUCKET = 256


def covering(positions: list[int], radius: int) -> list[int]:
    """Masks over positions such that any set of up to radius positions lies outside at least one mask."""
    n = (1 << (radius + 1)) - 1
    vector = {p: i % n + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the text's word shingles (XXH64, seed 42), repeats included; 0 if it has no word."""
    words = text.lower().split()  # of bytes: A-Z only; ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 16384):
        hi = min(n, lo + 16384)
        h = np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts[lo:hi].tolist(), ends[lo + size - 1 : hi + size - 1].tolist())), "<u8", hi - lo)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns of docs but the text, and fp (long, the fingerprint's 64 bits). A null text has fingerprint zero."""
    small_batches(docs.sparkSession)
    docs = without(docs, "fp")
    at, rest = docs.columns.index(text_col), [i for i, c in enumerate(docs.columns) if c != text_col]
    schema = T.StructType([*[docs.schema.fields[i] for i in rest], T.StructField("fp", T.LongType())])

    def rows(batches):
        for b in batches:
            fps = [signed(fingerprint(x.as_py() or b"", shingle)) for x in b.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.array(fps, pa.int64())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(rows, schema)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what distances of at most radius connect: fewer than there are fingerprints."""
    n = len(fps)
    u = fps.view(np.uint64)
    unseen, out = np.ones(n, bool), []
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root], front = False, [root]
        while front:
            i = front.pop()
            near = np.flatnonzero(unseen & (np.bitwise_count(u ^ u[i]) <= radius))
            unseen[near] = False
            out += [(int(fps[i]), int(fps[j])) for j in near]
            front += near.tolist()
    return out


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps(fp), distinct -> links(a, b) that connect exactly what pairs within the radius connect.

    A bucket of one table is read by one task as a list only up to BUCKET fingerprints; larger ones are dealt by a
    covering of the bits that are still free, whose buckets hold at most 2 ** (free bits left) fingerprints:
    2 ** 16. Within a bucket a search from each fingerprint emits one link for each fingerprint reached, never all
    pairs.
    """
    masks = covering(list(range(64)), radius)
    inner = [[m | s for s in covering([p for p in range(64) if not m >> p & 1], radius)] for m in masks]
    dealt = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("t", "key"))
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(dealt.join(sizes, ["t", "key"]), "buckets")
    table = F.array(*[F.array(*[F.lit(signed(m)) for m in row]) for row in inner])
    again = shared.where(F.col("n") > BUCKET).select("fp", "t", F.posexplode(F.transform(F.get(table, F.col("t")), lambda m: F.col("fp").bitwiseAND(m))).alias("t2", "key"))
    flat = shared.where(F.col("n") <= BUCKET).select("fp", (-F.col("t") - 1).alias("t"), "key")
    both = flat.union(again.select("fp", (F.col("t") * 64 + F.col("t2")).alias("t"), "key"))
    lists = both.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")

    def rows(batches):
        for b in batches:
            lengths, values = b.column(0).value_lengths().to_numpy(), b.column(0).flatten().to_numpy()
            found, start = set(), 0
            for n in lengths.tolist():
                own = values[start : start + n]
                start += n
                if n == 2:
                    x, y = int(own[0]), int(own[1])
                    if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                        found.add((x, y))
                else:
                    found.update(_forest(own, radius))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return lists.mapInArrow(rows, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of docs: its columns but the text, fingerprint (16 hex digits) and component_id.

    Fingerprints link at radius or fewer differing bits; component_id is the smallest id reachable by links. Equal
    fingerprints are one node, so copies, however many, cost one entry per table. Nulls: a null text has fingerprint
    zero, linked like any other; a null id is never a component's id (null where all ids of a component are). Repeated
    rows stay, alike. An empty table gives an empty result. Columns of docs that have an output's name give way to it.
    """
    docs = without(docs, "fingerprint", "component_id", "root", "rep", "node")
    printed = stored(fingerprinted(docs, text_col, shingle), "fingerprints")
    nodes = printed.groupBy("fp").agg(F.min(id_col).alias("rep"))
    roots = components(links(nodes.select("fp"), radius))
    rooted = stored(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fp", "component_id")
    return printed.join(labels, "fp").select(*[F.col(f"`{c}`") for c in printed.columns if c != "fp"], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
