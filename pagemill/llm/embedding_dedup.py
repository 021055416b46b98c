"""Embedding near-dedup by int8 tile products with rigorous error bounds.

A unit vector x is a + d, a its int8 quantisation (times a scale) and d what that loses, whose length is known; so
x.y lies within |a||e| + |d||b| + |d||e| of a.b for y = b + e. Only codes, scales and the two lengths are dealt into tiles
(dim + 24 bytes a vector and tile). Tiles of one label are multiplied as integers. A pair whose lower bound reaches the
threshold is a link, one whose upper bound does not is none; only of vectors in pairs between are the whole components
fetched, once for a pair of tiles, and such pairs are computed again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import dropped, small_batches, stored, without
from .components import components

#: Different vectors of one tile at most, on average, and bytes of its codes; a task holds two tiles.
TILE, TILE_BYTES = 16384, 4 << 20
#: Smaller labels are dealt into tiles of so many, up to eight of them, so that several tasks share them.
LEAST = 1024
#: Over what rounding in double precision can add to a bound.
SLACK = 1e-9
#: Rows of a tile that are multiplied at once, and pairs computed again at once.
ROWS, PAIRS = 128, 1 << 16


def unit_rows(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def quantised(x: np.ndarray):
    """Unit vectors of the rows of x (double), their int8 parts, scales, lengths of both parts."""
    unit = unit_rows(x)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    coarse = q * scale[:, None]
    return unit, q.astype(np.int8), scale, np.linalg.norm(coarse, axis=1), np.linalg.norm(unit - coarse, axis=1)


def judged(x, y, threshold: float):
    """Sure and possible pairs (i, j) of codes x and y, each (q, scale, length, lost length), by blocks of rows of x."""
    (xq, xs, xa, xd), (yq, ys, ya, yd) = x, y
    exact = np.float32 if 127 * 127 * xq.shape[1] < 1 << 24 else np.float64  # integers that the type holds exactly
    right = yq.astype(exact).T
    for lo in range(0, len(xq), ROWS):
        at = slice(lo, lo + ROWS)
        middle = (xq[at].astype(exact) @ right) * np.outer(xs[at], ys)
        wide = np.outer(xa[at], yd) + np.outer(xd[at], ya + yd) + SLACK
        possible = middle + wide >= threshold
        sure = middle - wide >= threshold
        (i, j), (k, m) = np.nonzero(sure), np.nonzero(possible & ~sure)
        yield i + lo, j, k + lo, m


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class _Found:
    """Links among numbered vectors of which there are count: how many each has, and a star for each component."""

    def __init__(self, count: np.ndarray):
        self.count, self.links, self.root = count, np.zeros(len(count), np.int64), np.arange(len(count))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            for x, y in ((i, j), (j, i)):
                self.links += np.bincount(x, self.count[y], len(self.count)).astype(np.int64)
            own = np.arange(len(self.count))
            self.root = _stars(len(own), np.concatenate([i, own]), np.concatenate([j, self.root]))


def _deal(classes: DataFrame) -> DataFrame:
    """(kind, tiles, label, dim): a number for each label and length, and its tiles."""
    sized = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    tile = F.least(F.lit(TILE), F.greatest(F.lit(min(LEAST, TILE)), F.floor(F.lit(TILE_BYTES) / F.col("dim"))))
    tiles = F.greatest(F.ceil(F.col("n") / tile), F.least(F.ceil(F.col("n") / min(LEAST, TILE)), F.lit(8))).cast("int")
    return stored(sized.select("label", "dim", tiles.alias("tiles")).withColumn("kind", F.monotonically_increasing_id()), "kinds")


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """The columns of vectors but the vector, and n_links, component_id, kept (its id is component_id).

    Vectors of one label link if their cosine in double precision is at least threshold; component_id is the smallest id
    reachable. Equal vectors of a label are one node with a count, so copies make no pairs; two 64-bit hashes of label
    and components lead rows to their node. A label is dealt into tiles by hash, each pair of tiles is one task's: a hot
    label is many tasks. Links are emitted as counts and as a star per component of a tile pair, never as all pairs;
    pairs to be computed again are lists of 4 bytes each.
    Nulls: a vector links with nothing if its label is null or it is null, empty, zero, or holds a null or a non-finite
    component; its component is itself. Vectors of different lengths do not link. A null id is never a component's id
    while another is there. Repeated rows count as vectors of their own. An empty table gives an empty result. Columns
    of vectors that have an output's name give way to it.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold: over 0, to 1")
    small_batches(vectors.sparkSession)
    vectors = without(vectors, "n_links", "component_id", "kept", "__h1", "__h2")
    rest = [F.col(f"`{c}`") for c in vectors.columns if c != vector_col]
    v, label = F.col(vector_col), F.col(label_col)
    fine = label.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False))
    keyed = vectors.withColumns({"__h1": F.when(fine, F.xxhash64(label, v)), "__h2": F.when(fine, F.xxhash64(F.lit(1), label, v))})
    same = keyed.where("__h1 is not null").groupBy("__h1", "__h2", label.alias("label"), v.cast("array<double>").alias("v"))
    classes = stored(same.agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("rep")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    kinds = _deal(classes)

    def coded(batches):
        for b in batches:
            lists = b.column(2)
            lengths = lists.value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                own = lists.take(pa.array(at))
                _, q, scale, a, d = quantised(own.flatten().to_numpy().reshape(len(at), dim))
                codes = pa.array([x.tobytes() for x in q], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), codes, pa.array(scale), pa.array(a), pa.array(d), *(b.column(k).take(pa.array(at)) for k in (3, 4))], names=["cls", "n", "q", "scale", "a", "d", "kind", "tiles"])

    numbered = classes.join(kinds, (classes.label == kinds.label) & (F.size(classes.v) == kinds.dim)).select("cls", "n", "v", "kind", "tiles")
    codes = numbered.mapInArrow(coded, "cls long, n long, q binary, scale double, a double, d double, kind long, tiles int")
    codes = codes.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    paired = codes.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).drop("tiles")
    paired = paired.withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other")}).drop("other")

    def compare(rows: pa.Table) -> pa.Table:
        kind, x, y = (rows.column(c)[0].as_py() for c in ("kind", "x", "y"))
        tile, n, cls, scale, a, d = (rows.column(c).to_numpy() for c in ("tile", "n", "cls", "scale", "a", "d"))
        q = np.frombuffer(b"".join(rows.column("q").to_pylist()), np.int8).reshape(len(cls), -1)
        left, right = np.flatnonzero(tile == x), np.flatnonzero(tile == y)
        found, parts = _Found(n), []
        for i, j, k, m in judged(*((q[z], scale[z], a[z], d[z]) for z in (left, right)), threshold) if len(left) and len(right) else ():
            i, j, k, m = left[i], right[j], left[k], right[m]
            if x == y:
                i, j, k, m = i[i < j], j[i < j], k[k < m], m[k < m]
            found.add(i, j)
            if len(k):
                parts.append(np.stack([k, m], axis=1).astype(np.uint16 if len(cls) <= 1 << 16 else np.uint32))
        need = np.unique(np.concatenate([p.ravel() for p in parts])).astype(np.int64) if parts else np.zeros(0, np.int64)
        hit = np.flatnonzero(found.links)
        sizes = (len(hit), len(need), len(parts))
        lists = [pack(np.searchsorted(need, p).astype(np.uint32).tobytes()) for p in parts]
        fill = lambda values, at, kind: pa.concat_arrays([pa.array(values, kind) if i == at else pa.nulls(s, kind) for i, s in enumerate(sizes)])
        clss = pa.concat_arrays([pa.array(cls[hit]), pa.array(cls[need]), pa.nulls(len(lists), pa.int64())])
        const = {c: pa.array(np.full(sum(sizes), z)) for c, z in (("kind", kind), ("x", x), ("y", y))}
        return pa.table({"kind": const["kind"], "x": const["x"].cast(pa.int32()), "y": const["y"].cast(pa.int32()), "cls": clss, "root": fill(cls[found.root[hit]], 0, pa.int64()), "links": fill(found.links[hit], 0, pa.int64()), "at": fill(np.arange(len(need)), 1, pa.int64()), "pairs": fill(lists, 2, pa.binary())})

    def again(vecs: pa.Table, lists: pa.Table) -> pa.Table:
        order = np.argsort(vecs.column("at").to_numpy())
        unit = unit_rows(vecs.column("v").combine_chunks().take(pa.array(order)).flatten().to_numpy().reshape(len(order), -1))
        cls, found = vecs.column("cls").to_numpy()[order], _Found(vecs.column("n").to_numpy()[order])
        for packed in lists.column("pairs"):
            pairs = np.frombuffer(unpack(packed.as_py()), np.uint32).reshape(-1, 2).astype(np.int64)
            for lo in range(0, len(pairs), PAIRS):
                i, j = pairs[lo : lo + PAIRS].T
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                found.add(i[near], j[near])
        hit = np.flatnonzero(found.links)
        return pa.table({"cls": pa.array(cls[hit]), "root": pa.array(cls[found.root[hit]]), "links": pa.array(found.links[hit])})

    task = ["kind", "x", "y"]
    first = stored(paired.groupBy(*task).applyInArrow(compare, "kind long, x int, y int, cls long, root long, links long, at long, pairs binary"), "tiles")
    whole = first.where("at is not null").select(*task, "cls", "at").join(classes.select("cls", "v", "n"), "cls")
    lists = first.where("pairs is not null").select(*(F.col(c).alias(f"{c}_") for c in task), "pairs").groupBy("kind_", "x_", "y_")
    second = whole.groupBy(*task).cogroup(lists).applyInArrow(again, "cls long, root long, links long")
    found = stored(first.where("root is not null").select("cls", "root", "links").union(second), "stars")
    dropped(first)
    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    rooted = stored(classes.select("cls", "rep").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root")), "roots")
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = rooted.join(smallest, "root").join(linked, "cls", "left").select("cls", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    ended = classes.select("cls", "n", "__h1", "__h2").join(labels, "cls").select("__h1", "__h2", "component_id", (F.col("n") - 1 + F.col("links")).alias("n_links"))
    out = keyed.select(*rest, "__h1", "__h2").join(ended, ["__h1", "__h2"], "left").withColumn("component_id", F.when(F.col("__h1").isNull(), F.col(id_col)).otherwise(F.col("component_id")))
    return out.select(*rest, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))
