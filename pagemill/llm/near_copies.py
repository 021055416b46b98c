"""SimHash near-dedup for texts of a stated similarity: covering tables first, then an exact search for what they miss.

Five-word shingles of texts are fingerprinted, and fingerprints within the radius meet in simhash.py's covering tables; a
link counts only if the texts' Jaccard similarity is 0.8 or more. Fingerprints of such texts can differ in a third of
their bits, which no covering of practical size spans, so the rest comes from prefix filtering (Chaudhuri et al., 2006;
Xiao et al., 2008): each text's distinct shingles are put in one order for all texts, rare ones first, and two sets of
similarity 0.8 or more share a shingle among the first floor(n / 5) + 1 of each. Texts that meet at no such shingle
need no look, and no link is missed. What meets is dismissed if its sizes or its sketches rule the similarity out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import dropped, small_batches, stored
from .components import components

SHINGLE, RADIUS = 5, 3
#: Cells that hold how frequent shingles are, and shingles counted at once; they decide the order, thus the work, never
#: the result.
CELLS, AT_ONCE = 1 << 22, 1 << 22
#: A shingle in fewer texts of those counted at once is not reported as frequent.
OFTEN = 4
#: Cells of a sketch at least, and shingles for each cell of a long text's.
SKETCH, LOAD = 128, 8
#: Texts of one key that one task compares with as many others, on average.
TILE = 256
#: Closest texts by sketch that are compared with a text in each round, while others of its group are in other components;
#: the last round leaves none out.
CLOSEST = (4, 64, 1 << 62)
#: Bits of the map by which texts are left out of a shuffle.
BITS = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z only; ASCII white space only


def shingles(text: str | None) -> set[bytes]:
    """A text's shingles of five words, or all its words where it has fewer; none if it has no word."""
    words = words_of(text)
    size = min(SHINGLE, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def alike(a: set, b: set) -> bool:
    """Jaccard similarity 0.8 or more; two texts without words are copies."""
    common = len(a & b)
    return 5 * common >= 4 * (len(a) + len(b) - common)


def hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the shingles, distinct and sorted."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += own[k : k + n] * _ODD[k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ h >> np.uint64(29))


def node_of(h: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(h.tobytes())
    return x - (1 << 64) if x >= 1 << 63 else x


def sketch_of(h: np.ndarray) -> bytes:
    """Signed sums of the set's hashes in cells, whose distance is never more than the sets' difference. The number of cells
    is a power of two and grows with the set; empty, and no evidence, if a sum is over a byte."""
    cells = max(SKETCH, 1 << (len(h) // LOAD).bit_length())
    sums = np.bincount((h >> np.uint64(20)).astype(np.int64) & (cells - 1), np.where(h >> np.uint64(63), 1.0, -1.0), cells)
    return sums.astype(np.int8).tobytes() if np.abs(sums).max() < 128 else b""


def _folded(s: np.ndarray, cells: int) -> np.ndarray:
    """Sketches (rows) with fewer cells."""
    return s.reshape(len(s), -1, cells).sum(axis=1, dtype=np.int16)


def _gaps(n: int, s: np.ndarray, n2: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """At least how many elements each of the sets (n2, s2: sizes, sketches as rows) does not share with one (n, s); infinite
    where that, or the sizes, rule out that they are similar."""
    ok = 5 * np.minimum(n, n2) >= 4 * np.maximum(n, n2)
    out = np.where(ok, 0.0, np.inf)
    at = np.flatnonzero(ok)
    if len(at) and len(s) and s2.shape[1]:
        cells = min(len(s), s2.shape[1])
        gap = np.abs(_folded(s2[at], cells) - _folded(s[None], cells)).sum(axis=1, dtype=np.int64)
        out[at] = np.where(9 * gap <= n + n2[at], gap, np.inf)  # similar sets differ in a ninth of both sizes at most
    return out


def _close(n: int, s: np.ndarray, n2: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Which of the sets may be similar to the one."""
    return np.isfinite(_gaps(n, s, n2, s2))


def keyed(docs: DataFrame) -> DataFrame:
    """docs and row: a 64-bit hash of all columns, the same for equal rows only."""
    return docs.withColumn("row", F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]))


def _frequent(parts: list[np.ndarray]) -> bytes:
    """Cells and counts of the shingles that OFTEN or more of the texts hold."""
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    often = n >= OFTEN
    cells, at = np.unique((h[often] % np.uint64(CELLS)).astype(np.uint32), return_inverse=True)
    most = np.zeros(len(cells), np.uint32)
    np.maximum.at(most, at, n[often].astype(np.uint32))
    return cells.tobytes() + most.tobytes()


def _read(rows: DataFrame) -> DataFrame:
    """(id, row, node, fp, n, sketch, counts): a row each, and one with frequent shingles for each AT_ONCE of a partition's
    shingles (those of the last different texts; a task holds no more)."""
    names = ["id", "row", "node", "fp", "n", "sketch", "counts"]

    def report(held):
        null = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
        return pa.RecordBatch.from_arrays([*null, pa.array([_frequent(held)], pa.binary())], names=names)

    def run(batches):
        held, size, seen = [], 0, set()
        for b in batches:
            nodes, fps, ns, sketches = [], [], [], []
            for x in b.column(2):
                text = x.as_py()
                h = hashes(text)
                nodes.append(node_of(h))
                fps.append(simhash.signed(simhash.fingerprint((text or "").encode(), SHINGLE)))
                ns.append(len(h))
                sketches.append(sketch_of(h))
                if nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    held.append(h)
                    size += len(h)
                if size >= AT_ONCE:
                    yield report(held)
                    held, size, seen = [], 0, set()
            arrays = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(ns, pa.int32()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(nodes), pa.binary())], names=names)
        if held:
            yield report(held)

    return rows.select("id", "row", "text").mapInArrow(run, "id long, row long, node long, fp long, n int, sketch binary, counts binary")


def _levels(read: DataFrame) -> np.ndarray:
    """Per cell how frequent its most frequent shingle is, as a power of two; zero for most. Bounded by CELLS bytes."""

    def spread(batches):
        for b in batches:
            for x in b.column(0):
                cells, n = np.split(np.frombuffer(x.as_py(), np.uint32).astype(np.int64), 2)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["at", "n"])

    total = read.where("counts is not null").select("counts").mapInArrow(spread, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(CELLS, np.uint8)
    packed = total.select((F.col("at") * 64 + F.floor(F.log2("n"))).alias("x")).toArrow().column("x").to_numpy()  # CELLS at most
    out[packed // 64] = packed % 64
    return out


def _prefixes(rows: DataFrame, levels: np.ndarray) -> DataFrame:
    """(key, node, at): of each distinct text of a partition the first shingles; at: how many it has, times 2 ** 32, and
    the shingle's place, from 0."""
    level = rows.sparkSession.sparkContext.broadcast(levels)  # bounded by CELLS

    def run(batches):
        seen, w = set(), level.value
        for b in batches:
            out = []
            for x in b.column(0):
                h = hashes(x.as_py())
                node = node_of(h)
                if node in seen or not len(h):
                    continue
                seen.add(node)
                first = h[np.argsort(w[(h % np.uint64(CELLS)).astype(np.int64)], kind="stable")][: len(h) // 5 + 1]
                out.append((first, node, len(h)))
            if out:
                sizes = [len(f) for f, _, _ in out]
                arrays = [
                    pa.array(np.concatenate([f for f, _, _ in out]).view(np.int64)), pa.array(np.repeat(np.array([n for _, n, _ in out], np.int64), sizes)),
                    pa.array(np.concatenate([np.arange(s) + (n << 32) for s, (_, _, n) in zip(sizes, out)])),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "node", "at"])

    return rows.select("text").mapInArrow(run, "key long, node long, at long")


def _possible(at1, at2):
    """Whether sets that meet first at these places can have the overlap that 0.8 asks for: 4/9 of both sizes."""
    n1, n2 = F.shiftright(at1, 32), F.shiftright(at2, 32)
    return F.least(n1 - at1.bitwiseAND(0xFFFFFFFF), n2 - at2.bitwiseAND(0xFFFFFFFF)) * 9 >= (n1 + n2) * 4


def _some(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows that may be among reps, by a bit map of fixed size: fewer texts to shuffle; the join that follows decides."""
    bits = np.zeros(BITS, bool)
    bits[reps.select(F.col("row").bitwiseAND(BITS - 1).alias("at")).distinct().toArrow().column("at").to_numpy()] = True  # BITS at most
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        held = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            yield b.filter(pa.array(held[b.column(0).to_numpy() & (BITS - 1)]))

    return rows.mapInArrow(run, rows.schema)


def _freed(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does once the driver has collected their plans."""
    df.sparkSession.sparkContext._jvm.System.gc()


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out."""
    sized = nodes.select("node", F.struct("n", "sketch").alias("s"))
    both = pairs.join(sized.toDF("a", "x"), "a").join(sized.toDF("b", "y"), "b").select("a", "b", "x.n", "x.sketch", F.col("y.n").alias("n2"), F.col("y.sketch").alias("sketch2"))

    def run(batches):
        for b in batches:
            keep = [bool(_close(n, np.frombuffer(s, np.int8), np.array([n2]), np.frombuffer(s2, np.int8)[None])[0]) for n, s, n2, s2 in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are alike, as a stored table."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    reps = stored(nodes.select("node", "row").join(wanted, "node"), "reps")
    texts = stored(_some(rows.select("row", "text"), reps).join(reps, "row").groupBy("row", "node").agg(F.first("text").alias("text")).drop("row"), "texts")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            last, right, keep = None, None, []
            for x, y in zip(batch.column(2), batch.column(3)):
                y = y.as_py()
                if right is None or y != last:
                    last, right = y, shingles(y)
                keep.append(alike(shingles(x.as_py()), right))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stored(both.mapInArrow(run, "a long, b long"), "links")
    for t in (reps, texts):
        dropped(t)
    _freed(pairs)
    return out


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    """df(node, ...) and root."""
    return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _printed(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints are within the radius, as many as connect what the radius connects."""
    reps = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    reps = stored(reps, "prints")
    found = simhash.links(reps.select("fp"), RADIUS)
    same = nodes.join(reps, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    ends = found.join(reps.toDF("a", "x"), "a").join(reps.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = stored(same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(ends).distinct(), "pairs")
    dropped(reps)
    return out


def _dealt(apart: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, root, tiles, n, sketch) of apart(key, node, root): keys with the same nodes are one group."""
    h = F.xxhash64("node")
    groups = apart.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(h.cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("s2"))
    one = groups.groupBy("size", "s1", "s2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    return stored(apart.join(stored(one, "groups"), "key").select("key", "node", "root", "tiles").join(nodes.select("node", "n", "sketch"), "node"), "dealt")


def _met(dealt: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Pairs (a, b) of different roots that share a key and that neither sizes nor sketches rule out, for each text and pair
    of tiles the most closest ones; and whether there are more.

    A group is dealt into tiles by hash, each pair of tiles is one row: at most about two tiles are ever together.
    """
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    spread = dealt.withColumn("tile", own).select("key", F.struct("node", "root", "n", "sketch", "tile").alias("x"), "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    lists = spread.groupBy("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")).agg(F.collect_list("x").alias("x")).where("size(x) > 1").select("lo", "hi", "x")

    def run(batches):
        for b in batches:
            found, more = [np.zeros((2, 0), np.int64)], False
            for lo, hi, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = x.values
                node, root, n, tile = (x.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("node", "root", "n", "tile"))
                if (root == root[0]).all():
                    continue
                raw = [np.frombuffer(y, np.int8) for y in x.field("sketch").to_pylist()]
                kinds = np.array(list(map(len, raw)))
                sets = [(at, np.stack([raw[j] for j in at])) for k in np.unique(kinds) if len(at := np.flatnonzero((tile == hi) & (kinds == k)))]
                for i in np.flatnonzero(tile == lo).tolist():
                    gap = np.full(len(node), np.inf)
                    for at, s in sets:
                        apart = (root[at] != root[i]) & ((node[at] > node[i]) | (lo != hi))
                        gap[at[apart]] = _gaps(int(n[i]), raw[i], n[at][apart], s[apart])
                    j = np.flatnonzero(np.isfinite(gap))
                    if len(j) > most:
                        more, j = True, j[np.argsort(gap[j], kind="stable")[:most]]
                    found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]))
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)  # groups of a batch repeat pairs
            yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *([None] if more else [])], pa.int64()), pa.array([*b.tolist(), *([None] if more else [])], pa.int64())], names=["a", "b"])

    out = stored(lists.mapInArrow(run, "a long, b long").distinct(), "pairs")
    return out.where("a is not null"), not out.where("a is null").isEmpty()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, node, root), one row per row of docs: row is its key (see keyed), rows of one root are linked by pairs of
    Jaccard similarity 0.8 or more.

    Texts with equal shingle hashes are one node. Links come from fingerprints first. Then, in each group that shares an
    early shingle, all that is still apart from the text that stands earliest there is compared with it. Pairs that this
    leaves in different components are compared closest first, in rounds, until none is left, so that a large group of
    near copies costs about as many comparisons as it has members. Nulls: a null text counts as empty, and texts without words are one node; a null id
    is an id like any other here. Repeated rows share a key and a node. Ties do not matter: roots are minima of nodes. An
    empty table gives an empty result. Columns that docs has besides are part of a row's key only.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs).select(F.col(f"`{id_col}`").alias("id"), "row", F.col(f"`{text_col}`").alias("text"))
    read = stored(_read(rows), "read")
    _freed(read)
    nodes = read.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    nodes = stored(nodes, "nodes")
    printed = _printed(nodes)
    links = _verified(stored(_plausible(printed, nodes), "likely"), rows, nodes)
    roots = stored(components(links), "roots")

    group = Window.partitionBy("key")
    met = _prefixes(rows, _levels(read)).withColumns({"low": F.min("node").over(group), "high": F.max("node").over(group), "p": F.min(F.struct((F.col("at").bitwiseAND(0xFFFFFFFF)).alias("pos"), "at", "node")).over(group)})
    shared = stored(met.where("low <> high").select("key", "node", "at", F.col("p.at").alias("p_at"), F.col("p.node").alias("p")).distinct(), "meetings")
    _freed(shared)
    near = shared.where("node <> p").where(_possible(F.col("at"), F.col("p_at"))).select("node", "p").distinct()
    near = _rooted(near, roots).join(roots.toDF("p", "p_root"), "p", "left").where("root <> coalesce(p_root, p)")
    pairs = stored(near.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), "pairs")
    links = links.union(_verified(stored(_plausible(pairs, nodes), "likely"), rows, nodes))
    dropped(roots)
    roots = stored(components(links), "roots")

    # what is not connected yet, though it shares a shingle
    labelled = _rooted(shared.select("key", "node"), roots)
    apart = stored(labelled.withColumns({"low": F.min("root").over(group), "high": F.max("root").over(group)}).where("low <> high").select("key", "node", "root"), "apart")
    done, dealt = printed.union(pairs), _dealt(apart, nodes)
    ends = roots
    for most in CLOSEST:
        met, more = _met(dealt, most)
        rest = stored(met.join(done, ["a", "b"], "left_anti"), "pairs")
        links, done = links.union(_verified(rest, rows, nodes)), done.union(rest)
        ends = stored(components(links), "roots")
        if not more:
            break
        dealt = stored(_rooted(dealt.drop("root"), ends), "dealt")
    out = stored(_rooted(read.where("node is not null").select("id", "row", "node"), ends).select("id", "row", "node", "root"), "groups")
    for t in (read, nodes, printed, shared, pairs, roots, apart):
        dropped(t)
    return out
