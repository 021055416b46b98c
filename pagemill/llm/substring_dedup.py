"""Substring dedup: seed and extend over winnowed anchors.

Seed: in each window of words the word n-gram with the smallest hash is its anchor (winnowing), so two equal windows
have the same anchor at the same offset, whatever stands around them; consecutive windows mostly share one. Blocks of
documents first send their anchors only, as short hashes, which tells the anchors that two or more documents hold.
Extend: these meet again with the words around them, as far as a window that holds the anchor can reach to both sides.
At each offset of the anchor equal words are one group, by the words themselves, and a window is hit if its group has a
smaller document. Windows that hit and overlap make up the maximal repeats, each at least one window long.

Contexts that a block repeats are merged before the shuffle, so a passage in very many documents is one entry per block,
and no pairs are ever made. An anchor that very many documents hold is dealt by the words of each window, to as many
tasks as there are different windows.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks, bytes_table, pack, texts_of, unpack
from .common import small_batches, stored, without

ANCHOR = 6
#: Text that one bucket of the exchange stands for.
BUCKET_BYTES = 64 << 20
#: States of anchors: held by several documents; by so many that their windows are dealt by their words.
SHARED, HOT, HOT_DOCS = 1, 2, 4096
SPACE = re.compile(b" ")


def _mixers(n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return np.array([xxhash.xxh64_intdigest(f"mix{i}") | 1 for i in range(n)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Anchors:
    """The anchors of one block: p (first word), s0 and s1 (first and last window that it is the anchor of), hash, doc."""

    def __init__(self, words: list[list[bytes]], ids: list, window: int, buckets: int):
        self.window, self.k, self.buckets = window, min(ANCHOR, window), buckets
        reach = self.reach = window - self.k
        self.words = [x for w in words for x in w]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        n = self.n = len(self.words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, n)
        doc_of = np.repeat(np.arange(len(words)), counts)
        starts = max(0, n - window + 1)
        grams = np.zeros(max(0, n - self.k + 1), np.uint64)
        for m, j in zip(_mixers(self.k), range(self.k)):
            grams += hashes[j : j + len(grams)] * m
        grams = _mixed(grams)
        least = grams[:starts].copy()
        for o in range(1, reach + 1):
            np.minimum(least, grams[o : o + starts], out=least)
        place = np.zeros(starts, np.int64)
        for o in range(reach, -1, -1):
            place[grams[o : o + starts] == least] = o
        known = np.array([i is not None for i in ids], bool)
        inside = (doc_of[:starts] == doc_of[window - 1 : window - 1 + starts]) & known[doc_of[:starts]] if starts else np.zeros(0, bool)
        s = np.flatnonzero(inside)
        p = s + place[s]
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1 if len(first) else first
        self.p, self.s0, self.s1 = p[first], s[first], s[last] if len(s) else s
        self.hash = grams[self.p]
        self.doc = np.array([i or 0 for i in ids], np.int64)[doc_of[self.p]] if n else np.zeros(0, np.int64)
        # different anchors, by bucket; of: which of them each is
        kinds, of = np.unique(self.hash, return_inverse=True)
        pairs = np.unique(of * (len(ids) + 1) + np.unique(self.doc, return_inverse=True)[1])
        holders = np.bincount(pairs // (len(ids) + 1), minlength=len(kinds))
        bucket = (kinds % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((kinds, bucket))
        self.kinds, self.holders, self.kind_bucket = kinds[order], np.minimum(holders[order], 255), bucket[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of = rank[of]

    def seeds(self):
        """(bucket, payload) for each bucket: 40 bits of its anchors, and how many documents of the block hold each."""
        for at in _parts(self.kind_bucket):
            short = (self.kinds[at] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()
            yield int(self.kind_bucket[at[0]]), pack(short + self.holders[at].astype(np.uint8).tobytes())

    def extend(self, replies: list[tuple[int, bytes]]) -> list[tuple[int, bytes, int, int, int, np.ndarray, np.ndarray]]:
        """What meets again, given the buckets' states of anchors: (bucket, words, low, high, smallest doc, the anchors,
        their docs) of each different context, offsets low to high, in the same order each time."""
        state = np.zeros(len(self.kinds), np.uint8)
        for bucket, payload in replies:
            own = np.frombuffer(unpack(payload), np.uint8)
            start = int(np.searchsorted(self.kind_bucket, bucket))
            state[start : start + len(own)] = own
        held: dict[tuple, list[int]] = {}
        kind, bucket = state[self.of], self.kind_bucket[self.of]
        for e in np.flatnonzero(kind).tolist():
            s0, s1, p = int(self.s0[e]), int(self.s1[e]), int(self.p[e])
            if kind[e] == SHARED:
                text = b" ".join(self.words[s0 : s1 + self.window])
                held.setdefault((int(bucket[e]), text, p - s1, p - s0), []).append(e)
            else:
                for s in range(s0, s1 + 1):
                    text = b" ".join(self.words[s : s + self.window])
                    held.setdefault((xxhash.xxh64_intdigest(text) % self.buckets, text, p - s, p - s), []).append(e)
        out = []
        for (b, text, low, high), es in sorted(held.items()):
            at = np.array(es)
            out.append((b, text, low, high, int(self.doc[at].min()), at, self.doc[at]))
        return out

    def removed(self, contexts: list, replies: list[tuple[int, bytes]]) -> np.ndarray:
        """Which words go, given the buckets' replies: places of contexts in a message, and a bit for each offset."""
        first: dict[int, int] = {}
        for i, c in enumerate(contexts):
            first.setdefault(c[0], i)
        bits = np.zeros(len(contexts), np.uint64)
        for bucket, payload in replies:
            data = unpack(payload)
            n = len(data) // 12
            bits[first[bucket] + np.frombuffer(data[: 4 * n], np.uint32).astype(np.int64)] = np.frombuffer(data[4 * n :], np.uint64)
        if not contexts:
            return np.zeros(self.n, bool)
        sizes = np.array([len(c[5]) for c in contexts])
        each = np.repeat(np.arange(len(contexts)), sizes)
        e, doc = np.concatenate([c[5] for c in contexts]), np.concatenate([c[6] for c in contexts])
        low, high, least = (np.array([c[k] for c in contexts])[each] for k in (2, 3, 4))
        change = np.zeros(self.n + 1, np.int32)
        for o in range(self.reach + 1):
            s = self.p[e] - o
            hit = (low <= o) & (o <= high) & ((doc > least) | ((bits[each] >> np.uint64(o)) & np.uint64(1)).astype(bool))
            np.add.at(change, s[hit], 1)
            np.add.at(change, s[hit] + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def _parts(bucket: np.ndarray) -> list[np.ndarray]:
    """Places of each bucket's entries, which lie together."""
    return np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1) if len(bucket) else []


def _states(parts: list[bytes], hot: int) -> list[bytes]:
    """For each message of seeds the states of its anchors: 0, SHARED by documents, or HOT."""
    sizes = [len(x) // 6 for x in parts]
    short = np.zeros((sum(sizes), 8), np.uint8)
    short[:, :5] = np.concatenate([np.frombuffer(x, np.uint8)[: 5 * n].reshape(5, n).T for x, n in zip(parts, sizes)])
    holders = np.concatenate([np.frombuffer(x, np.uint8)[5 * n :] for x, n in zip(parts, sizes)])
    of = np.unique(short.view(np.uint64)[:, 0], return_inverse=True)[1]
    total = np.bincount(of, holders)[of]
    state = np.where(total >= hot, HOT, np.where(total > 1, SHARED, 0)).astype(np.uint8)
    return [x.tobytes() for x in np.split(state, np.cumsum(sizes)[:-1])]


def _message(contexts: list) -> bytes:
    """Contexts of one bucket: their number, smallest docs, offsets, lengths, and words."""
    lengths = np.array([len(c[1]) for c in contexts], np.uint32)
    docs = np.array([c[4] for c in contexts], np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    low, high = (np.array([c[k] for c in contexts], np.uint8).tobytes() for k in (2, 3))
    return pack(np.uint32(len(contexts)).tobytes() + docs + low + high + lengths.tobytes() + b"".join(c[1] for c in contexts), 3)


def _contexts(data: bytes):
    """(doc, low, high, words) of a message."""
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    raw = np.frombuffer(data, np.uint8)[4 : 4 + 14 * n]
    docs = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.int64)[:, 0].tolist()
    low, high, ends = raw[8 * n : 9 * n].tolist(), raw[9 * n : 10 * n].tolist(), np.cumsum(np.frombuffer(raw[10 * n :].tobytes(), np.uint32)).tolist()
    text, at = data[4 + 14 * n :], 0
    for d, a, b, end in zip(docs, low, high, ends):
        yield d, a, b, text[at:end]
        at = end


def _windows(low: int, high: int, text: bytes, window: int):
    """(offset, the window's words) for each offset of a context."""
    if low == high:
        yield low, text
        return
    cuts = [-1, *(m.start() for m in SPACE.finditer(text)), len(text)]
    for o in range(low, high + 1):
        yield o, text[cuts[high - o] + 1 : cuts[high - o + window]]


def _extended(messages: list[bytes], window: int) -> list[bytes]:
    """For each message, packed: places of the contexts with a window that a smaller document has, and bits of offsets."""
    least: dict[bytes, int] = {}
    for data in messages:
        for doc, low, high, text in _contexts(data):
            for _, words in _windows(low, high, text, window):
                if least.get(words, doc) >= doc:
                    least[words] = doc
    out = []
    for data in messages:
        at, bits = [], []
        for i, (doc, low, high, text) in enumerate(_contexts(data)):
            found = sum(1 << o for o, words in _windows(low, high, text, window) if least[words] < doc)
            if found:
                at.append(i)
                bits.append(found)
        out.append(pack(np.array(at, np.uint32).tobytes() + np.array(bits, np.uint64).tobytes()) if at else b"")
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, whole_if_untouched: bool = False) -> DataFrame:
    """The columns of docs, the text as its kept words joined by one space, and n_words and n_removed.

    Words are split at ASCII white space. A word goes if a window (window consecutive words of one document) covers it
    whose words also start in a document with a smaller id; windows are judged on the input. whole_if_untouched: a text
    that loses nothing stays as it is (null too), white space included. window: at least 2, at most 60 words.
    Nulls: a null text has no words; a row without id loses nothing and takes nothing. Rows that share an id take
    nothing from each other. Texts shorter than a window stay. An empty table gives an empty result. Columns of docs
    that have an output's name give way to it.
    """
    if not 2 <= window <= 60:
        raise ValueError("window: 2 to 60 words")
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "n_words", "n_removed")
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    names = [f.name for f in schema.fields]
    held = stored(blocks(docs, text_col).withColumn("block", F.monotonically_increasing_id()), "blocks")
    total = held.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES))

    def anchors(payload: bytes):
        table = bytes_table(payload)
        words = [x.split() for x in texts_of(table.column(text_at))]
        return table, words, Anchors(words, table.column(id_at).to_pylist(), window, buckets)

    def rows(block: list[int], bucket: list[int], payload: list[bytes]) -> pa.Table:
        return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "payload": pa.array(payload, pa.binary())})

    def pairs(t: pa.Table) -> list[tuple[int, bytes]]:
        return list(zip(t.column("bucket").to_pylist(), t.column("payload").to_pylist()))

    def seed(batches):
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                found = list(anchors(payload.as_py())[2].seeds())
                yield from rows([block] * len(found), [x for x, _ in found], [y for _, y in found]).to_batches()

    def count(t: pa.Table) -> pa.Table:
        states = _states([unpack(x.as_py()) for x in t.column("payload")], HOT_DOCS)
        some = [(block, bucket, pack(x)) for block, bucket, x in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), states) if any(x)]
        return rows(*map(list, zip(*some))) if some else rows([], [], [])

    def send(own: pa.Table, states: pa.Table) -> pa.Table:
        block = own.column("block")[0].as_py()
        contexts = anchors(own.column("payload")[0].as_py())[2].extend(pairs(states))
        found = [(bucket, _message(list(c))) for bucket, c in itertools.groupby(contexts, lambda c: c[0])]
        return rows([block] * len(found), [x for x, _ in found], [y for _, y in found])

    def meet(t: pa.Table) -> pa.Table:
        replies = _extended([unpack(x.as_py()) for x in t.column("payload")], window)
        some = [(block, bucket, x) for block, bucket, x in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), replies) if x]
        return rows(*map(list, zip(*some))) if some else rows([], [], [])

    def rebuild(own: pa.Table, replies: pa.Table) -> pa.Table:
        table, words, found = anchors(own.column("payload")[0].as_py())
        first = pairs(replies.filter(pc.equal(replies.column("round"), 1)))
        gone = found.removed(found.extend(first), pairs(replies.filter(pc.equal(replies.column("round"), 2))))
        texts, lost, at = [], [], 0
        old = table.column(text_at).to_pylist()
        for w, text in zip(words, old):
            flags = gone[at : at + len(w)]
            at += len(w)
            lost.append(int(flags.sum()))
            if whole_if_untouched and not lost[-1]:
                texts.append(text)
            else:
                texts.append(b" ".join([x for x, f in zip(w, flags.tolist()) if not f] if lost[-1] else w).decode())
        table = table.set_column(text_at, table.schema.field(text_at), pa.array(texts, table.schema.field(text_at).type))
        return pa.Table.from_arrays([*table.columns, pa.array([len(w) for w in words], pa.int64()), pa.array(lost, pa.int64())], names=names)

    kind = "block long, bucket long, payload binary"
    own = held.select("block", "payload")
    states = stored(own.mapInArrow(seed, kind).groupBy("bucket").applyInArrow(count, kind), "states")
    replies = own.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(send, kind).groupBy("bucket").applyInArrow(meet, kind)
    both = states.withColumn("round", F.lit(1)).union(replies.withColumn("round", F.lit(2)))
    return own.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(rebuild, schema)
