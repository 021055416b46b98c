"""Byte-level BPE over a corpus by one shuffle of its distinct words.

Pre-tokens with their positions stay packed in blocks (see blocks.py): a block says, position by position, which word
stands there. Blocks that follow one another in a partition form a chain, which lists its distinct words once. Only
these lists are shuffled, to the bucket of each word's hash, where each distinct word is encoded once; the ids come back
to the chains and are put in place by position. Decoding
looks ids up in the token-byte table, which the vocabulary bounds, so every task has all of it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import bytes_table, cut, pack, table_bytes, unpack
from .common import small_batches, stored, unvarints, varints, without
from .tokenizer import encoding, read_ranks

#: Text of one block, and of one chain at most (or one longer text): a chain's words fit a worker's memory.
BLOCK, CHAIN = 4 << 20, 32 << 20
ZSTD = 9


def _words(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    lengths = varints(np.fromiter(map(len, data), np.int64, len(data)))
    return pack(len(lengths).to_bytes(4, "little") + lengths + b"".join(data), ZSTD)


def _unwords(payload: bytes) -> list[bytes]:
    data = unpack(payload)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unvarints(data[4 : 4 + n]).astype(np.int64)) + 4 + n
    return [data[a:b] for a, b in zip([4 + n, *ends[:-1].tolist()], ends.tolist())]


def _planes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def _symbols(values: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent: a leading byte each, and 13 more bits for most others, as streams of
    their own, which compress to near the entropy of their numbers."""
    v = values.astype(np.int64)
    w = v - 192
    high = np.minimum(w >> 13, 62)
    lead = np.where(w < 0, v, 192 + high).astype(np.uint8)
    mid = w[(w >= 0) & (high < 62)]
    return _bundle([pack(x, 3) for x in (lead.tobytes(), (mid & 255).astype(np.uint8).tobytes(), (mid >> 8 & 31).astype(np.uint8).tobytes(), varints(w[high == 62]))])


def _unsymbols(data: bytes) -> np.ndarray:
    lead, low, high, rest = (unpack(x) for x in _unbundle(data))
    lead = np.frombuffer(lead, np.uint8).astype(np.int64)
    out = lead.copy()
    mid = (lead >= 192) & (lead < 254)
    out[mid] = 192 + (lead[mid] - 192 << 13 | np.frombuffer(high, np.uint8).astype(np.int64) << 8 | np.frombuffer(low, np.uint8))
    out[lead == 254] = 192 + unvarints(rest).astype(np.int64)
    return out


def _bundle(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unbundle(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def encode(docs: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The columns of docs but the text, and ids_col (array of int): the text's ids, special tokens counting as text.

    Every match of pattern is encoded separately; what it does not match has no ids. Nulls: a null text counts as empty
    and has no ids; null ids of rows are carried. Repeated rows are encoded each; an empty table gives an empty result;
    a column of docs named ids_col gives way to it. A single very long text makes a block of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, ids_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != text_col], T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    ranks = spark.sparkContext.broadcast(read_ranks(vocab_path))  # bounded by the vocabulary
    # a bucket is a share of the distinct words, which grow with the input as the scan's partitions do
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def tokens(batches):
        find, made = regex.compile(pattern).findall, 0
        slots: dict[str, int] = {}
        part = total = 0

        def row(bucket, words, kept, part):
            chain = (TaskContext.get().partitionId() << 33) + made
            return pa.RecordBatch.from_arrays(
                [pa.array([chain], pa.int64()), pa.array([part], pa.int32()), pa.array([bucket], pa.int64()), pa.array([words], pa.binary()), pa.array([kept], pa.binary())],
                names=["chain", "part", "bucket", "words", "kept"],
            )

        def finish():
            words = list(slots)
            bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(x):
                    yield row(int(bucket[x[0]]), _words([words[k] for k in x.tolist()]), None, None)
            yield row(None, None, pack(_planes(bucket), ZSTD), -1)

        for table in cut(batches, at, BLOCK):
            counts, lists, known = [], [], len(slots)
            for x in table.column(at):
                text = x.as_py() or ""
                found = find(text)
                total += len(text)
                counts.append(len(found))
                lists.append(np.fromiter((slots.setdefault(w, len(slots)) for w in found), np.uint32, len(found)))
            rest = table_bytes(table.drop_columns([table.schema.names[at]])) if table.num_columns > 1 else b""
            # words are numbered as they come, so 0 says all of a new one; others are one more than their number
            at_word = np.concatenate(lists).astype(np.int64)
            new = at_word > np.maximum.accumulate(np.concatenate(([known - 1], at_word)))[:-1]
            yield row(None, None, _bundle([rest, varints(np.array(counts)), known.to_bytes(8, "little"), _symbols(np.where(new, 0, at_word + 1))]), part)
            part += 1
            if total >= CHAIN:
                yield from finish()
                slots, part, total, made = {}, 0, 0, made + 1
        if part:
            yield from finish()

    def meet(messages: pa.Table) -> pa.Table:
        enc, known = encoding(ranks.value, pattern, vocab_path), {}
        replies = []
        for x in messages.column("words"):
            counts, ids = [], []
            for w in _unwords(x.as_py()):
                own = known.get(w)
                if own is None:
                    own = known[w] = enc.encode_ordinary(w.decode())
                counts.append(len(own))
                ids += own
            replies.append(_bundle([pack(varints(np.array(counts)), ZSTD), _symbols(np.array(ids, np.int64))]))
        return pa.table({"chain": messages.column("chain"), "bucket": messages.column("bucket"), "reply": pa.array(replies, pa.binary())})

    def place(own: pa.Table, replies: pa.Table) -> pa.Table:
        blocks = dict(zip(own.column("part").to_pylist(), own.column("kept")))
        order = np.argsort(_unplanes(unpack(blocks.pop(-1).as_py())), kind="stable")  # words as the messages have them, bucket by bucket
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for _, reply in sorted(zip(replies.column("bucket").to_pylist(), replies.column("reply").to_pylist())):
            a, b = _unbundle(reply)
            sizes.append(unvarints(unpack(a)).astype(np.int64))
            ids.append(_unsymbols(b).astype(np.int32))
        sizes, ids = np.concatenate(sizes), np.concatenate(ids)
        size, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        size[order], start[order] = sizes, np.cumsum(sizes) - sizes
        out = []
        for k in sorted(blocks):
            others, counts, known, slots = _unbundle(blocks[k].as_py())
            counts, slots = unvarints(counts).astype(np.int64), _unsymbols(slots) - 1
            new = slots < 0
            slots[new] = int.from_bytes(known, "little") + np.arange(new.sum())
            lengths = size[slots]
            ends = np.concatenate(([0], np.cumsum(lengths)))
            place_of = np.arange(ends[-1]) + np.repeat(start[slots] - ends[:-1], lengths)
            made = pa.ListArray.from_arrays(pa.array(ends[np.concatenate(([0], np.cumsum(counts)))], pa.int32()), pa.array(ids[place_of], pa.int32()))
            out.append(pa.Table.from_arrays([*(bytes_table(others).columns if others else []), made], names=[f.name for f in schema.fields]))
        return pa.concat_tables(out)

    packed = stored(docs.mapInArrow(tokens, "chain long, part int, bucket long, words binary, kept binary"), "pretokens")
    replies = packed.where("bucket is not null").select("chain", "bucket", "words").groupBy("bucket").applyInArrow(meet, "chain long, bucket long, reply binary")
    waiting = packed.where("kept is not null").select("chain", "part", "kept")
    return waiting.groupBy("chain").cogroup(replies.groupBy("chain")).applyInArrow(place, schema)


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """encoded, and bytes_col (binary): the bytes of its ids' tokens, one after the other.

    A null list of ids gives null; an id outside the vocabulary is an error. A column of encoded named bytes_col gives
    way to it.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    encoded = without(encoded, bytes_col)
    at = encoded.columns.index(ids_col)
    tokens = _token_table(spark, vocab_path)

    def rows(batches):
        for b in batches:
            out = [None if x is None else _joined(x, tokens.value) for x in _lists(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, bytes_col])

    return encoded.mapInArrow(rows, T.StructType([*encoded.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def _token_table(spark, vocab_path: str):
    return spark.sparkContext.broadcast({i: t for t, i in read_ranks(vocab_path).items()})  # bounded by the vocabulary


def _lists(column):
    """Each row's ids as an array, or None."""
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False) if x.is_valid else None


def _joined(ids: np.ndarray, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def decoded_digests(encoded: DataFrame, vocab_path: str, ids_col: str = "ids") -> DataFrame:
    """decode() without its bytes: the other columns, and n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit) and decoded_sha256. A null list counts as empty."""
    spark = encoded.sparkSession
    small_batches(spark)
    encoded = without(encoded, "n_tokens", "ids_sha256", "decoded_sha256")
    at = encoded.columns.index(ids_col)
    rest = [i for i in range(len(encoded.columns)) if i != at]
    schema = T.StructType([*[encoded.schema.fields[i] for i in rest], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    tokens = _token_table(spark, vocab_path)

    def rows(batches):
        for b in batches:
            made = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(_joined(x, tokens.value)).hexdigest()) for x in (np.zeros(0, np.int64) if y is None else y for y in _lists(b.column(at)))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.array([m[0] for m in made], pa.int64()), *(pa.array([m[k] for m in made], pa.string()) for k in (1, 2))], names=[f.name for f in schema.fields])

    return encoded.mapInArrow(rows, schema)
