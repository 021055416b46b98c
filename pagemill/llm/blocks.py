"""Blocks: a few megabytes of whole rows each, packed, so that what a corpus exchanges moves as arrays, not as rows.

A block is one or more whole rows; only a single row longer than a block makes one larger. Messages between blocks and
the buckets of a hash are packed and compressed; a bucket is one group of a shuffle and is sized by the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

BLOCK = 4 << 20
#: Of whole rows, which are written once and shuffled once.
ROWS_LEVEL = 6


def pack(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=ROWS_LEVEL))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def bytes_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def cut(batches, text_at: int, size: int = BLOCK):
    """Tables of about size bytes of text each, from an iterator of record batches."""
    held, total = [], 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0), np.int64)
        lo = 0
        while lo < batch.num_rows:
            reach = np.cumsum(lengths[lo:])
            n = min(int(np.searchsorted(reach, size - total)) + 1, batch.num_rows - lo)
            held.append(batch.slice(lo, n))
            total += int(reach[n - 1])
            lo += n
            if total >= size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def blocks(df: DataFrame, text_col: str, size: int = BLOCK) -> DataFrame:
    """(n_bytes, payload) of df's rows; payload: all their columns."""
    at = df.columns.index(text_col)

    def rows(batches):
        for t in cut(batches, at, size):
            n = pc.sum(pc.binary_length(t.column(at))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([table_bytes(t)], pa.binary())], names=["n_bytes", "payload"])

    return df.mapInArrow(rows, "n_bytes long, payload binary")


def texts_of(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
