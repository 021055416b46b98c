"""Packing token sequences: vector bin packing by the dot-product heuristic.

An item has three demands: tokens, segments and loss-bearing tokens; a sequence has a limit for each. The open
sequence takes the waiting item whose demands have the largest dot product with what is left of it (Panigrahy et al.,
Heuristics for Vector Bin Packing); where no item fits whole and cutting is allowed, the best item is cut to fill it.
Packing happens within each partition, so nothing is shuffled, and the waiting pool is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches, without
from .tokenizer import encoding, read_added, read_ranks

#: Items that wait for a sequence at a time; bounds memory and the work of each choice, not the rows that are packed.
POOL = 512
OUT = (("start", T.LongType()), ("length", T.LongType()), ("loss_tokens", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType()))


class Packer:
    """Places items (key, size, loss_from) and yields pieces (key, start, length, loss, sequence, offset).

    Tokens before loss_from bear no loss. The pool is an array of demands, so that a choice is one vector operation.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first_sequence: int):
        self.limit = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss
        self.need = np.zeros((0, 3))
        self.items: list[list[int]] = []  # key, next start, end, loss_from
        self.sequence = first_sequence - 1
        self.open(max_tokens)

    def open(self, tokens: int) -> None:
        self.sequence += 1
        self.tokens, self.segments, self.loss, self.offset = tokens, self.max_segments, self.max_loss, 0

    def add(self, items) -> None:
        new = [[k, 0, n, min(max(a, 0), n)] for k, n, a in items if n]
        self.items += new
        self.need = np.vstack([self.need, *[[[n, 1, n - a]] for _, _, n, a in new]]) if new else self.need

    def waiting(self) -> float:
        return self.need[:, 0].sum()

    def _cut(self, item: list[int]) -> int:
        """The longest piece of item that the open sequence takes."""
        _, start, end, loss_from = item
        return max(0, min(end - start, self.tokens, max(0, loss_from - start) + self.loss))

    def place(self):
        """Place one piece; None if nothing fits and the sequence had to be closed."""
        left = np.array([self.tokens, self.segments, self.loss], np.float64)
        fits = (self.need <= left).all(axis=1)
        score = (self.need * (left / self.limit**2)).sum(axis=1)
        if fits.any():
            i = int(np.argmax(np.where(fits, score, -1.0)))
            size = self.items[i][2] - self.items[i][1]
        else:
            i, size = int(np.argmax(score)), 0
            if self.segments:
                size = self._cut(self.items[i])
                if not size:  # any other that can give a piece
                    i, size = max(((j, self._cut(x)) for j, x in enumerate(self.items)), key=lambda p: p[1])
        if not size:
            return None
        key, start, end, loss_from = self.items[i]
        loss = max(0, start + size - max(start, loss_from))
        piece = (key, start, size, loss, self.sequence, self.offset)
        self.tokens, self.segments, self.loss, self.offset = self.tokens - size, self.segments - 1, self.loss - loss, self.offset + size
        if start + size == end:
            self.items[i], self.need[i] = self.items[-1], self.need[-1]
            self.items.pop()
            self.need = self.need[:-1]
        else:
            self.items[i][1] = start + size
            self.need[i] = (end - start - size, 1, end - max(start + size, loss_from))
        return piece

    def run(self, drain: bool):
        """Pieces, until less than one sequence waits; with drain, until nothing does: the rest then goes to sequences
        whose sizes are powers of two, which need no padding."""
        while self.items and (drain or self.waiting() >= 2 * self.max_tokens):
            if drain and not self.offset and (n := self.waiting()) < self.max_tokens:
                self.tokens = 1 << (int(n).bit_length() - 1)
            if (piece := self.place()) is not None:
                yield piece
            if piece is None or not self.tokens:
                self.open(self.max_tokens)


def pack(docs: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", loss_from_col: str | None = None, max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None, end_id: int | None = 1) -> DataFrame:
    """Pieces of documents in sequences: the columns of docs but the text, and start, length, loss_tokens, doc_tokens,
    sequence_id, offset, ids (binary: little-endian unsigned 32-bit).

    A document's tokens are the ids of its text by the vocabulary, added tokens of a .json file included, then end_id
    (None: none). Every token lies in exactly
    one piece; the pieces of a sequence start at offset 0 and leave no gap. loss_from_col: a column with the number of
    leading tokens that bear no loss (null: 0). No sequence breaks a limit; max_loss is max_tokens unless given.
    Nulls: a null text counts as empty and has end_id alone; without end_id it has no piece. Repeated rows are packed
    each; a null id is carried as null. An empty table gives an empty result. Columns of docs that have an output's
    name give way to it. Sequence ids are the partition number times 2**33 and a count.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, *(n for n, _ in OUT if n != loss_from_col))
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocab_path))  # bounded by the vocabulary
    added = read_added(vocab_path)
    text_at, loss_at = docs.columns.index(text_col), docs.columns.index(loss_from_col) if loss_from_col else None
    rest = [i for i, c in enumerate(docs.columns) if c not in (text_col, loss_from_col if loss_from_col in dict(OUT) else None)]
    schema = T.StructType([*[docs.schema.fields[i] for i in rest], *[T.StructField(n, t) for n, t in OUT]])
    names = [f.name for f in schema.fields]
    max_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")

    def rows(batches):
        enc = encoding(ranks.value, pattern, vocab_path, added)
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 33)
        held: dict[int, list] = {}  # of items that wait: row, ids, tokens left
        tail, count = np.array([] if end_id is None else [end_id], np.uint32), 0

        def taken(pieces):
            cols, ids, batches_of = [], [], {}
            for key, start, size, loss, sequence, offset in pieces:
                row = held[key]
                cols.append((start, size, loss, len(row[1]), sequence, offset))
                ids.append(row[1][start : start + size].tobytes())
                batches_of[len(ids) - 1] = row[0]
                row[2] -= size
                if not row[2]:
                    del held[key]
            if ids:
                carried = pa.concat_tables([pa.Table.from_batches([x]) for x in batches_of.values()]).combine_chunks().to_batches()[0] if rest else None
                made = [pa.array([c[k] for c in cols], pa.int64()) for k in range(6)] + [pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(carried.columns if rest else []), *made], names=names)

        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(i) for i in rest], names=names[: len(rest)]) if rest else None
            texts = batch.column(text_at)
            for lo in range(0, batch.num_rows, POOL):
                new = []
                for i in range(lo, min(lo + POOL, batch.num_rows)):
                    ids = np.concatenate([enc.encode_to_numpy(texts[i].as_py() or "", allowed_special="all", disallowed_special=()).astype("<u4"), tail])
                    held[count] = [own.slice(i, 1) if rest else None, ids, len(ids)]
                    if not len(ids):
                        del held[count]
                    new.append((count, len(ids), (batch.column(loss_at)[i].as_py() or 0) if loss_at is not None else 0))
                    count += 1
                packer.add(new)
                yield from taken(packer.run(False))
        yield from taken(packer.run(True))

    return docs.mapInArrow(rows, schema)
