"""Best-fit packing: documents as token sequences of one size, by bounded-space best fit.

Each partition packs its own documents online. A fixed number of bins is open at a time, kept
in a bitset keyed by free space: bit ``f`` is set while some open bin has ``f`` tokens free, so
the best fit for a piece is the lowest bit at or above its length. When a new bin is needed and
none may be opened, the fullest open one closes. No shuffle, and memory that does not grow with
the partition; the cost is at most ``open_bins`` bins per partition that are not full.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallymark.llm.common import encoded, runs_of
from tallymark.llm.tokens import encoder

SEQUENCE_TOKENS = 2048
OPEN_BINS = 1024
_TEXTS_AT_ONCE = 256

PIECE_SCHEMA = (
    "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


class OpenBins:
    """A bounded number of open bins, found by their free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        taken = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.open -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        """Return the bin that gets a piece of ``length`` and the piece's place in it."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            space, chosen = self.size, self.made
            self.made += 1
            if self.open == self.most and length < self.size:
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = space - length
        if left:
            self.free[left].append(chosen)
            self.bits |= 1 << left
            self.open += 1
        return chosen, self.size - space


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    size: int = SEQUENCE_TOKENS,
    open_bins: int = OPEN_BINS,
    cached_pieces: int | None = None,
) -> DataFrame:
    """Return one row per piece of a document with its sequence and its place there.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A document is its token
    ids and ``end_id``; ``ids`` holds those of the piece as little-endian unsigned 32-bit
    numbers. Only a document of more than ``size`` ids is cut: its first piece takes the
    remainder, the others are full. Within a batch of rows the longest pieces go first.

    A null or empty text is a document of the end id alone. Null and repeated ids are packed
    like any others, row by row. An empty table gives no rows. Fewer ``cached_pieces`` of text
    whose ids a worker remembers take less memory and more time; the ids are the same.
    """
    if size < 1 or open_bins < 1:
        raise ValueError("size and open_bins must be positive")
    end = np.array([end_id], dtype="<u4").tobytes()

    def packed(batches):
        bins = OpenBins(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        encode = encoder(tokenizer_path, cached_pieces).encode
        for batch in batches:
            for first in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                yield placed(batch.slice(first, _TEXTS_AT_ONCE), bins, base, encode)

    def placed(batch, bins, base, encode):
        texts = [text or "" for text in batch.column("text").to_pylist()]
        ids = [done + end for done in encode(texts)]
        counts = np.array([len(one) >> 2 for one in ids], dtype=np.int64)
        pieces = np.maximum(1, -(-counts // size))
        row = np.repeat(np.arange(len(ids)), pieces)
        piece = runs_of(pieces)
        head = counts - (pieces - 1) * size
        start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
        length = np.where(piece == 0, head[row], size)
        bin_of, offset = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
        for at in np.argsort(-length, kind="stable").tolist():
            bin_of[at], offset[at] = bins.place(int(length[at]))
        cut = [ids[r][4 * s : 4 * (s + n)] for r, s, n in zip(row, start, length, strict=True)]
        columns = [
            batch.column("doc_id").take(pa.array(row)),
            piece.astype(np.int32),
            start,
            length,
            pa.array(cut, pa.binary()),
            base + bin_of,
            offset,
        ]
        return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], schema=_ARROW)

    chosen = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return chosen.mapInArrow(packed, PIECE_SCHEMA)
