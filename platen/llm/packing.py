"""Sum-of-squares online packing of token sequences.

Each document's ids (with an end id) are cut into full windows and a tail. A
tail goes to the fill level that makes the sum of squared counts of partially
filled windows smallest; the counts live in one array indexed by level, and
opening a new window is the level 0. Ties prefer the fullest result. Every task
packs the documents that it reads: no row is shuffled, and a lost task packs the
same rows again.

At the end of a task the windows still open are cut and joined into full ones;
what is left (less than one window) is cut into powers of two, which need no
padding.

Defined cases: a null or empty text is a document of its end id alone; repeated
rows are packed once for each row; a null doc_id stays null; an empty table
gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.bpe import codec, few_rows, text_column

WINDOW = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

#: (doc_id, start, ids, tokens of the document)
Piece = tuple


class SumOfSquares:
    """The level array and the open windows of one task."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1)
        self.counts[window] = -0.5  # closing a window leaves no partially filled one
        self.closed = np.full(window + 1, np.inf)  # added where a level has no window
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece of 1 to window - 1 ids into a window; return the window if that fills it."""
        size = len(piece[2])
        last = self.window - size
        change = self.counts[size + 1 : self.window + 1] - self.counts[1 : last + 1] + self.closed[1 : last + 1]
        best = last - int(change[::-1].argmin())
        if change[best - 1] + 1 <= self.counts[size] + 0.5:
            held = self.open[best].pop()
            self.counts[best] -= 1
            if not self.open[best]:
                self.closed[best] = np.inf
        else:
            best, held = 0, []
        held.append(piece)
        if best + size == self.window:
            return held
        self.open[best + size].append(held)
        self.counts[best + size] += 1
        self.closed[best + size] = 0
        return None

    def rest(self) -> list[list[Piece]]:
        """The open windows, fullest first, cut and joined into full ones and powers of two."""
        pieces = [p for level in reversed(self.open) for held in level for p in held]
        left = sum(len(p[2]) for p in pieces)
        out, need, held = [], 0, []
        for doc, start, ids, tokens in pieces:
            while len(ids):
                if not need:
                    need = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                take = min(need, len(ids))
                held.append((doc, start, ids[:take], tokens))
                ids, start, need, left = ids[take:], start + take, need - take, left - take
                if not need:
                    out.append(held)
                    held = []
        return out


def pack(documents: Iterator[tuple[object, np.ndarray]], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Sequences of pieces from (doc_id, ids) pairs."""
    packer = SumOfSquares(window)
    for doc, ids in documents:
        n = len(ids)
        full = n - n % window
        for at in range(0, full, window):
            yield [(doc, at, ids[at : at + window], n)]
        if n > full and (done := packer.place((doc, full, ids[full:].copy(), n))):
            yield done
    yield from packer.rest()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""

    def run(batches):
        task = TaskContext.get().partitionId() << 33

        def documents():
            for batch in few_rows(batches):
                ids = codec(tokenizer).encode(batch.column(1).to_pylist())
                for doc, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                    yield doc, np.append(x, end_id).astype("<u4")

        rows: list[tuple] = []
        for number, sequence in enumerate(pack(documents(), window)):
            offset = 0
            for doc, start, ids, tokens in sequence:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, task + number, offset))
                offset += len(ids)
            if len(rows) >= 20_000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    return text_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)
