"""Bounded-space online packing of documents into sequences of a fixed length.

Each partition keeps a fixed number of open windows. A document's full lengths are sequences of their own; the rest goes
to the open window that it fits best. If none has room and all are in use, the fullest is emitted and a new one opened.
What is open at a partition's end is left over; the leftovers of neighbouring partitions are merged, the longest
piece first, each to the window that it fits best.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm import common
from terraspan.llm.tokens import END, library_encoder, vocabulary_path

#: Windows that a partition keeps open.
OPEN = 32
#: Partitions whose leftovers are merged by one task: 32 windows each, so 4 MB of ids at most at a length of 4096.
MERGED = 8
COLUMNS = ("start long", "length long", "ids binary", "doc_tokens long", "sequence_id long", "offset long")


class OpenWindows:
    """Windows with room, by what room they have; at most so many."""

    def __init__(self, length: int, most: int | None):
        self.length, self.most, self.rooms = length, most, []  # rooms: (room, number of the window), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def put(self, piece, size: int) -> list:
        """Place a piece; returns the pieces of a window that had to be emitted, or that is full now."""
        out: list = []
        at = bisect_left(self.rooms, (size, -1))
        if at == len(self.rooms):
            if self.most is not None and len(self.rooms) >= self.most:
                out = self.held.pop(self.rooms.pop(0)[1])  # the fullest
            room, window = self.length, self.next
            self.held[window], self.next = [], self.next + 1
        else:
            room, window = self.rooms.pop(at)
        self.held[window].append((piece, self.length - room))
        if room > size:
            insort(self.rooms, (room - size, window))
            return [out] if out else []
        return [x for x in (out, self.held.pop(window)) if x]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids: the piece's ids as little-endian unsigned 32-bit integers, without padding. Each document's ids (null text:
    none) are followed by the end id, so every row of docs has a piece, repeated rows too. Documents over the length
    are cut into full lengths and a rest. sequence_id and offset say where the piece lies; a sequence's pieces follow
    each other without gaps from 0. Other columns are ignored; an empty table gives no rows.
    """
    path = vocabulary or vocabulary_path()
    slim = docs.select(doc_id, common.text_or_empty(text).alias("__text"))
    schema = docs.select(doc_id).schema
    for c in COLUMNS:
        schema = schema.add(*c.split())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, end = library_encoder(path), TaskContext.get().partitionId(), np.array([END], "<u4").tobytes()
        windows, rows, number = OpenWindows(length, OPEN), [], 0

        def rows_of(window: list, open_: bool) -> None:
            nonlocal number
            rows.extend((*piece, -1 - (part << 31 | number) if open_ else part << 31 | number, offset) for piece, offset in window)
            number += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        kinds = None
        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for i, x in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                ids = encoder.ids(x) + end
                n = len(ids) // 4
                for at in range(0, n, length):
                    own = ids[4 * at : 4 * (at + length)]
                    for window in windows.put((i, at, len(own) // 4, own, n), len(own) // 4):
                        rows_of(window, False)
                if len(rows) >= 2000:
                    yield flushed()
        for window in windows.held.values():
            rows_of(window, True)
        if rows:
            yield flushed()
        common.give_back()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        size, window, offset = (table.column(c).to_numpy() for c in ("length", "sequence_id", "offset"))
        windows, where, number, closed = OpenWindows(length, None), np.zeros((len(size), 2), np.int64), 0, []
        # the longest first; window by window and piece by piece where they tie
        for k in np.lexsort((offset, -window, -size)).tolist():
            closed += windows.put(k, int(size[k]))
        for pieces in [*closed, *windows.held.values()]:
            for k, offset in pieces:
                where[k] = (1 << 62) | key[0].as_py() << 31 | number, offset
            number += 1
        table = table.select(names)
        return table.set_column(names.index("sequence_id"), "sequence_id", pa.array(where[:, 0])).set_column(names.index("offset"), "offset", pa.array(where[:, 1]))

    pieces = common.save(slim.mapInArrow(run, schema), "pieces")
    left = pieces.where("sequence_id < 0")
    group = F.shiftright(-1 - F.col("sequence_id"), 31 + MERGED.bit_length() - 1).alias("__group")
    return pieces.where("sequence_id >= 0").unionByName(left.groupBy(group).applyInArrow(merge, schema))


def query(spark, sf_dir):
    return pack(common.documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
