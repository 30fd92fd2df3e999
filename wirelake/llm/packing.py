"""Harmonic packing of token sequences.

A document's ids (with one closing id 0) are cut into pieces. A piece of length
n belongs to the reciprocal class k = capacity // n, capacity/(k + 1) < n <=
capacity/k, whose bins hold exactly k pieces each; from class ``SLACK`` on all
pieces, 1/``SLACK`` of a sequence at most, are one class, whose bins take the next
piece as long as it fits. Because documents may be cut, a piece is chosen to fill
its class: what is left of a document is one piece where k of its length leave at
most 1/``SLACK`` of a sequence empty; else the longest reciprocal that is shorter,
capacity // (k + 1), is cut off and the rest goes on the same way.

Each worker fills the bins of each class on its own, so nothing is shuffled.
What its last, unfilled bins hold at its end is packed together, longest pieces
first, each into the gap that it fills best. Sequences are padded to the
capacity by whoever reads them; their lengths and offsets tell where.

Cases: null and empty texts are one piece holding id 0. Repeated rows and
repeated or null ids are packed as often as they occur; ties in length keep the
order of the rows. An empty table gives no rows. A document of any length is cut
as it stands, and an open bin holds copies of its pieces only; columns other than
the id and the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_u32, text_or_empty
from .tokens import default_tokenizer, encode

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The part of a sequence that a class may leave empty is one in so many.
SLACK = 64


@cache
def _first_cut(rest: int, capacity: int) -> int:
    """The length of the first piece of ``rest`` ids."""
    if rest >= capacity:
        return capacity
    k = capacity // rest
    return rest if (capacity - k * rest) * SLACK <= capacity else capacity // (k + 1)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids, in order, without gaps."""
    out, at = [], 0
    while at < n:
        length = _first_cut(min(n - at, capacity), capacity)
        out.append((at, length))
        at += length
    return out


class Bins:
    """One worker's open bins. ``put`` gives a class's pieces with their sequence
    and offset once its bin is full; pieces wait while their bin is open."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next_id = capacity, worker << 40
        self.open: dict[int, list] = {}
        self.small = 0  # tokens in the open bin of the last class

    def _close(self, pieces: list):
        sequence, self.next_id, offset = self.next_id, self.next_id + 1, 0
        for piece, length in pieces:
            yield (*piece, sequence, offset)
            offset += length

    def put(self, piece: tuple, length: int):
        k = min(self.capacity // length, SLACK)
        if k == SLACK and self.small + length > self.capacity:
            yield from self._close(self.open.pop(k))
            self.small = 0
        bin_ = self.open.setdefault(k, [])
        bin_.append((piece, length))
        if k == SLACK:
            self.small += length
        elif len(bin_) == k:
            yield from self._close(self.open.pop(k))

    def finish(self):
        """What is left, of all classes: best fit by descending length. Some two
        thousand pieces wait here at most."""
        by_length: dict[int, list] = {}
        for k in sorted(self.open):
            for item in self.open[k]:
                by_length.setdefault(item[1], []).append(item)
        self.open, lengths = {}, sorted(by_length)
        while lengths:
            bin_, gap = [], self.capacity
            while (at := bisect_right(lengths, gap)) and gap:
                length = lengths[at - 1]
                bin_.append(by_length[length].pop(0))
                gap -= length
                if not by_length[length]:
                    del lengths[at - 1]
            yield from self._close(bin_)


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence,
    its crc32 and, with ``with_ids``, its ids."""
    if capacity < 1:
        raise ValueError("capacity has to be 1 or more")
    path = tokenizer or default_tokenizer()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    arrow = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    def run(batches):
        bins, rows = Bins(capacity, TaskContext.get().partitionId()), []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(text.as_py(), path), 0], np.uint32)
                for start, length in cuts(len(ids), capacity):
                    part = ids[start : start + length].copy()  # a view would keep the whole document
                    piece = (doc, start, length, crc32_u32(part), len(ids))
                    for row in bins.put((*piece, part) if with_ids else piece, length):
                        rows.append(order(row))
                    if len(rows) >= 2000:
                        yield batch(rows)
                        rows = []
        rows += [order(r) for r in bins.finish()]
        yield batch(rows)

    def order(row):
        return (*row[:5], *row[-2:], row[5].view(np.int32)) if with_ids else row

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)
