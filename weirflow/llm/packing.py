"""Packing: documents into windows of a fixed number of tokens, best fit decreasing.

A token is a run of non-blanks. A document longer than the window is first cut
into full windows; what is left of it, and every shorter document, are packed
by decreasing length into the open window with the least room that is enough,
found in a segment tree indexed by remaining capacity.

Best fit is sequential, so documents are dealt by hash of (id, length, number of
the copy) into units of about UNIT documents, and each unit is packed by itself: a
unit leaves a few windows partly filled, out of many thousands, and units run side
by side. An id of very many rows is spread over all units.

Defined results: rows with null id, null text or no tokens take no part; a text of
any length is cut into windows; ties go to the least (doc_id, length), and among
windows with equal room to the one opened last; repeated rows are packed as often
as they come; empty tables give no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.labelled import keyed
from weirflow.llm.mixing import token_spans
from weirflow.llm.textkit import slices
from weirflow.session import written

WINDOW = 2048
UNIT = 20_000


class Rooms:
    """Open windows by remaining capacity: a segment tree over capacities 0..most that finds the least one >= need."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        at = self.open.setdefault(room, [])
        at.append(window)
        if len(at) == 1:
            k = room + self.size
            while k and not self.any[k]:
                self.any[k] = 1
                k >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out (room, window) of the least room >= need."""
        k = need + self.size
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        room = k - self.size
        window = self.open[room].pop()
        if not self.open[room]:
            while k:
                self.any[k] = 0
                k >>= 1
                if k and (self.any[2 * k] or self.any[2 * k + 1]):
                    break
        return room, window


def pack(ids: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(window, offset in it, row, start in the document, tokens) of each segment."""
    order = np.lexsort((lengths, ids))
    full = lengths[order] // window
    row = np.repeat(order, full)
    k = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    opened = len(row)
    rest = lengths % window
    o = np.lexsort((lengths, ids, -rest))
    o = o[rest[o] > 0]
    rooms = Rooms(window)
    win, off = [], []
    for n in rest[o].tolist():
        found = rooms.tightest(n)
        if found is None:
            found, opened = (window, opened), opened + 1
        room, w = found
        win.append(w)
        off.append(window - room)
        if room > n:
            rooms.add(room - n, w)
    return (
        np.concatenate([np.arange(len(row)), np.array(win, np.int64)]),
        np.concatenate([np.zeros(len(row), np.int64), np.array(off, np.int64)]),
        np.concatenate([row, o]),
        np.concatenate([k * window, lengths[o] - rest[o]]),
        np.concatenate([np.full(len(row), window), rest[o]]),
    )


def lengths(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(token_spans(b.column("text"))[3]))], ["doc_id", "n"])

    return keyed(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "doc_id long, n long").where("n > 0")


def packed(docs: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """(unit, window, offset, doc_id, start, n_tokens): each segment and where it lies."""
    n = written(lengths(docs).groupBy("doc_id", "n").agg(F.count("*").alias("copies")))
    units = max(1, math.ceil((n.agg(F.sum("copies")).first()[0] or 0) / unit))

    def run(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        ids, size = (t.column(c).to_numpy() for c in ("doc_id", "n"))
        win, off, row, start, m = pack(ids, size, window)
        return pa.table({"unit": pa.array(np.full(len(win), key[0].as_py())), "window": win, "offset": off, "doc_id": ids[row], "start": start, "n_tokens": m})

    each = n.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    dealt = each.select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n", "copy"), F.lit(units)).alias("unit"))
    return dealt.groupBy("unit").applyInArrow(run, "unit long, window long, offset long, doc_id long, start long, n_tokens long")
