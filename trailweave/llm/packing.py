"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A piece goes into the window that it fits best; where it fits
none, the fullest is emitted and a new one opened (a window with more than ``sliver`` free places is first filled
up with the head of the piece, as documents may be cut anywhere). Whole windows are cut from long documents at
once. The windows left open at the end of a partition are dealt to ever fewer partitions and merged in the same way
until one is left. Space is bounded by the open windows of a task, not by its input.

Sequences are numbered by (round, partition, place), which is unique and needs no shuffle.

Defined cases: a null text is an empty one, and an empty text is its end token alone; the null doc_id is kept;
repeated rows are packed as often as they occur; a very long text is tokenized whole and cut over as many sequences as
it fills; of windows that fit equally well the one opened first is taken; other columns of the input, whatever their
names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.shared import written
from trailweave.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Partitions and sequences of a partition that a number has room for.
PLACES = 1 << 34


class Window:
    __slots__ = ("free", "pieces", "number")

    def __init__(self, room: int, number: int):
        self.free, self.pieces, self.number = room, [], number

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.free -= len(piece[2]) // 4


class Packer:
    """Pieces are (doc_id, start, ids as little-endian unsigned 32-bit, doc_tokens)."""

    def __init__(self, room: int, windows: int, sliver: int, emit: Callable[[Window], None]):
        self.room, self.most, self.sliver, self.emit = room, windows, sliver, emit
        self.open: list[tuple[int, int, Window]] = []  # by free places
        self.numbers = count()

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        at = bisect_left(self.open, (n,))
        if at < len(self.open):
            window = self.open.pop(at)[2]
        else:
            if len(self.open) >= self.most:
                window = self.open.pop(0)[2]
                if window.free > self.sliver:
                    doc_id, start, ids, total = piece
                    cut = window.free
                    window.add((doc_id, start, ids[: 4 * cut], total))
                    piece = (doc_id, start + cut, ids[4 * cut :], total)
                self.emit(window)
                return self._put(piece)
            window = Window(self.room, next(self.numbers))
        window.add(piece)
        if window.free:
            insort(self.open, (window.free, window.number, window))
        else:
            self.emit(window)
        return None

    def document(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.room
        for at in range(0, len(ids), step):
            self._put((doc_id, at // 4, ids[at : at + step], total))

    def window(self, pieces: list[tuple]) -> None:
        """A window left open elsewhere: whole where one has room for all of it, else piece by piece."""
        n = sum(len(p[2]) for p in pieces) // 4
        if bisect_left(self.open, (n,)) < len(self.open) or len(self.open) < self.most:
            joined = Window(n, 0)
            joined.pieces = pieces
            at = bisect_left(self.open, (n,))
            into = self.open.pop(at)[2] if at < len(self.open) else Window(self.room, next(self.numbers))
            for p in pieces:
                into.add(p)
            if into.free:
                insort(self.open, (into.free, into.number, into))
            else:
                self.emit(into)
        else:
            for p in pieces:
                self._put(p)


class _Out:
    """Rows of emitted windows, handed on in batches of a bounded size."""

    def __init__(self, first: int):
        self.rows, self.size, self.numbers = [], 0, count(first)

    def emit(self, window: Window, open_mark: bool = False) -> None:
        at, number = 0, next(self.numbers)
        if open_mark:
            number = -1 - number
        for doc_id, start, ids, total in window.pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, number, at))
            at += n
            self.size += len(ids)

    def batches(self, least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
            self.rows, self.size = [], 0


def _first_number(turn: int) -> int:
    return (turn << 58) + TaskContext.get().partitionId() * PLACES


def pack(docs: DataFrame, tokenizer: str, room: int = 1024, windows: int = 64, sliver: int = 8, end: int = 0, merge_fan_in: int = 32) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(tokenizer), _Out(_first_number(0))
        packer, tail = Packer(room, windows, sliver, out.emit), np.uint32(end).tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.document(doc_id, encode(text.as_py() or "") + tail)
                yield from out.batches()
        yield from out.batches(1)
        for _, _, window in packer.open:
            out.emit(window, True)
        yield from out.batches(1)

    def merged(turn: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = _Out(_first_number(turn))
            packer, held, at = Packer(room, windows, sliver, out.emit), [], None
            for batch in batches:
                for doc_id, start, _, ids, total, number, _ in zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True):
                    if number != at and held:
                        packer.window(held)
                        held = []
                    at = number
                    held.append((doc_id, start, ids, total))
                yield from out.batches()
            if held:
                packer.window(held)
            for _, _, window in packer.open:
                out.emit(window, not last)
            yield from out.batches(1)

        return run

    left = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, PIECES), "pack_0")
    done, turn = left.filter("sequence_id >= 0"), 0
    groups = left.filter("sequence_id < 0").select(F.countDistinct("sequence_id")).first()[0]
    while groups:
        turn += 1
        into = max(1, -(-groups // (windows * merge_fan_in)))
        still = left.filter("sequence_id < 0")
        dealt = still.repartition(into, "sequence_id") if into > 1 else still.coalesce(1)
        left = written(dealt.sortWithinPartitions("sequence_id", "offset").mapInArrow(merged(turn, into == 1), PIECES), f"pack_{turn}")
        done = done.unionByName(left.filter("sequence_id >= 0"))
        if into == 1:
            break
        groups = left.filter("sequence_id < 0").select(F.countDistinct("sequence_id")).first()[0]
    return done
