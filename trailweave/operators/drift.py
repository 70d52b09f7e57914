"""Changepoints of an address's behaviour: exact optimal partitioning of four standardized signals.

Spends come sorted by address, and addresses with equally many spends are partitioned together, so an address costs a few
array elements rather than a call of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.schema import SATS

LEAST, MIN_SIZE = 8, 3
#: Spends that are judged at once, about; addresses with more spends than the second are partitioned alone, in time that pruning bounds.
ROWS, LONG = 1 << 15, 64


def changepoints(signal: np.ndarray, penalty: float, min_size: int = MIN_SIZE) -> list[int]:
    """Cuts of the partition that minimises squared error plus a penalty for each segment, pruned as it goes."""
    n = len(signal)
    sums, squares = np.vstack([np.zeros(signal.shape[1]), signal.cumsum(0)]), np.concatenate([[0.0], (signal**2).sum(1).cumsum()])
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0], starts = -penalty, np.array([0])
    for end in range(min_size, n + 1):
        ready = starts[end - starts >= min_size]
        cost = squares[end] - squares[ready] - ((sums[end] - sums[ready]) ** 2).sum(1) / (end - ready)
        total = best[ready] + cost
        at = int(total.argmin())
        best[end], back[end] = total[at] + penalty, ready[at]
        keep = np.concatenate([ready[total <= best[end]], starts[end - starts < min_size]])
        starts = np.append(keep, end - min_size + 1) if end - min_size + 1 >= min_size else keep
    cuts, at = [], n
    while at > 0:
        at = int(back[at])
        if at > 0:
            cuts.append(at)
    return cuts[::-1]


def many_changepoints(signals: np.ndarray, penalty: float, min_size: int = MIN_SIZE) -> list[list[int]]:
    """``changepoints`` of signals (number, length, dimension) of one length, with the same pruning, ties and arithmetic."""
    many, n, _ = signals.shape
    sums, squares = np.zeros((many, n + 1, signals.shape[2])), np.zeros((many, n + 1))
    sums[:, 1:], squares[:, 1:] = signals.cumsum(1), (signals**2).sum(2).cumsum(1)
    best, back, alive = np.full((many, n + 1), np.inf), np.zeros((many, n + 1), int), np.ones((many, n + 1), bool)
    best[:, 0], alive[:, 1:min_size] = -penalty, False
    for end in range(min_size, n + 1):
        m = end - min_size + 1  # starts that are far enough before
        cost = squares[:, end, None] - squares[:, :m] - ((sums[:, end, None] - sums[:, :m]) ** 2).sum(2) / (end - np.arange(m))
        total = np.where(alive[:, :m], best[:, :m] + cost, np.inf)
        at = total.argmin(1)
        best[:, end], back[:, end] = total[np.arange(many), at] + penalty, at
        alive[:, :m] &= total <= best[:, end, None]
    out: list[list[int]] = []
    for row in back:
        cuts, at = [], int(row[n])
        while at > 0:
            cuts.append(at)
            at = int(row[at])
        out.append(cuts[::-1])
    return out


_JUDGED = pa.schema([("address", pa.string()), ("status", pa.string()), ("score", pa.float64()), ("txid", pa.string()), ("at", pa.int64()), ("place", pa.int32()), ("shift", pa.float64())])


def _judged(spends: pa.Table, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of whole addresses' spends, in order; ``codes`` number the addresses."""
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
    sizes = np.diff([*firsts, len(codes)])
    number = lambda c, null: spends.column(c).fill_null(null).to_numpy()
    seconds, vsize = number("at", 0) / 1e6, number("vsize", 0.0)
    rate = np.where(vsize > 0, number("fee_sats", 0.0) / np.where(vsize == 0, 1.0, vsize), 0)
    flat = np.column_stack([number("out_sats", 0.0) / SATS, np.zeros(len(codes)), number("n_out", 0.0), np.maximum(rate, 0)])
    addresses, txids, times = spends.column("address"), spends.column("txid"), spends.column("at")
    rows: list[tuple] = [(addresses[i].as_py(), "insufficient_history", None, None, None, None, None) for i in firsts[sizes < LEAST]]
    for n in np.unique(sizes[sizes >= LEAST]):
        own = firsts[sizes == n]
        places = own[:, None] + np.arange(n)
        gaps = np.diff(seconds[places], axis=1)
        raw = flat[places]
        raw[:, :, 1] = np.maximum(np.concatenate([np.median(gaps, axis=1)[:, None], gaps], axis=1), 0)
        raw = np.log1p(raw)
        signals = (raw - raw.mean(1)[:, None]) / np.maximum(raw.std(1), 0.1)[:, None]
        penalty = 4 * np.log(n)
        every = many_changepoints(signals, penalty) if n <= LONG else [changepoints(s, penalty) for s in signals]
        for first, signal, cuts in zip(own.tolist(), signals, every, strict=True):
            bounds = [0, *cuts, n]
            shifts = [float(np.linalg.norm(signal[b:c].mean(0) - signal[a:b].mean(0))) for a, b, c in zip(bounds, bounds[1:], bounds[2:], strict=False)]
            score, address = min(1.0, max(shifts, default=0.0) / 4), addresses[first].as_py()
            rows += [(address, "changed", score, txids[first + c].as_py(), times[first + c].as_py(), c, s) for c, s in zip(cuts, shifts, strict=True)] or [(address, "stable", score, None, None, None, None)]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _JUDGED, strict=True)], schema=_JUDGED)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges sorted spends some addresses at a time; the last address waits until its rows are complete."""
    held: list[pa.RecordBatch] = []
    coded = lambda t: t.column("address").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS or held[0].column("address")[0] == batch.column("address")[-1]:
            continue
        table = pa.Table.from_batches(held)
        codes = coded(table)
        last = int(np.flatnonzero(np.diff(codes))[-1]) + 1
        yield from _judged(table.slice(0, last), codes[:last])
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield from _judged(table, coded(table))


def behavioural_drift(spent: DataFrame) -> DataFrame:
    """A row for each change of each address, or one with its status: address, status, score, txid, first_seen, place, shift."""
    number = lambda c: F.col(c).cast("double").alias(c)
    slim = spent.select("address", F.col("txid").cast("string").alias("txid"), F.unix_micros(F.col("first_seen").cast("timestamp")).alias("at"), number("out_sats"), number("n_out"), number("fee_sats"), number("vsize"))
    ordered = slim.repartition("address").sortWithinPartitions("address", F.asc_nulls_last("at"), "txid")
    out = ordered.mapInArrow(_detect, "address string, status string, score double, txid string, at long, place int, shift double")
    return out.select("address", "status", "score", "txid", F.timestamp_micros("at").alias("first_seen"), "place", "shift")
