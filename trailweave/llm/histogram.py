"""Exact quantiles of a 128-bit key by repeated histograms, as a histogram sort finds its splitters.

Each round counts, in one pass over the partitions, the exact weight and rows below evenly spaced candidate keys
inside the intervals that are still open (the digits of the key are the candidates); the driver keeps a candidate
as soon as it meets its target's tolerance and opens only the digit that straddles the target otherwise. What
comes to the driver in a round is one row for each digit of each open interval, whatever the size of the data; there
are no more open intervals than targets, and with hashed keys and tolerances of a cell's half the first round leaves
only the cells of keys that weigh more than a target's share.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.shared import literal_table

HALF, WORD = 1 << 63, 1 << 64


@dataclass(frozen=True)
class Found:
    """The boundary found for a target: keys below ``key`` weigh ``weight`` and number ``rows``."""

    target: int
    key: int
    weight: int
    rows: int


def signed(key: int) -> tuple[int, int]:
    """The two longs of a 128-bit key."""
    return (key >> 64) - HALF, (key & (WORD - 1)) - HALF


def _bits(word: Column, taken: int, width: int) -> Column:
    """``width`` bits after the first ``taken`` of a long, in the order of signed longs."""
    turned = word.bitwiseXOR(F.lit(-HALF).cast("long"))
    out = F.shiftrightunsigned(turned, 64 - taken - width)
    return out if not taken else out.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _prefix(word: Column, taken: int) -> Column:
    """The first ``taken`` bits of a long as a long; of none 0, of all 64 the word itself."""
    if taken == 64:
        return word
    return _bits(word, 0, taken) if taken else F.lit(0).cast("long")


def totals(narrow: DataFrame) -> dict[int, tuple[int, int]]:
    """Weight and rows of each part."""
    return {r[0]: (r[1] or 0, r[2]) for r in narrow.groupBy("part").agg(F.sum("weight"), F.count(F.lit(1))).collect()}


def locate(narrow: DataFrame, targets: dict[int, list[tuple[int, int]]], widths: list[int]) -> dict[int, list[Found]]:
    """The boundary for each (weight, tolerance) in ``targets`` of each part, in the targets' order.

    ``narrow`` has part int, k1 and k2 long, weight long. ``widths`` are the digits' bits; a digit lies in one of
    the two words. Where no key splits the target's cell, the nearer edge of it is the boundary.
    """
    spark, taken = narrow.sparkSession, 0
    found: dict[tuple[int, int], Found] = {}
    # (part, prefix) -> (weight below, rows below, targets inside)
    open_at = {(part, 0): (0, 0, sorted(set(ts))) for part, ts in targets.items() if ts}
    for width in widths:
        if not open_at:
            break
        w1, w2 = min(taken, 64), max(0, taken - 64)
        rows = narrow.withColumns({"p1": _prefix(F.col("k1"), w1), "p2": _prefix(F.col("k2"), w2), "digit": _bits(F.col("k1"), taken, width) if taken < 64 else _bits(F.col("k2"), taken - 64, width)})
        if taken:
            split = [(part, (at >> w2), at & ((1 << w2) - 1)) for part, at in open_at]
            as_row = [[part, a - HALF if w1 == 64 else a, b] for part, a, b in split]
            rows = rows.join(F.broadcast(literal_table(spark, as_row, "part int, p1 long, p2 long")), ["part", "p1", "p2"])
        cells = defaultdict(list)
        for part, p1, p2, digit, weight, count in rows.groupBy("part", "p1", "p2", "digit").agg(F.sum("weight"), F.count(F.lit(1))).collect():
            cells[part, ((p1 + HALF if w1 == 64 else p1) << w2) | p2].append((digit, weight, count))
        opened: dict[tuple[int, int], tuple[int, int, list]] = {}
        last = taken + width == sum(widths)
        for (part, at), (below, rows_below, wanted) in open_at.items():
            rest = list(wanted)
            for digit, weight, count in sorted(cells.get((part, at), [])):
                here, rest = [t for t in rest if t[0] < below + weight], [t for t in rest if t[0] >= below + weight]
                inside = []
                for target, tolerance in here:
                    key, end = (((at << width) | digit) << (128 - taken - width)), ((((at << width) | digit) + 1) << (128 - taken - width))
                    low, high = target - below, below + weight - target
                    if low <= tolerance and low <= high:
                        found[part, target] = Found(target, key, below, rows_below)
                    elif high <= tolerance:
                        found[part, target] = Found(target, end, below + weight, rows_below + count)
                    elif count > 1 and not last:
                        inside.append((target, tolerance))
                    else:
                        found[part, target] = Found(target, *((key, below, rows_below) if low <= high else (end, below + weight, rows_below + count)))
                if inside:
                    opened[part, (at << width) | digit] = (below, rows_below, inside)
                below, rows_below = below + weight, rows_below + count
            for target, _ in rest:  # at or beyond all the weight
                found[part, target] = Found(target, 1 << 128, below, rows_below)
        open_at, taken = opened, taken + width
    return {part: [found[part, t] for t, _ in ts] for part, ts in targets.items()}
