"""Shapley values of tree ensembles by the polynomial path algorithm.

What a tree says of a row when only some features are known is the mean over its leaves, a split on an unknown feature
sending on the shares that the sample had. A leaf's part of that is a product over the features of its path: of a known
one 1 or 0 (whether the row stays on the path at all splits of that feature), of an unknown one the share of the sample
that stays. The weights of all sets of a size are carried along the path (extend), and taking a feature off the path
again (unwind) gives its weighted sum over all sets without it, in time that grows with the square of the path.

A leaf's values depend on a row only through the bits "stays on the path" of its features, so they are computed once
for every pattern of bits that occurs among a batch of rows, and looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Path:
    """A leaf: the features on its way, the open-closed range that each allows, the sample's share that stays, the leaf's value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def paths(tree) -> list[Path]:
    """The leaves of a tree of ``feature, cut, left, right, size, value`` (-1 is a leaf's feature; a row goes left at most at the cut)."""
    out, todo = [], [(0, {})]
    while todo:
        at, way = todo.pop()
        f = int(tree.feature[at])
        if f < 0:
            names = np.array(sorted(way), int)
            low, high, share = (np.array([way[n][i] for n in names], float) for i in range(3))
            out.append(Path(names, low, high, share, float(tree.value[at])))
            continue
        low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
        for child, new in ((tree.left[at], (low, min(high, tree.cut[at]))), (tree.right[at], (max(low, tree.cut[at]), high))):
            part = tree.size[child] / tree.size[at]
            if part > 0:  # nobody of the sample went there: it weighs nothing where a feature is unknown, and no row is sent
                todo.append((int(child), way | {f: (*new, share * part)}))
    return out


def pattern_values(stays: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For patterns (rows of 0 and 1) over a path's features with their shares, each feature's weighted sum over all sets."""
    m = stays.shape[1]
    weights = np.zeros((len(stays), m + 1))
    weights[:, 0] = 1
    for k in range(1, m + 1):  # extend: a set of i + 1 comes from one of i with the feature, one of i stays without
        one, zero = stays[:, k - 1], share[k - 1]
        for i in range(k - 1, -1, -1):
            weights[:, i + 1] += one * weights[:, i] * ((i + 1) / (k + 1))
            weights[:, i] *= zero * ((k - i) / (k + 1))
    total, after = np.zeros((len(stays), m)), np.repeat(weights[:, m:], m, axis=1)
    for i in range(m - 1, -1, -1):  # unwind every feature at once
        known = after * ((m + 1) / (i + 1))
        rest = weights[:, i : i + 1]
        total += np.where(stays > 0, known, rest * (m + 1) / (share * (m - i)))
        after = rest - known * share * ((m - i) / (m + 1))
    return total * (stays - share)


def shapley(leaves: list[list[Path]], rows: np.ndarray, features: int) -> np.ndarray:
    """Values (rows x features) of the mean of the trees whose leaves are given."""
    out = np.zeros((len(rows), features))
    for tree in leaves:
        for leaf in tree:
            m = len(leaf.features)
            if not m or not len(rows):
                continue
            x = rows[:, leaf.features]
            stays = (x > leaf.low) & (x <= leaf.high)
            # bits of up to 62 features; a longer path is told apart row by row
            code = stays @ (1 << np.arange(m, dtype=np.int64)) if m <= 62 else np.arange(len(rows))
            _, first, of = np.unique(code, return_index=True, return_inverse=True)
            out[:, leaf.features] += leaf.value * pattern_values(stays[first].astype(float), leaf.share)[of]
    return out / max(1, len(leaves))


def base(leaves: list[list[Path]]) -> float:
    """What the trees say of a row of which nothing is known."""
    return float(np.mean([sum(p.value * p.share.prod() for p in tree) for tree in leaves]))


def explained(rows: DataFrame, trees: list, names: list[str], column: str = "shapley") -> DataFrame:
    """``rows`` with an array of Shapley values, in the order of ``names``, of the mean of ``trees``."""
    shared = rows.sparkSession.sparkContext.broadcast([paths(t) for t in trees])

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            yield pd.Series(list(shapley(shared.value, pdf.to_numpy(float), len(names))))

    return rows.withColumn(column, run(F.struct(*[F.col(n).cast("double") for n in names])))
