"""Isolation forest: trees grown from a bounded sample on the driver, scored everywhere from a broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.models import shap

LEAST_ROWS = 20


def average_path(n: float | np.ndarray) -> float | np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    value: np.ndarray  # path length at a leaf, its mean over the sample at an inner node


def grow(rows: np.ndarray, rng: np.random.Generator) -> Tree:
    most = int(np.ceil(np.log2(max(2, len(rows)))))
    nodes: list[list] = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, len(part), depth + float(average_path(len(part)))])
        spread = part.max(0) - part.min(0) if len(part) else np.zeros(rows.shape[1])
        if depth < most and len(part) > 1 and (spread > 0).any():
            f = int(rng.choice(np.flatnonzero(spread > 0)))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            low = part[:, f] <= cut
            left, right = add(part[low], depth + 1), add(part[~low], depth + 1)
            mean = (nodes[left][5] * nodes[left][4] + nodes[right][5] * nodes[right][4]) / len(part)
            nodes[at] = [f, cut, left, right, len(part), mean]
        return at

    add(rows, 0)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


@dataclass
class Forest:
    names: list[str]
    trees: list[Tree]
    sample: int

    def path_lengths(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for t in self.trees:
            at = np.zeros(len(rows), int)
            while (t.feature[at] >= 0).any():
                inner = t.feature[at] >= 0
                f = np.where(inner, t.feature[at], 0)
                at = np.where(inner, np.where(rows[np.arange(len(rows)), f] <= t.cut[at], t.left[at], t.right[at]), at)
            total += t.value[at]
        return total / len(self.trees)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """2 to the minus mean path over the expected path."""
        return 2.0 ** (-self.path_lengths(rows) / float(average_path(self.sample)))

    def base(self) -> float:
        return float(np.mean([t.value[0] for t in self.trees]))

    def leaves(self) -> list[list[shap.Path]]:
        return [shap.paths(t) for t in self.trees]

    def contributions(self, rows: np.ndarray, leaves: list[list[shap.Path]] | None = None) -> np.ndarray:
        """Per feature, how much it lengthens a row's mean path: Shapley values.

        They add up, with ``base``, to the path length, and don't depend on the order of a path's splits.
        """
        return shap.shapley(leaves or self.leaves(), rows, len(self.names))


def fit(profiles: DataFrame, names: list[str], trees: int = 160, sample: int = 256, seed: int = 41, most_rows: int = 20_000) -> Forest:
    """A forest on a hashed sample of at most about ``most_rows`` profiles, the documented bound of what the driver holds."""
    n = profiles.count()
    if n < LEAST_ROWS:
        raise ValueError(f"at least {LEAST_ROWS} profiles are needed")
    drawn = profiles.filter(F.pmod(F.xxhash64(F.lit(seed), "address"), F.lit(1 << 20)) < min(1.0, most_rows / n) * (1 << 20))
    rows = drawn.orderBy("address").select(*names).toPandas().to_numpy(float)
    rng, size = np.random.default_rng(seed), min(sample, len(rows))
    return Forest(names, [grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)], size)


def score(profiles: DataFrame, forest: Forest, column: str, reference: np.ndarray | None = None) -> DataFrame:
    """``profiles`` with a raw score, and its share of ``reference`` scores at or below it as ``column`` + '_percentile'."""
    shared = profiles.sparkSession.sparkContext.broadcast((forest, None if reference is None else np.sort(reference)))

    @F.pandas_udf("raw double, percentile double")
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, reference = shared.value
        for pdf in batches:
            raw = forest.raw(pdf.to_numpy(float))
            rank = np.searchsorted(reference, raw, side="right") / len(reference) if reference is not None and len(reference) else np.full(len(raw), np.nan)
            yield pd.DataFrame({"raw": raw, "percentile": rank})

    scored = profiles.withColumn("_s", judge(F.struct(*forest.names)))
    return scored.withColumns({column: F.col("_s.raw"), f"{column}_percentile": F.col("_s.percentile")}).drop("_s")
