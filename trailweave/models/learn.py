"""Groups, calibrators and the neighbourhood model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions.selection import medians
from trailweave.session import written


#: Fixed value: inverse strength of the penalty of the feedback model.
FEEDBACK_STRENGTH = 1.0


def scales(rows: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median (exact, in bounded memory), mean and population standard deviation of each column."""
    got = rows.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    middle = medians(rows, names).first()
    return {c: (middle[c] if middle else None, got[f"mean_{c}"], got[f"std_{c}"] or 1.0) for c in names}


def standardized(rows: DataFrame, names: list[str], by: dict[str, tuple[float, float, float]]) -> DataFrame:
    """``rows`` with z, the vector of z-scores by the population's deviation."""
    z = {f"_z_{c}": (F.col(c) - by[c][1]) / (by[c][2] or 1.0) for c in names}
    out = VectorAssembler(inputCols=list(z), outputCol="z").transform(rows.withColumns(z))
    return out.drop(*z)


def behaviour_groups(rows: DataFrame, names: list[str], k: int = 8, seeds: int = 10) -> DataFrame:
    """``rows`` with behavior_group from 1: the best of several k-means runs on z-scores."""
    kept = written(rows, "to_group")
    ready = standardized(kept, names, scales(kept, names))
    groups = min(k, kept.count())
    runs = [KMeans(k=groups, featuresCol="z", predictionCol="_g", seed=s).fit(ready) for s in range(seeds)]
    best = min(runs, key=lambda m: m.summary.trainingCost)
    return best.transform(ready).withColumn("behavior_group", F.col("_g") + 1).drop("_g", "z")


def calibrator(rows: DataFrame, names: list[str], label: str = "label", c: float = 10.0):
    """A logistic model whose penalty matches an inverse strength of ``c`` summed over rows."""
    ready = VectorAssembler(inputCols=names, outputCol="_x").transform(rows)
    return LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (c * max(1, rows.count())), standardization=False, probabilityCol="_p").fit(ready)


def probability(model, rows: DataFrame, names: list[str], column: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=names, outputCol="_x").transform(rows)
    return model.transform(ready).withColumn(column, vector_to_array("_p")[1]).drop("_x", "_p", "rawPrediction", "prediction")


def feedback_model(reviews: DataFrame, terms: list[str], least: int = 20, per_class: int = 5):
    """A logistic model on the terms and on whether each was present, and its Brier score on 30 % held out by class."""
    names = [*terms, *(f"has_{t}" for t in terms)]
    rows = reviews.withColumns({f"has_{t}": F.col(t).isNotNull().cast("double") for t in terms}).fillna(0.0, terms)
    counts = dict(rows.groupBy("label").count().collect())
    if sum(counts.values()) < least or min(counts.get(0, 0), counts.get(1, 0)) < per_class:
        raise ValueError("at least 20 labels, five of each class, are needed")
    held = F.pmod(F.xxhash64("address"), F.lit(10)) < 3
    model = calibrator(rows.filter(~held), names, c=FEEDBACK_STRENGTH)
    scored = probability(model, rows.filter(held), names, "p")
    return model, scored.agg(F.avg(F.pow(F.col("p") - F.col("label"), 2))).first()[0]


def neighbour_lists(members: DataFrame, associations: DataFrame, most: int = 16) -> DataFrame:
    """address, neighbours: other members of the entity and both ends of associations, the first ``most`` by name.

    Only the ``most`` + 1 first members of an entity are anyone's neighbours: they come to each member as one list, so an
    entity of any size gives as many rows as it has members. Associations are cut to the first ``most`` of each address
    before both lists are merged.
    """
    from pyspark.sql import Window

    def first(rows: DataFrame, key: str, value: str, n: int, name: str) -> DataFrame:
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value))).filter(F.col("_r") <= n)
        return ranked.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))

    heads = first(members.select("entity_id", F.col("address").alias("other")), "entity_id", "other", most + 1, "heads").filter(F.size("heads") > 1)
    own = members.join(heads, "entity_id").select("address", F.filter("heads", lambda o: o != F.col("address")).alias("own"))
    ends = associations.select(F.col("source").alias("address"), F.col("target").alias("other"))
    both = ends.unionByName(ends.select(F.col("other").alias("address"), F.col("address").alias("other"))).distinct()
    met = first(both, "address", "other", most, "met")
    none = F.array().cast("array<string>")
    merged = F.slice(F.array_sort(F.array_union(F.coalesce("own", none), F.coalesce("met", none))), 1, most)
    return own.join(met, "address", "full").select("address", merged.alias("neighbours"))


class GraphSage:
    """Two mean-aggregating layers: fitted on the driver over a bounded table of profiles, applied by two joins."""

    def __init__(self, names: list[str], hidden: int = 24, seed: int = 41):
        self.names, rng, d = names, np.random.default_rng(seed), len(names)
        self.w = [rng.normal(0, (1 / (2 * d)) ** 0.5, (2 * d, hidden)), rng.normal(0, (1 / (2 * hidden)) ** 0.5, (2 * hidden, hidden)), rng.normal(0, (1 / hidden) ** 0.5, (hidden, 1))]
        self.b = [np.zeros(hidden), np.zeros(hidden), np.zeros(1)]
        self.by: dict = {}

    def fit(self, x: np.ndarray, near: list[list[int]], y: np.ndarray, epochs: int = 100, rate: float = 0.008, decay: float = 0.01) -> GraphSage:
        """Full-batch Adam on weighted cross-entropy."""
        n = len(x)
        # links as two index lists: a row's mean over its neighbours, and what flows back
        to, of = np.repeat(np.arange(n), [len(ns) for ns in near]), np.array([j for ns in near for j in ns], int)
        share = 1 / np.array([len(ns) for ns in near for _ in ns], float)[:, None]

        def around(rows: np.ndarray, target: np.ndarray, source: np.ndarray) -> np.ndarray:
            out = np.zeros((n, rows.shape[1]))
            np.add.at(out, target, rows[source] * share)
            return out

        positive = max(1.0, (y == 0).sum() / max(1, (y == 1).sum()))
        params = [*self.w, *self.b]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, epochs + 1):
            a0 = np.hstack([x, around(x, to, of)])
            z1 = a0 @ self.w[0] + self.b[0]
            a1 = np.hstack([np.maximum(z1, 0), around(np.maximum(z1, 0), to, of)])
            z2 = a1 @ self.w[1] + self.b[1]
            h2 = np.maximum(z2, 0)
            p = 1 / (1 + np.exp(-(h2 @ self.w[2] + self.b[2])[:, 0]))
            d3 = ((p - y) * np.where(y == 1, positive, 1) / n)[:, None]
            d2 = (d3 @ self.w[2].T) * (z2 > 0)
            da1 = d2 @ self.w[1].T
            k = z1.shape[1]
            d1 = (da1[:, :k] + around(da1[:, k:], of, to)) * (z1 > 0)
            grads = [a0.T @ d1, a1.T @ d2, h2.T @ d3, d1.sum(0), d2.sum(0), d3.sum(0)]
            for i, (q, g) in enumerate(zip(params, grads, strict=True)):
                g = g + decay * q
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                q -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def predict(self, rows: DataFrame, near: DataFrame) -> DataFrame:
        """``rows`` (address, z array<double>) with graph_score. Each layer is a join with the neighbours and a mean, then a matrix product."""
        pairs = near.select("address", F.explode("neighbours").alias("other"))
        d, hidden, sc = len(self.names), self.w[0].shape[1], rows.sparkSession.sparkContext
        shared = sc.broadcast((self.w, self.b))

        def layer(level: int):
            @F.pandas_udf("array<double>")
            def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
                w, b = shared.value
                for own, around in batches:
                    x = np.hstack([np.array(own.tolist()), np.array(around.tolist())])
                    h = np.maximum(x @ w[level] + b[level], 0)
                    yield pd.Series((1 / (1 + np.exp(-(h @ w[2] + b[2]))) if level else h).tolist())

            return run

        def around(values: DataFrame, width: int) -> DataFrame:
            means = pairs.join(values.select(F.col("address").alias("other"), "x"), "other").groupBy("address").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("m"))
            zeros = F.array(*[F.lit(0.0)] * width)
            return values.join(means, "address", "left").withColumn("m", F.coalesce("m", zeros))

        first = around(rows.select("address", F.col("z").alias("x")), d).select("address", layer(0)("x", "m").alias("x"))
        second = around(first, hidden).select("address", layer(1)("x", "m")[0].alias("graph_score"))
        return rows.join(second, "address", "left")
