"""Shapley values against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.models import forest, shap


def mean_given(tree, x, known, at=0):
    f = tree.feature[at]
    if f < 0:
        return tree.value[at]
    left, right = tree.left[at], tree.right[at]
    if f in known:
        return mean_given(tree, x, known, left if x[f] <= tree.cut[at] else right)
    return sum(tree.size[c] / tree.size[at] * mean_given(tree, x, known, c) for c in (left, right))


def slow_shapley(tree, x, n):
    out = np.zeros(n)
    for f in range(n):
        others = [g for g in range(n) if g != f]
        for k in range(n):
            for s in combinations(others, k):
                out[f] += factorial(k) * factorial(n - k - 1) / factorial(n) * (mean_given(tree, x, {*s, f}) - mean_given(tree, x, set(s)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_all_subsets(seed):
    rng = np.random.default_rng(seed)
    rows = np.round(rng.normal(size=(60, 5)), 1 if seed % 2 else 6)  # ties at the cuts
    trees = [forest.grow(rows[rng.choice(60, 40, replace=False)], rng) for _ in range(2)]
    some = np.concatenate([rows[:10], rng.normal(size=(5, 5)) * 3])
    got = shap.shapley([shap.paths(t) for t in trees], some, 5)
    want = np.array([(slow_shapley(trees[0], x, 5) + slow_shapley(trees[1], x, 5)) / 2 for x in some])
    assert np.abs(got - want).max() < 1e-9
    fitted = forest.Forest(list("abcde"), trees, 40)
    assert np.allclose(fitted.base() + got.sum(1), fitted.path_lengths(some), atol=1e-9)
    assert np.isclose(shap.base(fitted.leaves()), fitted.base())


def test_order_of_splits_does_not_matter():
    """Two trees that say the same by splits in another order get the same values, which steps along a way don't."""
    leaf = lambda v, n: (-1, 0.0, 0, 0, n, v)
    tree = lambda f, g, values: forest.Tree(*(np.array(c) for c in zip((f, 0.5, 1, 2, 8, sum(values) / 4), (g, 0.5, 3, 4, 4, 0), (g, 0.5, 5, 6, 4, 0), *[leaf(v, 2) for v in values], strict=True)))
    one, other = tree(0, 1, [0.0, 0.0, 0.0, 4.0]), tree(1, 0, [0.0, 0.0, 0.0, 4.0])
    x = np.array([[1.0, 1.0], [0.0, 1.0]])
    assert np.allclose(shap.shapley([shap.paths(one)], x, 2), shap.shapley([shap.paths(other)], x, 2))
    assert np.allclose(shap.shapley([shap.paths(one)], x[:1], 2), [[1.5, 1.5]])


def test_a_forest_on_spark(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 3))
    frame = spark.createDataFrame([(f"a{i:03d}", *map(float, r)) for i, r in enumerate(data)], "address string, x double, y double, z double")
    fitted = forest.fit(frame, ["x", "y", "z"], trees=20)
    out = shap.explained(frame.repartition(3), fitted.trees, ["x", "y", "z"]).orderBy("address").select("shapley").toPandas()
    got = np.array(out.shapley.tolist())
    assert np.allclose(fitted.base() + got.sum(1), fitted.path_lengths(data), atol=1e-9)
    assert shap.explained(frame.limit(0), fitted.trees, ["x", "y", "z"]).count() == 0
    assert shap.explained(frame, [], ["x", "y", "z"]).select(F.array_max("shapley").alias("m")).distinct().collect()[0].m == 0


def test_neighbours_of_a_large_entity_are_lists(spark):
    """An entity's members aren't multiplied by its first members: a row for each member on the way."""
    from trailweave.models import learn

    n = 3000
    members = spark.range(n).select(F.format_string("a%05d", "id").alias("address"), F.lit("e").alias("entity_id"))
    ends = spark.createDataFrame([("a00000", f"0{i:02}") for i in range(20)] + [("a02999", "zz"), ("lone", "a00001")], "source string, target string")
    out = learn.neighbour_lists(members, ends)
    got = {r.address: r.neighbours for r in out.collect()}
    heads = [f"a{i:05}" for i in range(17)]
    assert got["a02999"] == heads[:16] and got["a00003"] == [h for h in heads if h != "a00003"] and got["lone"] == ["a00001"] and got["001"] == ["a00000"]
    assert got["a00000"] == [f"0{i:02}" for i in range(16)] and len(got) == n + 22

    def rows(node):
        below = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        children = node.children()
        kids = [below] if below is not None else [children.apply(i) for i in range(children.size())]
        own = node.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(rows, kids)])

    plan = out._jdf.queryExecution().executedPlan()
    out._jdf.collectToPython()  # runs this very plan
    assert rows(plan) <= n + 100
