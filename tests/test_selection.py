"""Exact medians against numpy, with groups on both sides of the bound."""

import numpy as np
import pytest

from trailweave.functions.selection import medians
from trailweave.models import learn


def columns(rng, n):
    wide = rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n)
    return np.stack([wide, rng.integers(-2, 3, n).astype(float), np.where(rng.random(n) < 0.3, -0.0, rng.normal(size=n)), np.where(rng.random(n) < 0.05, np.inf, -rng.random(n))], 1)


@pytest.mark.parametrize("most", [1 << 16, 30, 0])
def test_keys(spark, most):
    rng = np.random.default_rng(most)
    data = columns(rng, 901)
    keys = ["hot" if i % 3 else f"k{i % 7}" for i in range(len(data))]
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in zip(keys, data, strict=True)] + [("hot", None, None, None, None), ("none", None, None, None, None)], "k string, a double, b double, c double, d double").repartition(5)
    got = {r.k: (r.a, r.b, r.c, r.d) for r in medians(rows, list("abcd"), "k", most).collect()}
    assert got.pop("none", (None,) * 4) == (None,) * 4
    assert set(got) == set(keys)
    for k, values in got.items():
        want = np.median(data[[i for i, x in enumerate(keys) if x == k]], axis=0)
        assert np.array_equal(values, want), (k, values, want)


@pytest.mark.parametrize("n", [1, 2, 101])
def test_all_rows(spark, n):
    data = columns(np.random.default_rng(n), n)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, d double")
    assert np.array_equal(list(medians(rows, list("abcd"), most=1).first()), np.median(data, axis=0))
    assert learn.scales(rows, ["b", "c"])["c"][0] == np.median(data[:, 2])


def test_rows_are_made_once_and_rounds_leave_rows_behind(spark, monkeypatch):
    """What is read is a table, not the rows' own plan again, and later rounds have only what shares the bits found."""
    from trailweave.functions import selection

    kept, write = {}, selection.written
    monkeypatch.setattr(selection, "written", lambda df, label: kept.setdefault(label, write(df, label)))
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(0, 400, 1, 4).selectExpr("IF(id < 300, 'large', 'small') AS k", "CAST(id AS DOUBLE) AS v").mapInArrow(count, "k string, v double")
    assert sorted(map(tuple, medians(rows, ["v"], "k", most=200).collect())) == [("large", 149.5), ("small", 349.5)]
    assert made.value == 400
    sizes = [kept[f"shared_{i}"].count() for i in range(1, 5)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < 300 and sizes[-1] == 2
