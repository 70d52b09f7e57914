"""Every query with SQL gives the SQL's rows on the smallest tables; every other one runs."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="needs the test tables")
CORE = sorted(entry._core()[0])


def rows(columns, table):
    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    return sorted((tuple(plain(r[c]) for c in columns) for r in table), key=repr)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, str(DIR))
    columns = sorted(got.columns)
    found = rows(columns, [r.asDict() for r in got.collect()])
    if name in entry.oracle_sql():
        want = sql.execute(entry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert found == rows(columns, [dict(zip(names, r, strict=True)) for r in want.fetchall()])
    else:
        assert len(columns) == len(set(columns))


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "rule_score" in out.columns


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_groups_are_numbered_from_one(spark):
    out = entry.queries()["behaviour_groups"](spark, str(DIR))
    assert out.agg({"behavior_group": "min"}).first()[0] == 1 and out.select("behavior_group").distinct().count() <= 8


def test_percentiles_are_among_all_rows(spark):
    from bisect import bisect_right

    from trailweave.plans.more_queries import with_percentiles

    scores = [i * i % 4999 / 4999 for i in range(5000)]
    ranked = sorted(scores)
    out = with_percentiles(spark.createDataFrame(list(enumerate(scores)), "address long, fused double"), "fused").collect()
    assert {r.address: r.fused_percentile for r in out} == {i: bisect_right(ranked, v) / 5000 for i, v in enumerate(scores)}


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    from trailweave import session
    from trailweave.plans.proxies import flows

    key, given = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(session, "PARTITION_BYTES", 4096, raising=False)
    try:
        flows(spark, str(DIR))
        assert int(spark.conf.get(key)) > 4
        raised = spark.conf.get(key)
        with session.as_given(spark):
            assert spark.conf.get(key) == given
        assert spark.conf.get(key) == raised
    finally:
        spark.conf.set(key, given)
        spark.conf.unset("trailweave.shuffle.partitions")


def test_partitions_stay_apart_once_raised(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from trailweave import session

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "trailweave.shuffle.partitions")
    had = {n: spark.conf.get(n, None) for n in names}
    monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 20)
    path = str(tmp_path / "wide")
    spark.range(1_500_000, numPartitions=4).select(F.xxhash64("id").alias("k")).write.parquet(path)
    try:
        for n in names[1:]:
            spark.conf.unset(n)
        tasks = spark.read.parquet(session.spread(spark, path)).repartition("k").rdd.getNumPartitions()
        assert tasks >= 10  # about 12 MB; the cores alone would make it four
        spark.conf.set(names[0], "4")
        spark.conf.set(names[1], "32m")
        session.spread(spark, path)
        assert spark.conf.get(names[1]) == "32m"
    finally:
        for n, v in had.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
