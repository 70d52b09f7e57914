"""Tables kept up to date by imports against the same tables computed from everything."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailweave.operators import context as cx
from trailweave.operators import features as ft
from trailweave.plans.maintain import Maintained

TX = "txid string, first_seen timestamp, fee_sats long, vsize int, script_type string"
FLOW = "txid string, direction string, ordinal int, address string, amount_sats long"
OBS = "txid string, timestamp timestamp"


def made(rng, n):
    day = datetime(2024, 1, 1)
    txs, flows = [], []
    for i in range(n):
        txs.append((f"t{i:03}", day + timedelta(minutes=rng.randrange(5000)), 100, 200, None))
        for side, most in (("input", 3), ("output", 3)):
            flows += [(f"t{i:03}", side, j, f"w{rng.randrange(60):02}", rng.randrange(1, 10**8)) for j in range(rng.randrange(0 if side == "output" else 1, most))]
    return txs, flows


@pytest.mark.parametrize("seed", [1, 2])
def test_imports_equal_a_full_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    txs, flows = made(rng, 90)
    store, told = Maintained(spark, str(tmp_path / "case"), 8), {t[0]: t[1] for t in txs}
    for part in range(3):
        own = [t for i, t in enumerate(txs) if i % 3 == part]
        names = {t[0] for t in own}
        known = [t[0] for i, t in enumerate(txs) if i % 3 < part]
        late = [(t, told[t] + timedelta(minutes=rng.choice([-900, -1, 30]))) for t in rng.sample(known, min(5, len(known)))]
        for t, at in late:
            told[t] = min(told[t], at)
        report = store.apply(spark.createDataFrame(own, TX), spark.createDataFrame([f for f in flows if f[0] in names], FLOW), spark.createDataFrame(late + late, OBS))
        assert all(0 < r.rewritten <= r.buckets == 8 for r in report.collect())
        have = [(t[0], told[t[0]], *t[2:]) for i, t in enumerate(txs) if i % 3 <= part]
        all_f = spark.createDataFrame([f for f in flows if f[0] in {t[0] for t in have}], FLOW)
        want = ft.history_features(ft.spends(all_f, spark.createDataFrame(have, TX)))
        got = store.profiles()
        assert sorted(got.columns) == sorted(want.columns)
        rounded = lambda df: sorted((r.address, *(round(r[c], 9) for c in sorted(want.columns) if c != "address")) for r in df.collect())
        assert rounded(got) == rounded(want)
        assert sorted(store.entities().collect()) == sorted(cx.clusters(all_f).select("address", "root").collect())


def test_small_imports_touch_few_buckets(spark, tmp_path):
    txs, flows = made(random.Random(3), 80)
    store = Maintained(spark, str(tmp_path / "case"), 32)
    store.apply(spark.createDataFrame(txs, TX), spark.createDataFrame(flows, FLOW), spark.createDataFrame([], OBS))
    before = store.manifest()
    late = spark.createDataFrame([("t005", txs[5][1] - timedelta(days=1))], OBS)
    report = {r.table: r for r in store.apply(spark.createDataFrame([], TX), spark.createDataFrame([], FLOW), late).collect()}
    inputs = {f[3] for f in flows if f[0] == "t005" and f[1] == "input"}
    assert report["by_tx"].rewritten == 1 and report["profiles"].rewritten <= len(inputs) == report["profiles"].keys
    after = store.manifest()
    assert sum(before["profiles"].get(b) != v for b, v in after["profiles"].items()) == report["profiles"].rewritten
    assert after["clusters"] == before["clusters"]
    higher = spark.createDataFrame([("t005", txs[5][1] + timedelta(days=1)), ("nobody", txs[5][1])], OBS)
    assert {r.rewritten for r in store.apply(spark.createDataFrame([], TX), spark.createDataFrame([], FLOW), higher).collect()} == {0}


def test_failed_import_changes_nothing(spark, tmp_path):
    txs, flows = made(random.Random(4), 20)
    store = Maintained(spark, str(tmp_path / "case"), 4)
    store.apply(spark.createDataFrame(txs[:10], TX), spark.createDataFrame([f for f in flows if f[0] < "t010"], FLOW), spark.createDataFrame([], OBS))
    before, rows = store.manifest(), sorted(store.profiles().collect())
    more = spark.createDataFrame(txs[10:], TX), spark.createDataFrame([f for f in flows if f[0] >= "t010"], FLOW), spark.createDataFrame([], OBS)
    with pytest.raises(Exception, match="broken"):
        store.apply(*more, features=lambda rows: ft.history_features(rows).withColumn("n", F.raise_error(F.lit("broken")).cast("long")))
    assert store.manifest() == before and sorted(store.profiles().collect()) == rows
    store.apply(*more)
    assert store.profiles().count() == len({f[3] for f in flows if f[1] == "input"})


def test_a_first_import_writes_no_copies(spark, tmp_path, monkeypatch):
    """With nothing to merge with, rows and profiles go straight into their tables; later imports do merge."""
    from trailweave.plans import maintain

    labels, write = [], maintain.written
    monkeypatch.setattr(maintain, "written", lambda df, label: labels.append(label) or write(df, label))
    txs, flows = made(random.Random(6), 24)
    store = Maintained(spark, str(tmp_path / "case"), 4)
    store.apply(spark.createDataFrame(txs[:12], TX), spark.createDataFrame([f for f in flows if f[0] < "t012"], FLOW), spark.createDataFrame([], OBS))
    assert labels.count("touched_rows") == 1 and not {"merged_rows", "new_profiles"} & set(labels)
    store.apply(spark.createDataFrame(txs[12:], TX), spark.createDataFrame([f for f in flows if f[0] >= "t012"], FLOW), spark.createDataFrame([], OBS))
    assert {"merged_rows", "new_profiles"} <= set(labels) and store.profiles().count() == len({f[3] for f in flows if f[1] == "input"})
