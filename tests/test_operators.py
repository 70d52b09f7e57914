"""Exact cases of the engine's operators, and small graphs against plain Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.models import forest, learn
from trailweave.operators import context as cx
from trailweave.operators import drift, rules, taint
from trailweave.operators import features as ft
from trailweave.plans import audit, index, metrics
from trailweave.schema import FLOWS, TRANSACTIONS
from trailweave.session import written

T0 = 1_735_689_600


def case(spark, txs):
    """txs: txid -> (seconds, inputs, outputs), inputs and outputs lists of (address, sats)."""
    flows = [(t, side, i, a, v) for t, (_, ins, outs) in txs.items() for side, rows in (("input", ins), ("output", outs)) for i, (a, v) in enumerate(rows)]
    times = [(t, s, sum(v for _, v in ins) - sum(v for _, v in outs)) for t, (s, ins, outs) in txs.items()]
    transactions = spark.createDataFrame(times, "txid string, s long, fee_sats long").select("txid", F.timestamp_seconds(F.col("s") + T0).alias("first_seen"), "fee_sats", F.lit(200).alias("vsize"), F.lit(None).cast("string").alias("script_type"))
    assert transactions.columns == [c.split()[0] for c in TRANSACTIONS.split(", ")]
    return spark.createDataFrame(flows, FLOWS), transactions


def test_haircut(spark):
    btc = 100_000_000
    txs = {"t1": (0, [("seed", btc), ("clean", btc)], [("mid", int(1.999 * btc))]), "t2": (60, [("mid", int(1.999 * btc))], [("end", int(1.998 * btc))])}
    out = written(taint.haircut(*case(spark, txs), ["seed"], 0.9), "haircut")
    got = {r.address: r for r in out.collect()}
    assert got["mid"].fraction == pytest.approx(0.45, abs=1e-3) and got["end"].fraction == pytest.approx(0.405, abs=1e-3)
    assert got["end"].hops == 2 and got["end"].path == ["t1", "t2"]
    assert (got["seed"].fraction, got["seed"].hops) == (1.0, 0)
    whole = {r.address: r.taint for r in taint.taint_fraction(out).collect()}
    assert whole["seed"] == 1 and set(whole) == {"seed", "mid", "end"}
    assert taint.haircut(*case(spark, txs), ["nobody"], 0.9).count() == 0


@pytest.mark.parametrize("seed,most", [(0, 1 << 19), (1, 20), (2, 7)])
def test_haircut_against_a_ledger(spark, seed, most):
    """Layers of any size against one ledger kept transaction by transaction."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(9)]
    txs = {f"t{i:03}": (rng.randrange(30), [(rng.choice(names), rng.randrange(0, 60)) for _ in range(rng.randrange(1, 4))], [(rng.choice(names), rng.randrange(0, 50)) for _ in range(rng.randrange(1, 4))]) for i in range(26)}
    seeds, decay = ["w0", "w1"], 0.8
    purse, total_in, gained, ways = {}, {}, {}, {}
    for t in sorted(txs, key=lambda t: (txs[t][0], t)):
        _, ins, outs = txs[t]
        goes, by = dict.fromkeys(seeds, 0.0), {}
        for who, n in ins:
            size, parts = purse.setdefault(who, [0.0, dict.fromkeys(seeds, 0.0)])
            if who in seeds:
                goes[who] += n
                by[who] = []
            else:
                for s in seeds:
                    out = parts[s] * n / max(size, n, 1)
                    goes[s] += out
                    parts[s] -= out
                    if out > 0:
                        by[s] = ways[who, s]
            purse[who][0] = max(0, size - n)
        for who, n in outs:
            mine = purse.setdefault(who, [0.0, dict.fromkeys(seeds, 0.0)])
            mine[0] += n
            total_in[who] = total_in.get(who, 0) + n
            for s in seeds:
                gain = n * goes[s] / max(sum(v for _, v in ins), 1) * decay
                mine[1][s] += gain
                if who not in seeds and gain > 0:
                    gained[who, s] = gained.get((who, s), 0) + gain
                    if (who, s) not in ways or len(by[s]) + 1 < len(ways[who, s]):
                        ways[who, s] = [*by[s], t]
    got = {(r.address, r.seed): r for r in taint.haircut(*case(spark, txs), seeds, decay, most).collect() if r.address != r.seed}
    assert set(got) == set(gained)
    for key, r in got.items():
        assert r.exposed == pytest.approx(gained[key]) and r.received == total_in[key[0]]
        assert r.path == ways[key] and r.hops == len(ways[key])


def test_endpoints(spark):
    hops = {"t1": (0, [("a", 9)], [("b", 9)]), "t2": (1, [("b", 9)], [("end", 9)]), "t3": (2, [("x", 9)], [("end", 9)]), "t4": (3, [("y", 9)], [("end", 9)])}
    flows, _ = case(spark, hops)
    roots = spark.createDataFrame([("a",)], "address string")
    got = taint.endpoints(flows, roots).collect()
    assert [(r.endpoint, r.hops, r.kind, r.path) for r in got] == [("end", 2, "terminal", ["a", "b", "end"])] and got[0].score == pytest.approx(0.36)
    assert taint.endpoints(flows.filter("txid IN ('t1', 't2')"), roots).count() == 0
    known = taint.endpoints(flows, roots, spark.createDataFrame([("b",)], "address string")).collect()
    assert {(r.endpoint, r.kind) for r in known} == {("b", "known_exchange"), ("end", "terminal")}


def peel_case(n=6, step=15):
    left, txs = 100_000_000, {}
    for i in range(n):
        txs[f"p{i}"] = (i * step, [(f"w{i}", left)], [(f"small{i}", 1_000_000), (f"w{i + 1}", left - 1_001_000)])
        left -= 1_001_000
    return txs


def test_peel_rule_fires(spark):
    flows, transactions = case(spark, peel_case())
    peel = cx.peel_chains(cx.peel_links(flows, transactions))
    assert {r.txid for r in peel.collect()} == {f"p{i}" for i in range(6)}
    spent = ft.spends(flows, transactions)
    out = rules.apply_rules(ft.chain_features(spent), spent, peel, cx.reused(flows, transactions), cx.mixer_shapes(flows)).collect()
    assert all("Peeling-chain pattern" in {x["name"] for x in r.rules} and r.rule_score == 0.85 for r in out)
    backwards = {k: (-s, i, o) for k, (s, i, o) in peel_case().items()}
    assert cx.peel_chains(cx.peel_links(*case(spark, backwards))).count() == 0


def test_mixers_change_reuse_and_clusters(spark):
    txs = {
        "mix": (0, [("a", 50), ("b", 50)], [("m1", 30_000), ("m2", 30_000), ("m3", 30_100)]), "join": (1, [("c", 5), ("d", 5)], [("e", 9)]), "link": (2, [("d", 5), ("f", 5)], [("e", 9)]),
        "pay": (3, [("g", 9)], [("e", 4), ("new", 5)]), "two": (4, [("h", 9)], [("n1", 4), ("n2", 5)]),
    }
    flows, transactions = case(spark, txs)
    assert [r.txid for r in cx.mixer_shapes(flows).collect()] == ["mix"]
    assert [(r.txid, r.source, r.target) for r in cx.change_candidates(flows, transactions).collect()] == [("pay", "g", "new")]
    assert {r.txid for r in cx.reused(flows, transactions).collect()} == {"link", "pay"}
    roots = {r.address: r.root for r in cx.clusters(flows).collect()}
    assert {roots[x] for x in "cdf"} == {"c"} and roots["a"] == "a" and roots["b"] == "b" and roots["m1"] == "m1"
    assert {r.address: r.n_members for r in cx.entities(flows).collect()}["f"] == 3


@pytest.mark.parametrize("seed", range(3))
def test_components_and_distances(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in cx.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in range(100):
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    edges = spark.createDataFrame(pairs, "src long, dst long")
    hops = {r.address: r.hops for r in cx.seed_distances(edges, spark.createDataFrame([(100,), (pairs[0][0],)], "address long")).collect()}
    level, seen = {100, pairs[0][0]}, {100: 0, pairs[0][0]: 0}
    for n in range(1, 7):
        level = {b for a, b in pairs if a in level and b not in seen}
        seen |= dict.fromkeys(level, n)
    assert hops == seen


def test_changepoint(spark):
    rows = [(f"t{i:02}", i * 3600, [("w", 10**8 if i < 20 else 10**11)], [(f"o{i}", (10**8 if i < 20 else 10**11) - 1000)]) for i in range(40)]
    flows, transactions = case(spark, {t: tuple(r) for t, *r in rows})
    out = drift.behavioural_drift(ft.spends(flows, transactions)).collect()
    assert [r.status for r in out] == ["changed"] and abs(out[0].place - 20) <= 1 and out[0].score > 0.4
    short = drift.behavioural_drift(ft.spends(flows.filter("txid < 't04'"), transactions)).collect()
    assert [r.status for r in short] == ["insufficient_history"]


@pytest.mark.parametrize("seed", range(5))
def test_partition_is_optimal(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 1, (8, 2)) for m in rng.normal(0, 4, 3)])
    n, penalty = len(x), 6.0
    cost = lambda a, b: ((x[a:b] - x[a:b].mean(0)) ** 2).sum()
    best = [-penalty, *[np.inf] * n]
    for end in range(1, n + 1):
        best[end] = min((best[s] + cost(s, end) + penalty for s in range(end - 2) if best[s] < np.inf), default=np.inf)
    bounds = [0, *drift.changepoints(x, penalty), n]
    assert sum(cost(a, b) + penalty for a, b in zip(bounds, bounds[1:], strict=False)) - penalty == pytest.approx(best[n])


def test_flows_that_carry_nothing_are_left_out():
    """Of two chains of spends only that of the seed is walked; one longer than the steps has all flows looked at."""
    def flows(n):
        rows = [(at + k + (not side), at + k, side) for at in (0, 1000) for k in range(n) for side in (True, False)]
        return (np.array(c) for c in zip(*rows, strict=True))

    codes, txids, spends = flows(9)
    seeds = spends & (codes == 0)
    none = np.array([], int)
    assert np.array_equal(taint._carrying(codes, txids, spends, seeds, seeds, none), txids < 1000)
    assert np.array_equal(taint._carrying(codes, txids, spends, seeds, np.zeros(len(codes), bool), np.array([1004])), txids >= 1004)
    assert not taint._carrying(codes, txids, spends, seeds, np.zeros(len(codes), bool), none).any()
    codes, txids, spends = flows(taint.STEPS + 8)
    assert taint._carrying(codes, txids, spends, np.zeros(len(codes), bool), np.zeros(len(codes), bool), np.array([0])).all()


def test_a_layer_reads_the_folders_that_wait_for_it(spark, monkeypatch):
    txs = {f"t{i:02}": (i * 60, [(f"p{i}", 100)], [(f"p{i + 1}", 60), ("far", 40)]) for i in range(12)}
    read, waiting = [], taint._waiting
    monkeypatch.setattr(taint, "_waiting", lambda s, folder, places: read.append(len(places)) or waiting(s, folder, places))
    got = taint.haircut(*case(spark, txs), ["p0"], 1.0, 4).count()
    # "far" waits from each layer for the next: every layer but the first reads at most what two layers left, and the end what is left
    assert got == 14 and len(read) > 5 and max(read[:-1]) <= 2


@pytest.mark.parametrize("n", [8, 9, 23, 64])
def test_many_partitions_are_those_of_each(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(300, n, 4)) + np.where(np.arange(n)[None, :, None] < rng.integers(1, n, (300, 1, 1)), 0, rng.normal(0, 3, (300, 1, 4)))
    x[::3] = np.round(x[::3])  # ties
    for penalty in (1.0, 4 * np.log(n)):
        got = drift.many_changepoints(x, penalty)
        assert got == [drift.changepoints(s, penalty) for s in x] and len(set(map(tuple, got))) > 2


def test_drift_judges_many_addresses_in_one_call(spark, monkeypatch):
    """Addresses with few, some and many spends, over the borders of what is judged at once."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = []
    for i, n in enumerate([1, 7, 8, 8, 30, 64, 65, 200, 12, 8, 3, 90]):
        cut = int(rng.integers(2, n)) if n > 7 and i % 2 else n
        rows += [(f"w{i:02}", f"t{k:04}", 10**6 * int(3600 * k + rng.integers(0, 900)), float(10**8 if k < cut else 10**11), 2.0, None, 200.0) for k in range(n)]
    names = ["address", "txid", "at", "out_sats", "n_out", "fee_sats", "vsize"]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 4], strict=True)], names=names)
    whole = [r for b in drift._detect(iter(table.to_batches(max_chunksize=len(rows)))) for r in b.to_pylist()]
    monkeypatch.setattr(drift, "ROWS", 20)
    calls = []
    judged = drift._judged
    monkeypatch.setattr(drift, "_judged", lambda t, c: calls.append(len(c)) or judged(t, c))
    parts = [r for b in drift._detect(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()]
    order = lambda of: sorted(of, key=lambda r: (r["address"], r["place"] or 0))
    assert order(parts) == order(whole) and len(calls) > 3 and sum(calls) == len(rows)
    assert {r["address"] for r in whole} == {r[0] for r in rows}
    for i in (5, 7, 11):
        assert [r["status"] for r in whole if r["address"] == f"w{i:02}"][0] == "changed"
    assert {r["status"] for r in whole if r["address"] in ("w00", "w01", "w10")} == {"insufficient_history"}


def test_forest_identity(spark):
    rng = np.random.default_rng(0)
    rows = [(f"a{i}", *map(float, rng.normal(0, 1, 3))) for i in range(200)] + [("far", 9.0, 9.0, -9.0)]
    frame = spark.createDataFrame(rows, "address string, x double, y double, z double")
    grown = forest.fit(frame, ["x", "y", "z"], trees=40)
    data = np.array([r[1:] for r in rows])
    assert np.allclose(2 ** (-(grown.base() + grown.contributions(data).sum(1)) / forest.average_path(grown.sample)), grown.raw(data), atol=1e-5)
    scored = forest.score(frame, grown, "s", grown.raw(data))
    assert scored.orderBy(F.desc("s")).first().address == "far" and scored.agg(F.max("s_percentile")).first()[0] == 1
    with pytest.raises(ValueError):
        forest.fit(frame.limit(5), ["x", "y", "z"])


def test_graph_model_uses_neighbours(spark):
    rng = np.random.default_rng(1)
    n = 60
    y = (np.arange(n) % 2).astype(float)
    x = rng.normal(0, 1, (n, 2))
    near = [[j for j in range(n) if j != i and j % 2 == i % 2][:8] for i in range(n)]
    x[:, 0] += np.array([0.2 * v for v in y])
    model = learn.GraphSage(["x", "y"]).fit(x, near, y)
    frame = spark.createDataFrame([(f"a{i:02}", x[i].tolist()) for i in range(n)], "address string, z array<double>")
    lists = spark.createDataFrame([(f"a{i:02}", [f"a{j:02}" for j in near[i]]) for i in range(n)], "address string, neighbours array<string>")
    got = np.array([r.graph_score for r in model.predict(frame, lists).orderBy("address").collect()])
    assert got[y == 1].mean() > got[y == 0].mean() + 0.2


def test_index(spark):
    row = spark.createDataFrame([("a", 3, 0.5, 0.8, None, 0.3, None, 0.0, [("Address reuse", 0.3)], 6.0, 1.0), ("b", 3, None, 0.1, None, 0.0, 0.9, 9.0, [], 0.0, 0.0)], "address string, n long, taint double, fused_percentile double, graph_score double, rule_score double, drift_score double, log_median_gap_seconds double, rules array<struct<name:string,strength:double>>, relay_associations double, network_coverage double")
    out = {r.address: r for r in index.case_note(index.fracture_index(row)).collect()}
    assert out["a"].priority == pytest.approx(100 * (0.25 * 0.5 + 0.2 * 0.8 + 0.2 + 0.2 + 0.15)) and out["a"].priority_band == "High" and out["a"].component_coverage == pytest.approx(1)
    assert out["b"].priority == pytest.approx(100 * (0.2 * 0.9 + 0.2 * 0.9)) and out["b"].component_coverage == pytest.approx(0.6) and out["b"].priority_band == "Review"
    new = index.feedback_weights(index.WEIGHTS, {"taint": 1.0, "timing": None})
    assert sum(new.values()) == pytest.approx(1) and new["taint"] < 0.25
    with pytest.raises(ValueError):
        index.review("Escalated", "long enough", True)
    with pytest.raises(ValueError):
        index.check_config(index.WEIGHTS | {"taint": 0.5}, 0.9)


def test_audit(spark):
    chain = audit.extend(spark.createDataFrame([(i, f"e{i}") for i in range(30)], "i int, payload string"), ["i"]).cache()
    state = audit.verify(chain)
    assert state["valid"] and state["rows"] == 30 and not audit.verify(chain, "0" * 64)["valid"]
    assert audit.verify(chain.withColumn("payload", F.when(F.col("seq") == 9, "x").otherwise(F.col("payload"))))["first_break"] == 9
    assert audit.verify(chain.filter("seq <> 12"))["first_break"] == 13
    more = audit.extend(spark.createDataFrame([(1, "later")], "i int, payload string"), ["i"], seq=30, head=state["head"])
    assert audit.verify(chain.unionByName(more))["rows"] == 31


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (2, 0.9, 0), (3, 0.5, 1), (4, 0.1, 0)], "id long, score double, label int")
    got = metrics.detection(rows, 0.4, k=2).first()
    assert got.p_at_20 == 0.5 and got.precision == pytest.approx(2 / 3) and got.recall == 1 and got.average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    ranks = {r.id: r.percentile for r in metrics.percentile_ranks(rows.select("id", F.col("score").alias("v")), spark.createDataFrame([(0.5,), (0.9,), (0.2,), (0.2,)], "v double")).collect()}
    assert ranks == {1: 1.0, 2: 1.0, 3: 0.75, 4: 0.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_one_address_gets_what_the_whole_case_gives(spark, seed):
    from trailweave.plans import views

    rng = random.Random(seed)
    names = [f"w{i:02}" for i in range(30)]
    txs = {f"t{i:02}": (rng.randrange(5000), [(rng.choice(names), rng.randrange(1, 99)) for _ in range(rng.choice([1, 1, 2, 3]))], [(rng.choice(names), rng.randrange(1, 99)) for _ in range(rng.choice([1, 2, 2, 3]))]) for i in range(40)}
    flows, transactions = case(spark, txs)
    seen = spark.createDataFrame([(f"o{i}", rng.choice(list(txs)), 1_700_000_000 + rng.randrange(900), f"ip{rng.randrange(6)}") for i in range(90)], "id string, txid string, s long, src_ip string").selectExpr("id", "txid", "timestamp_seconds(s) AS timestamp", "src_ip")
    whole, pairs, changes = cx.entities(flows).collect(), cx.relay_associations(flows, seen, 120), cx.change_candidates(flows, transactions)
    for address in rng.sample(sorted({r.address for r in whole}), 3):
        own = next(r.entity_id for r in whole if r.address == address)
        assert sorted(cx.entity_of(flows, address).collect()) == sorted(r for r in whole if r.entity_id == own)
        touching = f"source = '{address}' OR target = '{address}'"
        assert sorted(map(str, cx.relay_associations(flows, cx.observed_around(flows, seen, address), 120).filter(touching).collect())) == sorted(map(str, pairs.filter(touching).collect()))
        assert sorted(map(str, cx.change_candidates(cx.around(flows, address), transactions).filter(touching).collect())) == sorted(map(str, changes.filter(touching).collect()))
    assert views.ego_context(flows, transactions, seen, "nobody").count() == 0


def test_profiles_make_edges_and_spends_once(spark, monkeypatch):
    """Degrees and distances come from one table of edges, and two kinds of features from one of spends."""
    flows, transactions = case(spark, {"t1": (0, [("a", 5)], [("b", 2), ("c", 3)]), "t2": (60, [("b", 2)], [("c", 1), ("a", 1)])})
    seen = spark.createDataFrame([("o", "t1", "ip")], "id string, txid string, src_ip string").withColumn("timestamp", F.timestamp_seconds(F.lit(T0)))
    made, plain = [], {n: getattr(m, n) for m, n in ((cx, "edges"), (ft, "spends"))}
    for module, name in ((cx, "edges"), (ft, "edges"), (ft, "spends")):
        monkeypatch.setattr(module, name, lambda *a, n=name: made.append(n) or plain[n](*a))
    out = ft.profiles(flows, transactions, seen, spark.createDataFrame([("a",)], "address string"))
    assert sorted(made) == ["edges", "spends"]
    assert sorted((r.address, r.out_degree, r.in_degree, r.seed_hop_distance) for r in out.collect()) == [("a", 2, 1, 0), ("b", 2, 1, 1)]
    ft.profiles(flows, transactions, seen, spent=written(ft.spends(flows, transactions), "own"))
    assert sorted(made) == ["edges", "edges", "spends", "spends"]  # the second one is the call above


def test_common_inputs_are_dealt_once(spark):
    """Links are those of transactions that are no mixers, whatever repeats or is null; inputs go by txid once and outputs once."""
    rng, rows = random.Random(15), []
    for t in range(120):
        few = [f"a{rng.randrange(12)}" for _ in range(rng.choice([1, 2, 2, 3, 5, 8]))]
        rows += [(f"t{t}" if t % 40 else None, "input", i, a if rng.random() > 0.05 else None, 5) for i, a in enumerate(few)]
        rows += [(f"t{t}" if t % 40 else None, "output", i, f"o{rng.randrange(9)}", rng.choice([7, 700, 70_000, 71_000])) for i in range(rng.randrange(6))]
    flows = written(spark.createDataFrame(rows, "txid string, direction string, ordinal int, address string, amount_sats long"), "linked")
    wanted = set()
    for t in {r[0] for r in rows} - {None}:
        ins, outs = {r[3] for r in rows if r[0] == t and r[1] == "input"}, sorted(r[4] for r in rows if r[0] == t and r[1] == "output")
        mixed = any(c - a <= max(1, a * 0.01) for a, c in zip(outs, outs[2:], strict=False))
        if 2 <= len(ins) <= 4 and not mixed:
            least = min(ins - {None})
            wanted |= {(least, b) for b in ins - {None, least}}
    links = cx.common_input_links(flows, 4)
    assert sorted(tuple(r) for r in links.collect()) == sorted(wanted)
    assert links._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("FileScan") == 2


def test_ego_context_reads_what_it_found(spark):
    """An address's surroundings are tables, so what follows doesn't read all flows again."""
    flows, transactions = case(spark, {"t1": (0, [("a", 5)], [("b", 2), ("c", 3)]), "t2": (60, [("b", 2)], [("c", 1), ("a", 1)]), "t3": (90, [("x", 2)], [("y", 1), ("z", 1)])})
    near = cx.around(flows.drop("ordinal"), "a")
    assert len(near.inputFiles()) > 0 and {r.txid for r in near.collect()} == {"t1", "t2"}


def test_numbered_lines_of_some_transactions(spark):
    from trailweave.plans.proxies import flows as lines

    folder = "/root/testdata/sf0.001"
    every = lines(spark, folder)
    some = every.filter("address = 'A7'").select("txid").distinct()
    assert sorted(lines(spark, folder, some).collect()) == sorted(every.join(some, "txid", "left_semi").select(every.columns).collect())


def test_haircut_leaves_no_steps_behind(spark, tmp_path, monkeypatch):
    """Flows, movements and walked layers go when the next step has them, and shuffle files with their query; what addresses hold stays."""
    made = []
    monkeypatch.setattr(taint, "shared_folder", lambda s, label: made.append(label) or str(tmp_path / label))
    shuffled = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    txs = {f"t{i:02}": (i * 60, [(f"p{i}", 100)], [(f"p{i + 1}", 60), ("far", 40)]) for i in range(12)}
    flows, times = (written(df, "case") for df in case(spark, txs))
    before, given = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    out = taint.haircut(flows, times, ["p0"], 1.0, 4)
    until = time.time() + 20
    while shuffled() > before and time.time() < until:  # they go a moment later
        time.sleep(0.2)
    assert shuffled() <= before
    left = {p.relative_to(tmp_path).parts[0] for p in tmp_path.rglob("*.parquet")}
    assert left == {"haircut"} and not list((tmp_path / "haircut/links").rglob("*.parquet"))
    assert {p.parent.name for p in (tmp_path / "haircut/holdings").rglob("*.parquet")} == {"due=-1"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == given and out.count() == 14
