"""Stateful streams against their batch forms, in one run and over a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trailweave.operators import taint
from trailweave.plans import audit
from trailweave.streaming import ledger, stateful, windows

DAY = datetime(2024, 5, 1)
PART = "array<struct<address:string,amount:bigint>>"


@pytest.fixture
def rocks(spark):
    with stateful.rocks(spark):
        yield spark


def streamed(spark, tmp_path, ddl, files, make, stops=()):
    """All rows that ``make`` of a stream gives; after the files at ``stops`` the query ends and is started again."""
    out, done = [], 0
    for stop in (*stops, len(files)):
        for i in range(done, stop):
            spark.createDataFrame(files[i], ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        done = stop
        stream = make(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def case(rng, n=40):
    names, txs = [f"w{i}" for i in range(8)], []
    for i in range(n):
        sides = [[(rng.choice(names), rng.randrange(0, 60)) for _ in range(rng.randrange(1, 4))] for _ in range(2)]
        txs.append((DAY + timedelta(minutes=rng.randrange(600)), f"t{i:03}", *sides))
    return txs


@pytest.mark.parametrize("stops", [(), (1, 2)])
def test_ledger(rocks, tmp_path, stops):
    spark, txs = rocks, case(random.Random(7))
    ordered = sorted(txs)
    files = [ordered[:15], ordered[18:30] + ordered[15:18], ordered[30:], [(DAY + timedelta(days=90), "end", [], [])]]
    ddl = f"timestamp timestamp, txid string, inputs {PART}, outputs {PART}"
    got = streamed(spark, tmp_path, ddl, files, lambda s: stateful.ledger_taint(s, ["w0", "w1"], 0.8, late="10 hours"), stops)
    flows = [(t, side, i, a, n) for _, t, *sides in txs for side, parts in zip(("input", "output"), sides, strict=True) for i, (a, n) in enumerate(parts)]
    want = taint.haircut(spark.createDataFrame(flows, "txid string, direction string, ordinal int, address string, amount_sats long"), spark.createDataFrame([(t, at) for at, t, *_ in txs], "txid string, first_seen timestamp"), ["w0", "w1"], 0.8).filter("hops > 0").collect()
    last = {}
    for r in sorted(got, key=lambda r: (r.at, r.txid, r.exposed)):
        last[r.address, r.seed] = (pytest.approx(r.exposed), r.hops)
    assert last == {(r.address, r.seed): (r.exposed, r.hops) for r in want} and last
    assert len(got) == len({(r.seed, r.txid, r.address, r.exposed) for r in got})


@pytest.mark.parametrize("stops", [(), (1,)])
def test_chain(rocks, tmp_path, stops):
    rows = [(DAY + timedelta(minutes=i), f"{i:03}", f"c{i % 2}", f"event {i}") for i in range(20)]
    files = [rows[:8], rows[10:] + rows[8:10], [(DAY + timedelta(days=9), "z", "c9", "end")]]
    got = streamed(rocks, tmp_path, "timestamp timestamp, id string, chain string, payload string", files, lambda s: stateful.chained(s, late="5 hours"), stops)
    for c in ("c0", "c1"):
        own = rocks.createDataFrame([r for r in rows if r[2] == c], "timestamp timestamp, id string, chain string, payload string")
        want = audit.extend(own, ["timestamp", "id"])
        assert sorted((r.seq, r.payload, r.prev_hash, r.hash) for r in got if r.chain == c) == sorted(tuple(r) for r in want.select("seq", "payload", "prev_hash", "hash").collect())


def test_peel_pointers_expire(rocks, tmp_path):
    minute = lambda m, t, to: (DAY + timedelta(minutes=m), t, "a", to)
    far = (DAY + timedelta(days=30), "end", "z", "y")
    files = [[minute(2, "t2", "c"), minute(1, "t1", "b")], [minute(3, "t3", "d"), minute(0, "t0", "x")], [far], [(DAY + timedelta(days=60), "t9", "a", "d"), (DAY + timedelta(days=90), "end", "z", "y")], [(DAY + timedelta(days=120), "end", "z", "y")]]
    got = streamed(rocks, tmp_path, "timestamp timestamp, txid string, address string, next string", files, lambda s: stateful.peel_pointers(s, late="1 hour", keep_days=5))
    # all in order; the pointer of t3 had gone when t9 came
    assert [(r.txid, r.next) for r in sorted(got, key=lambda r: r.at) if r.address == "a"] == [("t0", "x"), ("t1", "b"), ("t2", "c"), ("t3", "d"), ("t9", "d")]


def test_gaps_wait_for_the_watermark(spark, tmp_path):
    at = lambda *hours: [("k", DAY + timedelta(hours=h)) for h in hours]
    files = [at(0, 10), at(4, 30), at(1), [("z", DAY + timedelta(days=90))], [("z", DAY + timedelta(days=120))]]
    got = streamed(spark, tmp_path, "src_ip string, timestamp timestamp", files, lambda s: windows.running_gaps(s, "src_ip", most=3 * 3600, late="8 hours", keep="10 days"))
    # the event of hour 4 comes after that of hour 10 and is taken before it; that of hour 1 is behind the watermark and dropped
    assert sorted((r.timestamp, r.gap_seconds / 3600) for r in got if r.src_ip == "k") == [(DAY + timedelta(hours=h), g) for h, g in ((4, 4), (10, 6), (30, 20))]


@pytest.mark.parametrize("most", [1 << 19, 25])
def test_ledger_of_tables(spark, tmp_path, most):
    txs = sorted(case(random.Random(11), 60))
    files = [txs[:15], txs[18:30] + txs[15:18], txs[30:45], [(txs[0][0], "late", [("w2", 50)], [("w3", 50)]), *txs[45:]], [(DAY + timedelta(days=90), "end", [], [])]]
    ddl = f"timestamp timestamp, txid string, inputs {PART}, outputs {PART}"
    make = lambda: ledger.TaintLedger(spark, f"{tmp_path}/book", ["w0", "w1"], 0.8, "1 hour", most)
    for n, rows in enumerate(files):
        batch = spark.createDataFrame(rows, ddl)
        make().take(batch, n)
        if n == 2:
            make().take(batch, n)  # a batch that is run again, as after a failure
    flows = [(t, side, i, a, n) for _, t, *sides in txs for side, parts in zip(("input", "output"), sides, strict=True) for i, (a, n) in enumerate(parts)]
    want = taint.haircut(spark.createDataFrame(flows, "txid string, direction string, ordinal int, address string, amount_sats long"), spark.createDataFrame([(t, at) for at, t, *_ in txs], "txid string, first_seen timestamp"), ["w0", "w1"], 0.8).filter("hops > 0").collect()
    got = make().holdings()
    assert {(r.address, r.seed): (pytest.approx(r.exposed), r.hops, r.path) for r in got.collect()} == {(r.address, r.seed): (r.exposed, r.hops, r.path) for r in want} and want
    # what waits is in segments of the table, and several batches have released some
    assert len([v for v in (tmp_path / "book/balances").iterdir()]) >= 3


def test_peeling_spends_are_made_once(spark, monkeypatch):
    """The parts of the stream are read from a table of spends, not each made from all lines again."""
    from trailweave.plans import stream_queries

    seen = []
    monkeypatch.setattr(stream_queries, "_in_turns", lambda parts, make: seen.extend(parts) or spark.createDataFrame([], "address string, at long, txid string, next string"))
    stream_queries.stream_peel_pointers(spark, "/root/testdata/sf0.001")
    files = [f for p in seen[:2] for f in p.inputFiles()]
    assert files and not any("lineitem" in f for f in files)
    assert sum(p.count() for p in seen[:2]) > 0


def test_the_ledger_keeps_what_a_batch_may_need(spark, tmp_path):
    """A batch's movements go with it; segments and holdings that neither it nor the one before it needs go too."""
    txs = sorted(case(random.Random(5), 24))
    files = [txs[:8], txs[8:16], txs[16:], [(DAY + timedelta(days=90), "end", [], [])]]
    book = ledger.TaintLedger(spark, f"{tmp_path}/book", ["w0"], 0.8, "1 hour")
    needed = []
    for n, rows in enumerate(files):
        book.take(spark.createDataFrame(rows, f"timestamp timestamp, txid string, inputs {PART}, outputs {PART}"), n)
        needed.append(book._last())
    names = lambda part: {int(p.name) for p in (tmp_path / "book" / part).iterdir()}
    assert names("waiting") == {*needed[-2][1], *needed[-1][1]} and 0 not in names("waiting")
    assert names("holdings") == {needed[-2][2], needed[-1][2]}
    assert not names("moves")


def test_a_stream_of_taint_lies_there_once(spark, tmp_path, monkeypatch):
    """The transactions aren't written aside before they are streamed, and what the stream has taken waits in its ledger alone."""
    from trailweave.plans import stream_queries

    made = []
    monkeypatch.setattr(stream_queries, "shared_folder", lambda s, label: made.append(label) or str(tmp_path / label))
    monkeypatch.setattr(stream_queries, "written", lambda df, label: pytest.fail(f"{label} is written"))
    assert stream_queries.stream_taint(spark, "/root/testdata/sf0.001").count() > 0
    assert made == ["ledger"] and {p.name for p in (tmp_path / "ledger").iterdir() if not p.name.startswith(".")} == {"book", "state"}
