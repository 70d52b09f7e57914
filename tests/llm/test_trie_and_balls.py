"""Clusters, the conversation trie and toxicity against brute force on small tables."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import balls, convtrie, toxicity

WIDTH = 64


def slow_clusters(rows, k=8, rounds=10):
    """Lloyd's algorithm in Python's whole numbers over (vec_id, vector) rows."""
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    z = [r[1] for r in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(z))[::-1]
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in rows:
            held[near(v)[0]].append(v)
        z = [[sum(c) // len(held[i]) for c in zip(*held[i], strict=True)] if i in held else z[i] for i in range(len(z))]
    out = [(r[0], *near(r[1])) for r in rows]
    inertia = [sum(d for _, c, d in out if c == i) for i in range(len(z))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in out), key=repr)


def clusters(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in balls.cluster_vectors(df).collect()), key=repr)


@pytest.mark.parametrize("n,parts,spread", [(0, 1, 1.0), (3, 2, 1.0), (90, 3, 0.01), (700, 2, 0.02), (400, 5, 30000.0)])
def test_clusters(spark, n, parts, spread):
    rng = random.Random(n)
    middles = [[rng.uniform(-1, 1) for _ in range(WIDTH)] for _ in range(5)]
    rows = [(i if i % 50 else None, [m + rng.gauss(0, spread) for m in middles[i % 5 if i % 3 else 0]]) for i in range(n)]
    rows += rows[: n // 3]  # repeated rows
    df = spark.createDataFrame([(*r, "extra") for r in rows] + [(7001, None, ""), (7002, [1.0] * 63, ""), (7003, [1.0] * 63 + [None], ""), (7004, [float("nan")] * WIDTH, ""), (7005, [float("inf")] * WIDTH, "")], "vec_id long, embedding array<double>, cluster string").repartition(parts)
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    small = [r for r in whole if max(map(abs, r[1])) < balls.MOST]
    want = slow_clusters(small) + [(i, None, None, None, None, None) for i, v in whole if max(map(abs, v)) >= balls.MOST]
    assert clusters(df) == sorted(want, key=repr)


def test_wide_vectors_stay_apart(spark):
    rows = [(i, [float(i % 3 + j) for j in range(WIDTH)]) for i in range(30)] + [(99, [1e300] * WIDTH)]
    out = clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out == sorted([*slow_clusters([(i, [int(1024 * x) for x in v]) for i, v in rows[:-1]]), (99, *[None] * 5)], key=repr)


@pytest.mark.parametrize("n", [1, 16, 17, 300, 512])
def test_balls_hold_what_they_say(n):
    rng = np.random.default_rng(n)
    rows = rng.integers(-3000, 3000, (n, 8))
    order, radius, count, total = balls.plant(rows)
    assert sorted(order) == list(range(n))
    rows, first = rows[order], 0
    for level in range(balls._levels(n) + 1):
        at = balls._bounds(n, level)
        for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
            part = rows[lo:hi]
            assert count[first + i] == len(part) and (total[first + i] == part.sum(0)).all()
            assert radius[first + i] >= np.sqrt(((part - part.sum(0) // len(part)) ** 2).sum(1)).max() - 1e-9
        first += 1 << level
    z = rng.integers(-3000, 3000, (6, 8))
    owner, taken = balls.descend(radius, count, total, z, n)
    exact = balls.distances(rows, z).argmin(1)
    spread = np.repeat(owner, np.diff(balls._bounds(n, balls._levels(n))))
    assert ((spread < 0) | (spread == exact)).all()
    assert sum(count[t] for t in taken) == (spread >= 0).sum()


def test_far_balls_are_taken_whole():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-5, 5, (200, 8)) + 10_000 * i for i in range(2)])
    _, radius, count, total = balls.plant(rows)
    owner, taken = balls.descend(radius, count, total, np.array([[0] * 8, [10_000] * 8]), len(rows))
    assert (owner >= 0).all() and len(taken) == 2


def slow_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    whole, members, below = {}, defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h, head = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100 * (1 if c >= 0 else -1))
        whole[c] = tuple(own.get(head, [])[:h] + v[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    out = []

    def visit(p):
        under = [visit(q) for q in below[p]]
        leaves, saved = sum(u[0] for u in under) or 1, sum(u[1] for u in under) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        visit(())
    return sorted(out, key=repr)


def trie(df):
    return sorted((tuple(r[f.split()[0]] for f in convtrie._NODE_DDL.split(", ")) for r in convtrie.trie(df).collect()), key=repr)


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 1), (3, 2), (4, 3), (5, 7), (6, 2)])
def test_trie(spark, monkeypatch, seed, block):
    rng = random.Random(seed)
    monkeypatch.setattr(convtrie, "_BLOCK", block)
    monkeypatch.setattr(convtrie, "_IDS", 100)
    rows = [(rng.choice([rng.randrange(40), rng.randrange(0, 1000, 100), rng.randrange(-300, 300), None]), rng.choice([None, *range(7)]), rng.choice(["user", "assistant", None]), rng.choice(["", "x", "yé", None, "z" * 3000])) for _ in range(100 * seed)]
    if seed > 2:  # one hot turn, so that nodes run through many blocks
        rows = [(c, t, "user", "x" if rng.random() < 0.8 else x) for c, t, _, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(seed % 2 == 0).lower())
        assert trie(df.repartition(3)) == slow_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_trie_of_copies_and_of_nothing(spark):
    copies = [(100 + i, t, "user", f"same {t}") for i in range(40) for t in range(3)]
    ddl = "conv_id long, turn long, role string, text string"
    assert trie(spark.createDataFrame(copies, ddl)) == slow_trie(copies)
    assert trie(spark.createDataFrame([], ddl)) == []
    assert trie(spark.createDataFrame([(None, 1, "user", "x")], ddl)) == []
    sys.setrecursionlimit(5000)
    long = [(c, t, "user", f"{t}" if c else f"{t}{c * (t > 700)}") for c in (0, 100, 200) for t in range(800)]
    assert trie(spark.createDataFrame(long, ddl)) == slow_trie(long)


def test_nearest_smaller():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 60):
        v = rng.integers(0, 5, n)
        left, right = convtrie.nearest_smaller(v)
        for i in range(n):
            assert left[i] == max([j for j in range(i) if v[j] < v[i]], default=-1)
            assert right[i] == min([j for j in range(i + 1, n) if v[j] < v[i]], default=n)


CLEAN = [a + b + c for a in ("river", "morn", "clou", "gard", "peop", "lett", "wind") for b in ("a", "ing", "er", "on", "el", "us") for c in ("", "s", "ed", "ward")]


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["moronic", "scumbag"]
    rows = [(i, " ".join(rng.choice(CLEAN) for _ in range(rng.randrange(5, 200))) + (" " + rng.choice(bad) + "ly" * (i % 2) if i % 4 == 0 else "")) for i in range(600)]
    odd = [(9001, ""), (9002, None), (9003, "12 !"), (None, "no id"), (9004, "river " * 60_000), (9004, "river " * 60_000), (9005, "q" * 300_000), (9006, "river " * 60_000 + "Moronic!")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", F.lit("was"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(5, None), (6, 7), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    out = toxicity.score(docs, machine).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all((r.predicted == 1) == (r.doc_id % 4 == 0) for r in out if r.doc_id is not None and r.doc_id < 600)
    by = {r.doc_id: r for r in out}
    assert by[9001].score == by[9002].score == by[9003].score == machine.share and not by[9004].predicted and by[9006].predicted
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} <= {0.0, machine.share, toxicity.fit(docs, labels.limit(0)).scores([np.array([1], np.int32)])[0]}
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_pairs_that_sums_miss():
    """Two words are harmless alone and with others, and toxic together: no sum of weights can tell."""
    rng = np.random.default_rng(0)
    a, b, c, d, rest = 1, 2, 3, 4, np.arange(10, 200)
    bags, label = [], []
    for i in range(4000):
        kind = i % 8
        pair = {0: (a, b), 1: (c, d), 2: (a, d), 3: (c, b)}.get(kind, ())
        bags.append(np.unique(np.concatenate([np.array(pair, int), rng.choice(rest, 10)])).astype(np.int32))
        label.append(float(kind in (0, 1)))
    machine = toxicity.train(bags, np.array(label), passes=30)
    got = machine.scores([np.array(p, np.int32) for p in ((a, b), (c, d), (a, d), (b, c))])
    assert (got[:2] > 0.7).all() and (got[2:] < 0.3).all()
    pairs = sum(machine.factors[i] @ machine.factors[j] for i in range(len(machine.columns)) for j in range(i))
    assert np.isclose(machine.logits([machine.columns])[0], machine.bias + machine.weights.sum() + pairs)


def test_held_out_rows_teach_nothing(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(CLEAN) + (" vile" if i % 2 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    right = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    turned = right.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = toxicity.fit(docs, right), toxicity.fit(docs, turned)
    assert one.bias == other.bias and (one.weights == other.weights).all() and (one.factors == other.factors).all()
