"""Sharding and mixing against plain Python on small tables with nulls, ties, repeated rows and clashing names."""

import random
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trailweave.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, size string, law string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "was", "was") for r in rows], DOCS)


MIXED = [(i, ["a", "", None, "ä b\tc", "x " * 40, "hot"][i % 6], ["s1", "s2", None][i % 3]) for i in range(300)] + [(5, "hot", "s1")] * 20 + [(None, "no id", "s2")] * 7 + [(900, "long " * 20_000, "s3")]


@pytest.mark.parametrize("rows", [MIXED, [], [(1, None, None)], [(7, "same", "s")] * 50])
def test_shards(spark, rows):
    out = sharding.shard_by_bytes(table(spark, rows), shards=4).collect()
    assert len(out) == len(rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in out:
        assert r.law == "bytes" and r["size"] == len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        total, most = sum(sizes.values()), max(len((t or "").encode()) + 1 for _, t, _ in rows)
        repeats = max(most, 50 * 5 if len({r for r in rows}) == 1 else most)
        assert all(abs(sizes[s] - total / 4) <= repeats + total * 0.001 for s in range(4))


def test_equal_texts_lie_together(spark):
    rows = [(i, f"text {i % 40} " * 3, "s") for i in range(400)]
    shards = defaultdict(set)
    for r in sharding.shard_by_bytes(table(spark, rows), shards=4).collect():
        shards[r.text].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 3


def test_word_counts(spark):
    texts = ["", None, " a  b\tc\nd\x0be\x0cf\rg ", "é ü x", "one"]
    got = [r[1] for r in sorted(spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", mixing.word_count(__import__("pyspark.sql.functions", fromlist=["col"]).col("t"))).collect())]
    assert got == [0, 0, 7, 2, 1]


def slow_fill(sizes, weights, most):
    """Capped water-filling in whole fractions."""
    left, out, free = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), list(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        for i in above or free:
            out[i] = Fraction(most * sizes[i]) if above else left * weights[i] / whole
        if not above:
            break
        left -= sum(out[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_water_fill(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 70, 1000, 10**6]) * rng.randrange(3) for _ in range([1, 3, 9, 40, 300, 2][seed])]
    frame = spark.createDataFrame([(f"s{i:04}", n, i) for i, n in enumerate(sizes)], "source string, size long, place long")
    got = {r.place: r.target for r in mixing.water_fill(frame, (1, 2, 3), 3).collect()}
    wanted = slow_fill(sizes, [1 + i % 3 for i in range(len(sizes))], 3)
    assert [got[i] for i in range(len(sizes))] == pytest.approx([float(t) for t in wanted], rel=1e-12)


def test_any_number_of_sources(spark):
    """Against plain Python: 700 sources, their numbers by code point, and every source's target met to the word."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(12), f"s{rng.randrange(700)}" if i % 50 else None) for i in range(6000)]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    got = {r.source: r.place for r in mixing.numbered_sources(table(spark, rows).select("source", F.length("text").alias("size"))).collect()}
    assert got == {s: i for i, s in enumerate(order)}
    wanted = dict(zip(order, slow_fill([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))], 3), strict=True))
    taken = defaultdict(int)
    for r in mixing.mix(table(spark, rows).repartition(7)).collect():
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(wanted[r.source]))
    assert all(taken[s] == int(t + Fraction(1, 2)) for s, t in wanted.items())


@pytest.mark.parametrize("rows", [MIXED, [], [(1, None, None)], [(7, "same words", "s")] * 9, [(i, "w " * (i % 5), f"s{i % 4}") for i in range(200)]])
def test_mix(spark, rows):
    out = mixing.mix(table(spark, rows)).collect()
    assert len(out) == len(rows)
    taken, target = defaultdict(int), {}
    for r in out:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    for source, t in target.items():
        assert abs(taken[source] - t) <= 30  # repeated rows share a boundary in whole words
    again = mixing.mix(table(spark, list(reversed(rows)))).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in out)


def test_repeats(spark):
    mixed = mixing.mix(table(spark, [(i, "a b c", "s1" if i % 9 else "s3") for i in range(90)]))
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    assert sum(copies.values()) == mixing.repeated(mixed).count()


def test_crc_is_of_utf8(spark):
    assert spark.range(1).select(F.crc32(F.lit("äß").cast("binary"))).first()[0] == zlib.crc32("äß".encode())
