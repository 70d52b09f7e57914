"""Sharding by histogram sort: shards of near equal bytes, by DataFrame functions alone.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side and only a shard's edge can part
them. Rounds of exact histograms (``histogram.locate``) find the keys at which the bytes below come within a
tolerance of each multiple of the total; then one exchange deals the rows to runs of a bounded number of bytes,
many to a shard, and numbers them within. The exact row counts below each run's edge, known from the histograms,
turn these numbers into gapless slots of the shard, so that no task ever holds a whole shard. A text with very many
copies spans several runs, cut by doc_id.

Defined cases: a null text weighs 1 byte and all null texts lie together; a null doc_id sorts first; repeated rows
get different slots in any order (as do all rows with equal text and doc_id); a very long text weighs its bytes and is
never cut, so a shard may exceed its share by one; an empty table gives an empty result; a column of the input that is named like a
new one gives way to it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.histogram import HALF, locate, signed, totals
from trailweave.llm.shared import replace_columns, written

#: Bits of the candidate keys' digits, round by round: 65,536 candidates at first, 256 in each open interval later.
WIDTHS = [16] + [8] * 6 + [8] * 8


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _key(text: Column, doc_id: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.coalesce(doc_id.cast("long"), F.lit(-HALF).cast("long"))


def _runs_below(k1: Column, k2: Column, edges: list[int]) -> Column:
    """How many edges are at or below a key: first among every r-th edge, then among the r of that stretch."""
    if not edges:
        return F.lit(0)
    r = max(1, round(len(edges) ** 0.5))
    pairs = [dict(zip(("a", "b"), signed(e), strict=True)) for e in edges]
    kind = "array<struct<a:bigint,b:bigint>>"
    every, coarse = F.from_json(F.lit(json.dumps(pairs)), kind), F.from_json(F.lit(json.dumps(pairs[r - 1 :: r])), kind)
    below = lambda known: F.size(F.filter(known, lambda e: (e.a < k1) | ((e.a == k1) & (e.b <= k2))))
    first = below(coarse) * r
    return (first + below(F.slice(every, first + 1, r))).cast("int")


def shard_by_bytes(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.001, run_bytes: int = 64 << 20, least_runs: int = 16, most_runs: int = 2048) -> DataFrame:
    """``docs`` with size, law, shard and slot.

    A shard's edge lies within ``tolerance`` of a shard's bytes (or half a row) from where it should be. A shard has
    ``least_runs`` to ``most_runs`` runs of about ``run_bytes``; a run is what one task sorts, spilling if it must. The
    bound on runs bounds what the driver plans with; it changes how long a run is, never which rows a shard gets.
    """
    k1, k2 = _key(F.col(text), F.col(doc_id))
    narrow = written(docs.select(F.lit(0).alias("part"), k1.alias("k1"), k2.alias("k2"), byte_size(F.col(text)).alias("weight")), "shard_keys")
    total, _ = totals(narrow).get(0, (0, 0))
    runs = shards * min(most_runs, max(least_runs, -(-total // (shards * run_bytes))))
    a_shard = runs // shards
    wanted = [(total * i // runs, int(tolerance * total / shards) if i % a_shard == 0 else total // (4 * runs)) for i in range(1, runs)]
    edges, rows_below, high = [], [0], 0
    for f in locate(narrow, {0: wanted}, WIDTHS)[0] if total else []:
        if f.key < high:  # a looser edge beside a shard's
            f = last  # noqa: F821
        edges, rows_below, high, last = [*edges, f.key], [*rows_below, f.rows], f.key, f
    edges = [min(e, (1 << 128) - 1) for e in edges]
    start = [n - rows_below[i - i % a_shard] for i, n in enumerate(rows_below)]
    run = _runs_below(F.col("_tw_k1"), F.col("_tw_k2"), edges)
    dealt = docs.withColumns({"_tw_k1": k1, "_tw_k2": k2, "_tw_size": byte_size(F.col(text))}).withColumn("_tw_run", run)
    at = F.row_number().over(Window.partitionBy("_tw_run").orderBy("_tw_k1", "_tw_k2")) - 1
    numbered = dealt.withColumn("_tw_at", at)
    base = F.element_at(F.from_json(F.lit(json.dumps(start)), "array<bigint>"), F.col("_tw_run") + 1)
    out = replace_columns(numbered, size=F.col("_tw_size"), law=F.lit("bytes"), shard=F.floor(F.col("_tw_run") / a_shard).cast("int"), slot=(base + F.col("_tw_at")).cast("long"))
    return out.drop("_tw_k1", "_tw_k2", "_tw_run", "_tw_at", "_tw_size")
