"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are cut into ``slices``, each of which has its own list of partial scores. Phase 1 gathers
the heads of the local lists: of every partition the ``head`` rows of the largest norm, whose full scores give each
query a cutoff that k rows reach; it is safe whatever the rows are. Phase 2 broadcasts the cutoffs and collects
sufficient entries: a row can only reach a cutoff c if one of its m partial scores reaches c / m, so a partition sorts
its rows by their norm in each slice, multiplies a tile of rows with a tile of queries only where the product of their
norms allows for c / m, and keeps the entries that reach it. Phase 3 resolves the entries: the slices that phase 2 left
out are computed for these pairs alone, unless norms rule the pair out first. Each partition hands on its k best, of
which the k best of all are the result.

Queries are taken block by block: a block of at most about ``block_bytes`` of vectors is what is broadcast at once,
whatever the number of queries and their length; candidates are never moved. Scores are integers, exact in doubles
below 2^53 and in 64-bit arithmetic beyond.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor does a null vec_id;
vectors of unlike lengths have no score; empty vectors score 0; a repeated vec_id is one query (the least of its
vectors that take part) but as many candidates for others as it has rows; ties go to the smaller vec_id; components
that 64 bits can't hold and scores that 62 can't are an error; an empty table gives an empty result, and columns besides vec_id and
embedding are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.shared import shared_root

#: Queries and candidates in a tile of scores.
_TILE = 1024
_LEAST = np.iinfo(np.int64).min
_RESULT = "query_id long, rank int, vec_id long, score long"


def vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """vec_ids and integer vectors of a batch (vec_id, embedding), a pair for each length."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat, lengths = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(offsets)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = np.floor(scale * flat[offsets[at][:, None] + np.arange(n)])
        if rows.size and np.abs(rows).max() >= 2.0**63:
            raise ValueError("a component times the scale must fit 64 bits")
        yield ids[at], rows.astype(np.int64)


def usable(table: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)


def _cuts(length: int, slices: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, length, min(slices, max(1, length)) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _norms(rows: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """Upper bounds of the norms, slice by slice."""
    return np.stack([np.sqrt((rows[:, a:b].astype(np.float64) ** 2).sum(1)) for a, b in cuts]) * (1 + 1e-9)


def _kind(q: np.ndarray, c: np.ndarray) -> type:
    """A type of numbers in which the scores of q with c are exact."""
    size = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if size >= 2.0**62:
        raise ValueError("a score must fit 62 bits")
    return np.float64 if size < 2**53 else np.int64


class _Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids, self.have = k, np.full((n, k), _LEAST), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def take(self, row: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """Entries in any order, any number for a query."""
        touched = np.unique(row)
        if not len(touched):
            return
        r, p = np.nonzero(self.have[touched])
        row = np.concatenate([row, touched[r]])
        score, vec_id = np.concatenate([score, self.scores[touched][r, p]]), np.concatenate([vec_id, self.ids[touched][r, p]])
        order = np.lexsort((vec_id, -score, row))
        row, score, vec_id = row[order], score[order], vec_id[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.k
        row, place = row[first], place[first]
        self.have[touched] = False
        self.scores[row, place], self.ids[row, place], self.have[row, place] = score[first], vec_id[first], True

    def batch(self, queries: np.ndarray) -> pa.RecordBatch:
        i, p = np.nonzero(self.have)
        return pa.record_batch([pa.array(queries[i]), pa.array(self.ids[i, p]), pa.array(self.scores[i, p])], names=["query_id", "vec_id", "score"])


def gather_heads(held: dict, k: int, slices: int, scale: int, head: int):
    """Phase 1: each query's k best among the ``head`` rows of a partition with the largest norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, rows in vectors(batch, scale):
                n = rows.shape[1]
                if n in held.value:
                    if n in heads:
                        ids, rows = np.concatenate([heads[n][0], ids]), np.concatenate([heads[n][1], rows])
                    first = np.argsort(-_norms(rows, [(0, n)])[0], kind="stable")[:head]
                    heads[n] = ids[first], rows[first]
        for n, (ids, rows) in heads.items():
            q_ids, q = held.value[n]
            best = _Best(len(q_ids), k)
            for lo in range(0, len(q_ids), _TILE):
                mine = q[lo : lo + _TILE]
                kind = _kind(mine, rows)
                scores = (mine.astype(kind) @ rows.astype(kind).T).astype(np.int64)
                scores[q_ids[lo : lo + _TILE, None] == ids[None, :]] = _LEAST
                some = min(k, len(ids))
                near = np.argpartition(scores, -some, axis=1)[:, -some:]
                i, j = np.repeat(np.arange(len(mine)), some), near.ravel()
                own = q_ids[lo + i] != ids[j]
                best.take(lo + i[own], scores[i[own], j[own]], ids[j[own]])
            yield best.batch(q_ids)

    return run


def _collect(q: np.ndarray, c: np.ndarray, low: np.ndarray, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Phase 2: (slice, query, row, partial score) of the entries that reach the cutoff's share in a slice and in none before."""
    share = -(-low // len(cuts))  # partial * m >= cutoff, without overflow
    q_norms, c_norms = _norms(q, cuts), _norms(c, cuts)
    for s, (a, b) in enumerate(cuts):
        order = np.argsort(-c_norms[s], kind="stable")
        for at in range(0, len(order), _TILE):
            rows = order[at : at + _TILE]
            live = np.flatnonzero(q_norms[s] * c_norms[s][rows[0]] >= share)
            if not len(live):
                break  # the norms only fall from here on
            kind = _kind(q[live, a:b], c[rows, a:b])
            part = (q[live, a:b].astype(kind) @ c[rows, a:b].astype(kind).T).astype(np.int64)
            i, j = np.nonzero(part >= share[live, None])
            yield s, live[i], rows[j], part[i, j]


def _resolve(q: np.ndarray, c: np.ndarray, low: np.ndarray, cuts: list[tuple[int, int]], entries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phase 3: (query, row, score) of the entries that reach the cutoff, each pair once."""
    share, q_norms, c_norms = -(-low // len(cuts)), _norms(q, cuts), _norms(c, cuts)
    for s, i, j, score in entries:
        rest = sum((q_norms[o][i] * c_norms[o][j] for o in range(len(cuts)) if o != s), np.zeros(len(i)))
        may = score + rest >= low[i]
        i, j, score = i[may], j[may], score[may]
        for lo in range(0, len(i), 1 << 14):
            x, y, total = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)], score[lo : lo + (1 << 14)].copy()
            once = np.ones(len(x), bool)
            for o, (a, b) in enumerate(cuts):
                if o != s:
                    part = (q[x, a:b] * c[y, a:b]).sum(1)
                    total += part
                    if o < s:  # the pair came with that slice's entries
                        once &= part < share[x]
            good = once & (total >= low[x])
            yield x[good], y[good], total[good]


def collect_and_resolve(held: dict, cutoffs: dict, k: int, slices: int, scale: int):
    """Phases 2 and 3 over a partition, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _Best(len(ids), k) for n, (ids, _) in held.value.items()}
        for batch in batches:
            for ids, rows in vectors(batch, scale):
                n = rows.shape[1]
                if n not in best:
                    continue
                q_ids, q = held.value[n]
                low, cuts = cutoffs.value[n], _cuts(n, slices)
                _kind(q, rows)
                for lo in range(0, len(q_ids), _TILE):
                    part = slice(lo, lo + _TILE)
                    for i, j, score in _resolve(q[part], rows, low[part], cuts, _collect(q[part], rows, low[part], cuts)):
                        other = q_ids[lo + i] != ids[j]
                        best[n].take(lo + i[other], score[other], ids[j[other]])
        for n, b in best.items():
            yield b.batch(held.value[n][0])

    return run


def top_k(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256, slices: int = 2, block_bytes: int = 32 << 20, head: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    slim = usable(table)
    queries = slim.filter(F.col("vec_id") % every == 0)
    longs = queries.agg(F.sum(8 * F.size("embedding") + 8)).first()[0] or 0
    blocks = -(-longs // block_bytes)
    ranked = Window.partitionBy("query_id")
    kind, out = "query_id long, vec_id long, score long", f"{shared_root(spark)}/trailweave-{uuid.uuid4().hex}/top"
    for number in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        by_length: dict[int, list] = {}
        for batch in mine.toArrow().to_batches():
            for ids, rows in vectors(batch, scale):
                by_length.setdefault(rows.shape[1], []).append((ids, rows))
        held = {n: (np.concatenate([i for i, _ in v]), np.concatenate([r for _, r in v])) for n, v in by_length.items()}
        shared = spark.sparkContext.broadcast(held)
        heads = slim.mapInArrow(gather_heads(shared, k, slices, scale, head), kind)
        kth = heads.withColumn("n", F.row_number().over(ranked.orderBy(F.desc("score")))).filter(F.col("n") <= k).groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        low = {r[0]: r[1] for r in kth.select("query_id", "low").collect()}  # one row for each query of the block
        limits = spark.sparkContext.broadcast({n: np.array([low.get(int(i), -(1 << 62)) for i in ids], np.int64) for n, (ids, _) in held.items()})
        found = slim.mapInArrow(collect_and_resolve(shared, limits, k, slices, scale), kind)
        best = found.withColumn("rank", F.row_number().over(ranked.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        shared.unpersist()
        limits.unpersist()
    return spark.read.schema(_RESULT).parquet(out) if blocks else spark.createDataFrame([], _RESULT)
