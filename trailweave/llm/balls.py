"""Exact Lloyd clustering of whole-number vectors by ball-tree filtering.

The kept vectors (``width`` components, none null or non-finite) become whole numbers, ``floor(scale * x)``, once. Each
task then builds metric trees over its own rows: rows are halved at the median of the component that spreads most, down
to trees of at most ``_TREE`` vectors, which are rows of a written table. A tree's nodes store radius, count and
componentwise sum in whole numbers. A round walks the trees with the broadcast centroids, level by level: where the
triangle inequality shows that a whole ball is nearest to one centroid, its count and sum are taken as they are, and
only balls that stay open at the last level are told apart vector by vector, with exact whole-number distances. Each
round moves a count and a sum for each centroid and task; the sums are added up by Spark as decimals.

Radii and distances in the test of a ball are doubles with a margin for their rounding, so a ball is only taken whole
where that is certain; what is assigned doesn't depend on how rows are spread over tasks.

Defined cases: other vectors take no part and give no row. A vector with a component whose whole number is beyond
2^26 has squared distances that a long can't hold: it is returned with null cluster and distance, and no other row is
touched by it. A null vec_id takes part but comes last when starts are drawn; repeated vec_ids are drawn as often
as they stand there, ties settled by the vector. With fewer than ``k`` vectors there are as many centroids as vectors.
A centroid that loses all its vectors stays where it was. An inertia beyond a long is null. Extra columns, and columns
named like new ones, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.shared import written

#: Vectors that a task halves at once, in one tree, and in a ball of the last level; the largest component.
_GATHER, _TREE, _LEAF, MOST = 8192, 512, 16, 1 << 26


def whole_vectors(table: DataFrame, width: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, v (array<long>, null where a component is beyond ``MOST``) of the vectors that take part."""
    x = F.col("embedding")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    kept = table.filter((F.size(x) == width) & F.forall(x, finite)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("x"))
    small = F.forall("x", lambda e: F.abs(e * scale) < MOST)
    return kept.select("vec_id", F.when(small, F.transform("x", lambda e: F.floor(e * scale))).alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors whose hash of seed and vec_id comes first."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.v) for r in vectors.filter("v IS NOT NULL").select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the balls of a level begin and end in a tree of n vectors."""
    return (np.arange((1 << level) + 1) * n) >> level


def _levels(n: int) -> int:
    """The last level: its balls hold ``_LEAF`` vectors at most."""
    return max(0, int(np.ceil(np.log2(max(1, n) / _LEAF))))


def _halved(rows: np.ndarray, order: np.ndarray, lo: int, hi: int, level: int) -> None:
    """Orders rows lo to hi so that every halving down to ``level`` parts them at a median."""
    if level == 0:
        return
    part = rows[order[lo:hi]]
    widest = int((part.max(0) - part.min(0)).argmax())
    mid = (hi - lo) >> 1
    order[lo:hi] = order[lo:hi][np.argpartition(part[:, widest], mid)] if hi - lo > 1 else order[lo:hi]
    _halved(rows, order, lo, lo + mid, level - 1)
    _halved(rows, order, lo + mid, hi, level - 1)


def plant(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of a tree's vectors, and radius, count and sum of its nodes, level by level from the root."""
    n, depth = len(rows), _levels(len(rows))
    order = np.arange(n)

    def cut(lo: int, hi: int, level: int) -> None:  # the borders are those of ``_bounds``
        if level == depth:
            return
        at = _bounds(n, level + 1)
        mid = int(at[np.searchsorted(at, lo, side="right")]) if hi - lo > 1 else hi
        part = rows[order[lo:hi]]
        widest = int((part.max(0) - part.min(0)).argmax())
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, widest], mid - lo)] if lo < mid < hi else order[lo:hi]
        cut(lo, mid, level + 1)
        cut(mid, hi, level + 1)

    cut(0, n, 0)
    rows = rows[order]
    radius, count, total = [], [], []
    for level in range(depth + 1):
        at = _bounds(n, level)
        sums, sizes = np.add.reduceat(rows, at[:-1], axis=0), np.diff(at)
        centre = np.repeat(np.floor_divide(sums, sizes[:, None]), sizes, axis=0)
        far = np.sqrt(((rows - centre).astype(np.float64) ** 2).sum(1))
        radius.append(np.maximum.reduceat(far, at[:-1]))
        count.append(sizes)
        total.append(sums)
    return order, np.concatenate(radius), np.concatenate(count), np.concatenate(total)


def grow(vectors: DataFrame) -> DataFrame:
    """A table of trees: ids, vectors, radius, count and total of each, made by every task of its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def trees() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            own, all_ids = np.concatenate(rows), pa.concat_arrays(ids)
            level = max(0, int(np.ceil(np.log2(len(own) / _TREE))))
            order = np.arange(len(own))
            _halved(own, order, 0, len(own), level)
            edges = [0]
            for part in _sizes(len(own), level):
                edges.append(edges[-1] + part)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = order[lo:hi]
                inner, radius, count, total = plant(own[at])
                at = at[inner]
                yield pa.RecordBatch.from_pydict({"ids": pa.array([all_ids.take(pa.array(at)).to_pylist()], pa.list_(pa.int64())), "vectors": [own[at].astype(np.int32).tobytes()], "radius": pa.array([radius], pa.list_(pa.float64())), "count": pa.array([count], pa.list_(pa.int64())), "total": [total.tobytes()]})

        for batch in batches:
            for lo in range(0, batch.num_rows, _GATHER):
                part = batch.slice(lo, _GATHER)
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
                held += part.num_rows
                if held >= _GATHER:
                    yield from trees()
                    ids, rows, held = [], [], 0
        yield from trees()

    return vectors.mapInArrow(run, "ids array<long>, vectors binary, radius array<double>, count array<long>, total binary")


def _sizes(n: int, level: int) -> list[int]:
    return [n] if level == 0 else [*_sizes(n >> 1, level - 1), *_sizes(n - (n >> 1), level - 1)]


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to whole-number centroids."""
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 21:  # every product and sum is below 2^53
        r, c = rows.astype(np.float64), centroids.astype(np.float64)
        return ((r * r).sum(1)[:, None] - 2 * (r @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(1) for c in centroids.astype(np.int64)], 1)


def descend(radius: np.ndarray, count: np.ndarray, total: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """For each ball of the last level the centroid that it is all nearest to, or -1; and the nodes taken whole, by index.

    A node is met only where its parent stayed open, and only centroids that its parent left in question are compared.
    """
    depth, first = _levels(n), 0
    owner, rivals, taken = np.full(1, -1), np.ones((1, len(centroids)), bool), []
    for level in range(depth + 1):
        nodes = np.arange(first, first + (1 << level))
        first += 1 << level
        open_ = np.flatnonzero(owner < 0)
        if len(open_):
            at = nodes[open_]
            centre = np.floor_divide(total[at], count[at, None])
            far = np.where(rivals[open_], np.sqrt(distances(centre, centroids).astype(np.float64)), np.inf)
            best = far.min(1, keepdims=True)
            slack = 2 * radius[at, None] + 1e-9 * (best + radius[at, None]) + 1e-6
            rivals[open_] = far <= best + slack
            whole = rivals[open_].sum(1) == 1
            owner[open_[whole]] = far[whole].argmin(1)
            taken += at[whole].tolist()
        if level < depth:
            owner, rivals = np.repeat(owner, 2), np.repeat(rivals, 2, axis=0)
    return owner, taken


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        ids, vectors, radius, count, total = (c[i] for c in batch.columns)
        rows = np.frombuffer(vectors.as_buffer(), np.int32).reshape(len(ids), -1).astype(np.int64)
        yield ids.values, rows, radius.values.to_numpy(), count.values.to_numpy(), np.frombuffer(total.as_buffer(), np.int64).reshape(-1, rows.shape[1])


def _owners(n: int, level: int, owner: np.ndarray) -> np.ndarray:
    return np.repeat(owner, np.diff(_bounds(n, level)))


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors."""
    shared = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        sums, counts = np.zeros(z.shape, np.int64), np.zeros(len(z), np.int64)
        for batch in batches:
            for _, rows, radius, count, total in _read(batch):
                owner, taken = descend(radius, count, total, z, len(rows))
                for node, c in zip(taken, _taken_by(owner, taken, len(rows)), strict=True):
                    sums[c] += total[node]
                    counts[c] += count[node]
                left = _owners(len(rows), _levels(len(rows)), owner) < 0
                if left.any():
                    exact = rows[left]
                    near = distances(exact, z).argmin(1)
                    np.add.at(sums, near, exact)
                    counts += np.bincount(near, minlength=len(z))
        yield pa.RecordBatch.from_pydict({"cluster": np.arange(len(z), dtype=np.int32), "n": counts, "s": pa.array(list(sums), pa.list_(pa.int64()))})

    parts = trees.mapInArrow(run, "cluster int, n long, s array<long>").filter("n > 0")
    width = centroids.shape[1]
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]).collect()
    out = centroids.copy()
    for r in added:  # a row for each centroid
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


def _taken_by(owner: np.ndarray, taken: list[int], n: int) -> list[int]:
    """The centroid of each node taken whole."""
    depth, out = _levels(n), []
    for node in taken:
        level = (node + 1).bit_length() - 1
        out.append(int(owner[(node + 1 - (1 << level)) << (depth - level)]))
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector of the trees."""
    shared = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = shared.value
        for batch in batches:
            for ids, rows, radius, count, total in _read(batch):
                owner, _ = descend(radius, count, total, z, len(rows))
                cluster = _owners(len(rows), _levels(len(rows)), owner).copy()
                left = cluster < 0
                if left.any():
                    cluster[left] = distances(rows[left], z).argmin(1)
                distance = ((rows - z[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(table: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of vec_id and embedding."""
    spark: SparkSession = table.sparkSession
    vectors = whole_vectors(table, width, scale)
    first = starts(vectors, k, seed)
    wide = vectors.filter("v IS NULL").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    if not first:
        return wide
    centroids = np.array(first, np.int64)
    trees = written(grow(vectors.filter("v IS NOT NULL")), "ball_trees")
    for _ in range(rounds):
        after = moved(trees, centroids)
        if (after == centroids).all():  # nothing can change any more
            break
        centroids = after
    rows = written(assigned(trees, centroids), "assigned")
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, long(s), long(sum(inertia.values())), digest(centroids[c])) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(facts), "cluster")  # a row for each centroid
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").unionByName(wide)
