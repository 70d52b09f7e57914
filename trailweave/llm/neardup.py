"""SimHash near-duplicates: a binary trie self-join over fingerprints, then connected components.

A fingerprint has a bit set where over half the shingles' hashes have it. Equal fingerprints are one row from then
on. By the pigeonhole principle two fingerprints that differ in at most ``bits`` bits agree in one of ``bits + 1``
blocks, so each is dealt out once for each block, by the block's value. A task lays its fingerprints out as a
sorted binary trie (block first), and walks pairs of nodes together from the pair (root, root): the two children
that take the same branch keep the pair's differing bits, the others add one, and a pair is dropped as soon as it
has used up the budget (in the block's own bits, at once). What a task emits is not the pairs but a star for each
component that it has seen, at most a link for each of its fingerprints; the stars of all tasks are then joined by
rounds of large-star and small-star contraction over written tables.

A fingerprint of 64 bits tells texts apart that share four fifths of their shingles (they differ in about ten bits), and
a budget of ten bits prunes no trie. ``keep_one`` therefore takes fingerprints of 1,024 bits over five-word shingles,
where such texts differ in 155 bits give or take 12. It cuts them into 32 keys of 32 bits, finds the pairs of keys
that differ in at most two bits by the same trie join, and takes those as candidates whose whole fingerprints differ in
at most ``WIDE_BUDGET`` bits, which a task tests before it joins two components: 98 % of the pairs at similarity 0.8
share such a key, and nearly all above. (The further word that a key carries differs in 10 bits, give or take 3, at that
similarity: its budget of 20 loses one such pair in 2,000 in a table, and a pair has several.) Texts of few shingles
differ in more bits at the same similarity, so ``wide_budget`` grows for them: the bits that 0.8 is expected to cost
for their number of shingles, and as many standard deviations as ``WIDE_BUDGET`` is above 155.

A task joins the closest candidates first. What it emits is then confirmed: a link stays if the two texts' exact sets
of shingles have a similarity of ``SIMILARITY`` or more, so nothing goes that isn't joined to what stays by such links.

Defined cases: a null or empty text has the fingerprint zero and is linked like any other; texts of fewer words than
a shingle are hashed whole; a null doc_id takes part but is no representative unless its component has no other
(then the component_id is null); repeated rows come out as often as they occur; a very long text is hashed whole, and
texts with equal fingerprints are linked whatever their length; ``keep_one`` keeps further columns as they are, also
those that are named like its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from xxhash import xxh64_intdigest

from trailweave.llm.shared import extended, replace_columns, written

SEED = 42
#: Node pairs that a task expands at once, and pairs of fingerprints that two small nodes may have to be compared directly.
_FRONT, _DIRECT = 1 << 16, 16
#: Pairs of rows that a task compares at once.
_PAIRS = 1 << 16
#: Words of a wide fingerprint, bits that linked ones may differ in, bits that a table's keys may, and bits that a
#: further word, carried along, may differ in before a pair of keys is taken for chance.
WIDE, WIDE_BUDGET, KEY_BUDGET, CHECK_BUDGET = 16, 184, 2, 20
#: Shares of the bits that candidates may differ in, in the order in which a task takes them.
_NEARER = (0.6, 0.8, 0.9, 1.0)
#: Shared shingles of all shingles of two near copies, at least: four fifths.
SIMILARITY = (4, 5)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle; words are runs of other bytes than space and 0x09 to 0x0D, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    tokens = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, tokens, repeat(SEED)), np.uint64)


def _majority(rows: np.ndarray) -> np.ndarray:
    """Words whose bits are set in over half the rows of a matrix of 64-bit words."""
    n, width = rows.shape
    counts = np.zeros(64 * width, np.int64)
    for at in range(0, n, 255):  # so many ones fit a byte
        bits = np.unpackbits(np.ascontiguousarray(rows[at : at + 255]).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, of all shingles with repeats."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    return int(_majority(hashes[:, None])[0])


def wide_fingerprint(text: str | None, shingle: int = 5) -> np.ndarray:
    """``WIDE`` words of 64 bits, of the set of shingles: each shingle's hash is mixed anew for each word."""
    return _wide(np.unique(shingle_hashes(text, shingle)))


def _wide(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(WIDE, np.uint64)
    out = np.empty((len(hashes), WIDE), np.uint64)
    for i in range(WIDE):
        h = hashes + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = h ^ (h >> np.uint64(31))
    return _majority(out)


def _differ(common: int, one: int, other: int) -> float:
    """Chance that majorities of fair signs differ, of which ``common`` are shared and the rest are not."""
    chances = [np.array([comb(m, k) for k in range(m + 1)], float) / 2.0**m for m in (common, one, other)]
    x, y, z = (np.arange(len(c)) for c in chances)
    for_one = ((x[:, None] + y) * 2 > common + one) @ chances[1]
    for_other = ((x[:, None] + z) * 2 > common + other) @ chances[2]
    return float(chances[0] @ (for_one * (1 - for_other) + for_other * (1 - for_one)))


@lru_cache(1 << 10)
def wide_budget(shingles: int) -> int:
    """Bits that the wide fingerprints of two texts may differ in, of which the shorter has so many shingles."""
    n = min(max(1, shingles), 256)
    # similarity 0.8 by further shingles, and by replaced ones
    p = max(_differ(n, 0, n // 4), _differ(n - n // 9, n // 9, n // 9))
    bits = 64 * WIDE
    return max(WIDE_BUDGET, round(bits * p + 2.5 * (bits * p * (1 - p)) ** 0.5)) if n < 256 else WIDE_BUDGET


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with fp, the fingerprint as a signed long; a column of that name gives way."""
    docs = docs.drop("fp") if any(c.lower() == "fp" for c in docs.columns) else docs
    at = [c.lower() for c in docs.columns].index(text.lower())
    schema = extended(docs, {"fp": "long"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(at)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(run, schema)


def _join_forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, links: list) -> np.ndarray:
    """Labels, each the smallest index of its component so far, with the pairs a-b taken in; those that joined two components go to ``links``."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        high, first = np.unique(np.maximum(x, y), return_index=True)
        label[high] = np.minimum(x, y)[first]
        links.append((a[first], b[first]))
        while ((up := label[label]) != label).any():
            label = up
    return label


def _trie_pairs(keys: np.ndarray, bits: int, exact: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair (i < j), some at a time, of the sorted distinct 64-bit keys that differ in at most ``bits`` bits, none of them among the first ``exact``."""
    n = len(keys)
    stack = [(0, *(np.array([v]) for v in (0, n, 0, n, 0)))] if n > 1 else []
    while stack:
        depth, a0, a1, b0, b1, used = stack.pop()
        same = a0 == b0
        small = ((a1 - a0) * (b1 - b0) <= _DIRECT) if depth >= exact else np.zeros(len(a0), bool)
        if small.any():
            counts = ((a1 - a0) * (b1 - b0))[small]
            which = np.repeat(np.flatnonzero(small), counts)
            k = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            wide = (b1 - b0)[which]
            i, j = a0[which] + k // wide, b0[which] + k % wide
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= bits)
            yield i[near], j[near]
            a0, a1, b0, b1, used, same = (v[~small] for v in (a0, a1, b0, b1, used, same))
        keep = ~(same & (a1 - a0 < 2))
        a0, a1, b0, b1, used, same = (v[keep] for v in (a0, a1, b0, b1, used, same))
        if not len(a0) or depth == 64:
            continue
        shift = np.uint64(63 - depth)
        # where the one-branch of the node that starts at ``lo`` begins
        branch = lambda lo, hi: np.clip(np.searchsorted(keys, ((keys[lo] >> shift) | np.uint64(1)) << shift), lo, hi)
        am, bm = branch(a0, a1), branch(b0, b1)
        across = used + 1
        apart = (across <= bits) if depth >= exact else np.zeros(len(a0), bool)
        turned = apart & ~same
        nodes = [np.concatenate(v) for v in zip((a0, am, b0, bm, used), (am, a1, bm, b1, used), (a0[apart], am[apart], bm[apart], b1[apart], across[apart]), (am[turned], a1[turned], b0[turned], bm[turned], across[turned]), strict=True)]
        full = (nodes[1] > nodes[0]) & (nodes[3] > nodes[2])
        nodes = [v[full] for v in nodes]
        for at in range(0, len(nodes[0]), _FRONT):
            stack.append((depth + 1, *(v[at : at + _FRONT] for v in nodes)))


def trie_forest(keys: np.ndarray, bits: int, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices a, b), fewer than keys, that connect what all links of the sorted distinct 64-bit keys connect.

    Linked are keys that differ in at most ``bits`` bits, none of them among the first ``exact``.
    """
    label, links = np.arange(len(keys)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in _trie_pairs(keys, bits, exact):
        label = _join_forest(label, i, j, links)
    return tuple(np.concatenate(v) for v in zip(*links, strict=True))


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Slices that hold ``_PAIRS`` of the sizes' sum, or a single one."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, "right")))
        yield slice(lo, hi)
        lo = hi


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then those of first[1], and so on."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def _row_pairs(pairs: Iterator, first: np.ndarray, size: np.ndarray, matters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``pairs`` of keys (a key has ``size`` rows from ``first``), some at a time.

    ``matters(row, key)`` says, when its turn comes, which rows are still to meet which keys.
    """
    for i, j in pairs:
        for some in _slices(size[i]):
            a, k = _spread(first[i[some]], size[i[some]]), np.repeat(j[some], size[i[some]])
            for part in _slices(size[k]):
                x, y = a[part], k[part]
                now = matters(x, y)
                x, y = x[now], y[now]
                if len(x):
                    yield np.repeat(x, size[y]), _spread(first[y], size[y])


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row and number of rows of each of the sorted keys, and the keys that have several."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    return first, size, np.flatnonzero(size > 1)


def _with_candidates(keys: np.ndarray, check: np.ndarray, exact: int, before: list[np.uint64]) -> np.ndarray:
    """Which rows (sorted keys) have another whose key is within ``KEY_BUDGET`` bits and whose word within ``CHECK_BUDGET``.

    Pairs that agree in one of the masks ``before`` have met in another block.
    """
    first, size, several = _grouped(keys)
    has = np.zeros(len(keys), bool)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not before:
            yield several, several
        for i, j in _trie_pairs(keys[first], KEY_BUDGET, exact):
            x = keys[first[i]] ^ keys[first[j]]
            new = np.ones(len(x), bool)
            for mask in before:
                new &= (x & mask) != 0
            yield i[new], j[new]

    for a, b in _row_pairs(pairs(), first, size, lambda row, key: ~has[row] | ~np.logical_and.reduceat(has, first)[key]):
        near = (a != b) & (np.bitwise_count(check[a] ^ check[b]) <= CHECK_BUDGET)
        has[a[near]] = has[b[near]] = True
    return has


def _wide_forest(keys: np.ndarray, wide: np.ndarray, room: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows a, b), fewer than rows (sorted keys), that connect all pairs of near keys and of fingerprints within ``room`` bits, the larger of the two rows'.

    Nearer pairs join first, by ``_NEARER`` shares of that room.
    """
    first, size, several = _grouped(keys)
    label, links = np.arange(len(keys)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def matters(row: np.ndarray, key: np.ndarray) -> np.ndarray:
        low, high = np.minimum.reduceat(label, first)[key], np.maximum.reduceat(label, first)[key]
        return (label[row] != low) | (low != high)

    for share in _NEARER:
        for a, b in _row_pairs(chain([(several, several)], _trie_pairs(keys[first], KEY_BUDGET, exact)), first, size, matters):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            near = np.bitwise_count(wide[a] ^ wide[b]).sum(1, dtype=np.int64) <= share * np.maximum(room[a], room[b])
            label = _join_forest(label, a[near], b[near], links)
    return tuple(np.concatenate(v) for v in zip(*links, strict=True))


def _buckets(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(block, columns after the second) of whole block values, several at a time, from batches sorted by block and value."""
    at, held, size = None, [], 0
    for batch in batches:
        block, value, *rest = (c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(value) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
            here = (block[lo], value[lo])
            if at and (here[0] != at[0] or (here != at and size >= most)):
                yield int(at[0]), [np.concatenate(c) for c in zip(*held, strict=True)]
                held, size = [], 0
            at = here
            held.append([c[lo:hi] for c in rest])
            size += hi - lo
    if held:
        yield int(at[0]), [np.concatenate(c) for c in zip(*held, strict=True)]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a block value together and in order; values are dealt by hash."""
    return rows.repartition("block", "value").sortWithinPartitions("block", "value")


def _link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = a.view(np.int64), b.view(np.int64)
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def trie_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b), a < b, whose components are those of all pairs of distinct ``fp`` within ``bits`` bits."""
    width = 64 // (bits + 1)
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), (F.shiftleft("fp", i * width).bitwiseOR(F.shiftrightunsigned("fp", 64 - i * width)) if i else F.col("fp")).alias("key")) for i in range(bits + 1)])
    dealt = prints.select(F.inline(blocks)).withColumn("value", F.shiftrightunsigned("key", 64 - width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (keys,) in _buckets(batches):
            keys = np.sort(keys.view(np.uint64))
            a, b = (keys[i] for i in trie_forest(keys, bits, width))
            if block:
                back, rest = np.uint64(block * width), np.uint64(64 - block * width)
                a, b = ((v >> back) | (v << rest) for v in (a, b))
            yield _link_batch(a, b)

    return _dealt(dealt).select("block", "value", "key").mapInArrow(run, "a long, b long")


def wide_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of ``prints`` (fp long, wide array<long>, room int), whose wide fingerprints differ in at most ``room`` bits.

    ``room`` is the larger of the two rows', and ``WIDE_BUDGET`` where ``prints`` has no such column.

    The keys alone are dealt first, and only rows that have a candidate are dealt again with their whole fingerprints.
    So a task compares every candidate by all bits before it joins two components, and what it emits is a forest of
    true links, fewer than its rows.
    """
    if "room" not in prints.columns:
        prints = prints.withColumn("room", F.lit(WIDE_BUDGET))
    parts, tables = KEY_BUDGET + 1, 2 * WIDE
    cuts = [32 * i // parts for i in range(parts + 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                fp, wide = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)
                halves = wide.view(np.uint32).astype(np.uint64)
                for t in range(tables):
                    check = wide[:, (t // 2 + WIDE // 2) % WIDE].view(np.int64)
                    for i in range(parts):
                        c, n = np.uint64(cuts[i]), cuts[i + 1] - cuts[i]
                        key = (((halves[:, t] << c) | (halves[:, t] >> (np.uint64(32) - c))) & np.uint64(0xFFFFFFFF)) << np.uint64(32)
                        yield pa.record_batch([pa.array(np.full(len(fp), t * parts + i, np.int32)), pa.array((key >> np.uint64(64 - n)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(check), pa.array(fp)], names=["block", "value", "key", "check", "fp"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (keys, check, fp) in _buckets(batches):
            part = block % parts
            c, n = cuts[part], cuts[part + 1] - cuts[part]
            order = np.argsort(keys.view(np.uint64), kind="stable")
            keys, check, fp = keys.view(np.uint64)[order], check.view(np.uint64)[order], fp[order]
            before = [np.uint64(((1 << (cuts[q + 1] - cuts[q])) - 1) << (32 + c - cuts[q + 1])) for q in range(part)]
            has = _with_candidates(keys, check, n, before)
            keys, fp = keys[has], fp[has]
            yield pa.record_batch([pa.array(np.full(len(fp), block, np.int32)), pa.array((keys >> np.uint64(64 - n)).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(fp)], names=["block", "value", "key", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (keys, fp, wide, room) in _buckets(batches, 1 << 16):
            part = block % parts
            order = np.argsort(keys.view(np.uint64), kind="stable")
            keys, fp, wide, room = keys.view(np.uint64)[order], fp[order], wide[order].view(np.uint64), room[order]
            a, b = _wide_forest(keys, wide, room, cuts[part + 1] - cuts[part])
            yield _link_batch(fp[a], fp[b])

    dealt = _dealt(prints.select("fp", "wide").mapInArrow(deal, "block int, value int, key long, check long, fp long"))
    candidates = written(dealt.mapInArrow(kept, "block int, value int, key long, fp long"), "candidates")
    whole = _dealt(candidates.join(prints.select("fp", "wide", "room"), "fp").select("block", "value", "key", "fp", "wide", "room"))
    return whole.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): the smallest node that it is connected with.

    Large-star and small-star steps in turn, each over a written table, until a round changes nothing.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links_0")
    before, turn = state(edges), 0
    while before[0]:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, f"large_{turn}")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), f"links_{turn}")
        if (after := state(edges)) == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def with_components(prints: DataFrame, links: DataFrame) -> DataFrame:
    """``prints`` (with doc_id and fp) with component_id, the smallest doc_id reachable by links, and root_fp."""
    unique = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    roots = written(components(links), "roots")
    rooted = unique.join(roots, unique.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root_fp"), "least_id")
    # a table of its own, so that nothing but the join stands above its exchange and a large component can be split
    least = written(rooted.groupBy("root_fp").agg(F.min("least_id").alias("component_id")), "least")
    of_print = written(rooted.join(least, "root_fp").select(F.col("fp").alias("_tw_fp"), "component_id", "root_fp"), "of_print")
    kept = prints.drop("component_id", "root_fp")
    return kept.join(of_print, kept.fp == of_print["_tw_fp"]).drop("_tw_fp")


def near_duplicates(prints: DataFrame, bits: int = 3) -> DataFrame:
    """``prints`` (with doc_id and fp) with component_id, by links of fingerprints within ``bits`` bits."""
    return with_components(prints, trie_links(prints.select("fp").distinct(), bits))


def wide_fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` (text last) without text, with wide, an array of longs, and room, the bits that a near copy may differ in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            wide, room = np.empty((batch.num_rows, WIDE), np.uint64), np.empty(batch.num_rows, np.int32)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                own = np.unique(shingle_hashes(text.as_py(), shingle))
                wide[i], room[i] = _wide(own), wide_budget(min(len(own), 256))
            wide = wide.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(wide) + 1, dtype=np.int32) * WIDE), pa.array(wide.ravel()))
            room = pa.array(room)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, room], names=[*batch.schema.names[:-1], "wide", "room"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields[:-1], StructField("wide", ArrayType(LongType())), StructField("room", IntegerType())]))


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` (text last) without text, with shingles, the hashes of the text's different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column(batch.num_columns - 1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "shingles"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields[:-1], StructField("shingles", ArrayType(LongType()))]))


def similar_links(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``links`` (a, b) between ``sets`` (fp, shingles) of a similarity of ``SIMILARITY`` or more.

    A fingerprint's set travels once for each of its links, and links are fewer than fingerprints in a table of keys.
    """
    of, all_ = SIMILARITY
    pairs = links.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return pairs.filter(all_ * common >= of * (F.size("x") + F.size("y") - common)).select("a", "b")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each component of near copies: that of the smallest doc_id, once.

    Rows without a doc_id stay only where their component has no other, one of them. Texts are exchanged once, by the
    pair of id and text hash that the semi-join and the choice among repeated rows share, and those of one document for
    each fingerprint that has a candidate once more, for the exact test of its links.
    """
    names = docs.columns
    row = replace_columns(docs, _tw_id=F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), _tw_text=F.xxhash64("text"))
    wide = wide_fingerprints(row.select("doc_id", "_tw_id", "_tw_text", "text"), shingle)
    slim = written(wide.withColumn("fp", F.xxhash64("wide")), "slim")
    unique = written(slim.groupBy("fp").agg(F.any_value("wide").alias("wide"), F.max("room").alias("room")), "wide")
    links = written(wide_links(unique), "candidate_links")
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    of_print = slim.select("fp", "_tw_id", "_tw_text").join(ends, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("_tw_id", "_tw_text")).alias("at")).select("fp", "at.*")
    # the texts of one row each: repeated rows count once
    texts = row.select("_tw_id", "_tw_text", "text").join(of_print, ["_tw_id", "_tw_text"]).groupBy("fp").agg(F.any_value("text").alias("text"))
    sets = written(shingle_sets(texts, shingle), "shingle_sets")
    found = with_components(slim.drop("wide", "room"), similar_links(links, sets))
    first = found.filter("doc_id <=> component_id").groupBy("root_fp", "_tw_id").agg(F.min("_tw_text").alias("_tw_text")).select("_tw_id", "_tw_text")
    kept = row.join(first, ["_tw_id", "_tw_text"], "left_semi")
    return kept.dropDuplicates(["_tw_id", "_tw_text"]).select(*[F.col(f"`{c}`") for c in names])
