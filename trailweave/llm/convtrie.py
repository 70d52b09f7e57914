"""The prefix trie of rebuilt conversations, as a Cartesian tree over the array of longest common prefixes.

A turn is a digest of 16 bytes (of SHA-256) of role and text with the text's code points behind it, so texts are never
exchanged. Conversations with equal sequences are one row with their members summed up; the distinct sequences are
sorted by all tasks together, and LCP[i] is the number of turns that sequence i shares with the one before it. Every
trie node is an interval of the sorted sequences: at depth d it starts at an x with LCP[x] < d and ends before the next
y with LCP[y] < d. So the tree comes from all nearest smaller values of the LCP array:

1. sorted sequences are cut into blocks of consecutive rows; a block is a row of arrays, and borders between blocks
   get their LCP from the edges of the partitions;
2. within a block a stack finds nearest smaller values; nodes with the same interval start and value are one, and the
   depths that no LCP value names are filled in between a node and its parent;
3. nodes that cross a block's border are at most as many as the border's LCP. A block's minimum says which of them run
   through it: a node's start is the last block before that starts one of its depth, which a window by depth finds, and
   counts and minima of its parts are added up by its start;
4. with these sums each block emits the nodes that start in it, whose subtrees are ranges of its preorder.

Bounds: a conversation's digests are one row (20 bytes a turn; its texts are not), and a block holds at most ``_BLOCK``
sequences or about ``_TURNS`` turns. SHA-256 over a sequence's members is sequential by nature: ids are sorted and
joined in chunks by ranges of ids, in parallel, and one task feeds the chunks of a sequence to the hash one by one.

Defined cases: rows without conv_id belong to no conversation. Null roles and texts are empty. Turns with equal (or
null) numbers are ordered by their digests, so repeated rows are turns that follow one another. A conversation that
keeps no turn is a member of the root alone. Long texts are one digest. An empty table gives no row. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.shared import written

_BLOCK, _TURNS, _IDS = 4096, 1 << 16, 1 << 16
NO_END = hashlib.sha256(b"").hexdigest()


def turns(table: DataFrame) -> DataFrame:
    """conv_id, turn, e: digest and code points of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    points = F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))
    return table.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(digest, points).alias("e"))


def rebuilt(table: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, e (array of turns): the first turns of the group's first conversation, then the own ones behind them.

    How many, h, is the crc32 of conv_id modulo ``most``; nobody needs more than ``most`` - 1 turns of another.
    """
    line = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.col("e"))))
    own = written(turns(table).groupBy("conv_id").agg(F.transform(line, lambda t: t.e).alias("e")), "conversations")
    head = F.col("conv_id") - F.col("conv_id") % group
    first = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.slice("e", 1, most - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = own.withColumns({"head": head, "h": h}).join(first, "head", "left")
    lead = F.when(F.col("h") > 0, F.slice(F.coalesce("lead", F.array().cast("array<binary>")), 1, F.greatest("h", F.lit(1)))).otherwise(F.array().cast("array<binary>"))
    rest = F.slice("e", F.col("h") + 1, F.greatest(F.size("e"), F.lit(1)))
    return both.select("conv_id", F.concat(lead, rest).alias("e"))


def sequences(conversations: DataFrame) -> DataFrame:
    """e, n, least, ends of each distinct sequence: its members, the smallest, and the hash of them all."""
    named = conversations.withColumn("g", F.unhex(F.sha2(F.array_join(F.transform("e", F.hex), "").cast("binary"), 256)))
    part = named.groupBy("g", F.floor(F.col("conv_id") / _IDS).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"), F.any_value("e").alias("e"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, least, sha = None, None, 0, 0, None
        for batch in batches:
            out = []
            for g, count, low, ids, e in zip(*(batch.column(i) for i in (0, 2, 3, 4, 5)), strict=True):
                if g != now:
                    if now is not None:
                        out.append((first, n, least, sha.hexdigest()))
                    now, first, n, least, sha = g, e.as_py(), 0, low.as_py(), hashlib.sha256()
                sha.update((b"," if n else b"") + ids.as_buffer())
                n += count.as_py()
            if out:
                yield _batch(out)
        if now is not None:
            yield _batch([(first, n, least, sha.hexdigest())])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["e", "n", "least", "ends"])

    lined = part.select("g", "part", "n", "least", "ids", "e").repartition("g").sortWithinPartitions("g", "part")
    return lined.mapInArrow(fold, "e array<binary>, n long, least long, ends string")


_BLOCK_DDL = "part int, block long, first array<binary>, last array<binary>, lcp array<int>, size array<int>, points array<int>, n array<long>, least array<long>, ends array<string>"


def shared_turns(a: list, b: list) -> int:
    """How many turns two sequences begin with alike."""
    for i, (x, y) in enumerate(zip(a, b)):  # noqa: B905
        if x != y:
            return i
    return min(len(a), len(b))


def blocks(sorted_rows: DataFrame) -> DataFrame:
    """Blocks of consecutive sorted sequences, with the LCP of each with the one before (-1 where that is elsewhere).

    ``lcp`` has an entry more than there are sequences: the last is that of the next block's first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, rows, lcp, before, held = TaskContext.get().partitionId(), 0, [], [], None, 0

        def block(after: int) -> pa.RecordBatch:
            e = [r[0] for r in rows]
            points = [int.from_bytes(t[16:], "big") for s in e for t in s]
            columns = [[part], [(part << 33) + serial], [e[0] if serial == 0 else None], [e[-1] if after < 0 else None], [[*lcp, after]], [[len(s) for s in e]], [points], *([[r[i] for r in rows]] for i in (1, 2, 3))]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _BLOCK_DDL.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                row = tuple(v.as_py() for v in row)
                shared = -1 if before is None else shared_turns(before, row[0])
                if rows and (len(rows) >= _BLOCK or held + len(row[0]) > _TURNS):
                    yield block(shared)
                    rows, lcp, held, serial = [], [], 0, serial + 1
                rows.append(row)
                lcp.append(shared)
                before, held = row[0], held + len(row[0])
        if rows:
            yield block(-1)

    return sorted_rows.select("e", "n", "least", "ends").mapInArrow(run, _BLOCK_DDL)


def with_borders(table: DataFrame) -> DataFrame:
    """Blocks whose first and last LCP are filled in where a partition ends; a row for each partition is compared."""
    edge = table.groupBy("part").agg(F.first("first", True).alias("first"), F.first("last", True).alias("last"))
    line = Window.orderBy("part")  # a row for each partition of the sort

    def shared(a: str, b: str) -> F.Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.when(F.col(a).isNull() | F.col(b).isNull(), 0).otherwise(F.array_position(same, F.lit(False)).cast("int") - 1)

    both = edge.withColumns({"before": F.lag("last").over(line), "after": F.lead("first").over(line)})
    # equal sequences are one row, so two neighbours always differ: at the shorter one's end at the latest
    border = both.select("part", shared("before", "first").alias("left"), shared("last", "after").alias("right"))
    fill = lambda c: F.transform("lcp", lambda x, i: F.when(x >= 0, x).when(i == 0, F.col("left")).otherwise(F.col("right")))
    return table.join(border, "part").withColumn("lcp", fill("lcp")).select("block", "lcp", "size", "points", "n", "least", "ends")


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last one before with a smaller value (-1: none) and the first one behind (length: none)."""
    left, right, stack = np.full(len(values), -1), np.full(len(values), len(values)), []
    for i, v in enumerate(values.tolist()):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            same = values[stack[-1]] == v
            left[i] = left[stack[-1]] if same else stack[-1]
            if same:  # equal values end together; the later one stands for both
                right[stack[-1]] = -i - 1
                stack.pop()
        stack.append(i)
    for i in range(len(values) - 1, -1, -1):  # of equal ones, each earlier ends where the later does
        if right[i] < 0:
            right[i] = right[-right[i] - 1]
    return left, right


class Block:
    """The nodes that start in a block, in preorder: x (first sequence), depth, end (first sequence behind; k: open)."""

    def __init__(self, lcp: list[int], size: list[int], points: np.ndarray, n: np.ndarray, least: np.ndarray):
        self.k = k = len(size)
        self.lcp, self.size = np.asarray(lcp, np.int64), np.asarray(size, np.int64)
        self.n, self.least = np.asarray(n, np.int64), np.asarray(least, np.int64)
        before, behind = nearest_smaller(self.lcp)
        # Cartesian nodes: (start, value, end), those of equal values and start merged; value 0 is the root
        values = self.lcp[1:k]
        start = np.where(values > 0, before[1:k], -1)
        cart = np.stack([start, values, np.minimum(behind[1:k], k)], 1)
        inside = (start >= 0) & (values > 0)
        # an interval that starts with the block: no smaller value stands between its first row and it
        first = (values > 0) & (before[1:k] < 0) & (self.lcp[0] < values)
        cart[first, 0] = 0
        cart = cart[inside | first]
        leaves = np.stack([np.arange(k), self.size, self._ends(self.size)], 1)
        # the right border's values name nodes that stay open: their starts are those of a value just behind the end
        edge = [(x, v, k) for x, v in self.open_starts()]
        nodes = np.unique(np.concatenate([cart, leaves[self.size > self.lcp[:k]], np.array(edge, np.int64).reshape(-1, 3)]), axis=0)
        x, top, end = nodes.T
        low = np.where(np.concatenate([[True], x[1:] != x[:-1]]), self.lcp[x], np.concatenate([[0], top[:-1]]))
        times = top - low  # missing depths between a node and its parent
        self.x, self.end = np.repeat(x, times), np.repeat(end, times)
        self.depth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times) + 1
        offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.points = np.asarray(points, np.int64)[offsets[self.x] + self.depth - 1]
        self.at = np.searchsorted(self.x, np.arange(k + 1))  # where each sequence's nodes begin
        self.open = (self.end == k) & (self.depth <= self.lcp[k])
        self.sum_n = np.concatenate([[0], np.cumsum(self.n)])
        self.childless = (self.size > self.lcp[:k]) & (self.lcp[1:] < self.size)
        self.sum_leaves = np.concatenate([[0], np.cumsum(self.childless)])

    def _ends(self, depth: np.ndarray) -> np.ndarray:
        """Where the nodes of full depth of each sequence end: at the next LCP below it."""
        out, stack = np.full(self.k, self.k), []
        for y in range(1, self.k + 1):
            stack.append(y - 1)
            v = self.lcp[y]
            while stack and depth[stack[-1]] > v:
                out[stack.pop()] = y
        return out

    def open_starts(self) -> list[tuple[int, int]]:
        """(x, depth) of the nodes that start here and go on behind the block, one for each start: the deepest."""
        out, deepest = [], int(self.lcp[self.k])
        for x in range(self.k - 1, -1, -1):
            if deepest <= 0:
                break
            if self.lcp[x] < deepest:
                out.append((x, deepest))
                deepest = int(self.lcp[x])
        return out

    def weights(self, total: dict[int, int] | None = None) -> np.ndarray:
        """What each node saves by itself; open ones by their whole number of members, or nothing where that isn't known."""
        n = self.sum_n[self.end] - self.sum_n[self.x]
        if total is None:
            n = np.where(self.open, 1, n)
        else:
            n = n.copy()
            for i in np.flatnonzero(self.open):
                n[i] = total[int(self.depth[i])]
        return (n - 1) * self.points

    def parts(self) -> list[tuple]:
        """depth, side, x (-1: starts before), n, least, leaves, children, saved (of closed nodes), points of each crossing node's part."""
        k, out = self.k, []
        through = int(self.lcp.min())
        closed = np.concatenate([[0], np.cumsum(self.weights())])
        for d in range(1, max(int(self.lcp[0]), int(self.lcp[k])) + 1):
            if d <= through:
                sides = [(0, -1, 0, k)]
            else:
                sides = []
                if d <= self.lcp[0]:
                    sides.append((1, -1, 0, int(np.flatnonzero(self.lcp[1:] < d)[0]) + 1))
                if d <= self.lcp[k]:
                    sides.append((2, int(np.flatnonzero(self.lcp[:k] < d)[-1]), -1, k))
            for side, x, lo, hi in sides:
                lo = x if x >= 0 else lo
                inner = self.lcp[lo + (x >= 0) : hi]
                children = int((inner == d).sum()) + int(x >= 0 and self.size[x] > d)
                at = self.at[x] + d - self.lcp[x] - 1 if x >= 0 else self.at[lo]
                points = int(self.points[at]) if x >= 0 else 0
                out.append((d, side, x, int(self.sum_n[hi] - self.sum_n[lo]), int(self.least[lo:hi].min()), int(self.sum_leaves[hi] - self.sum_leaves[lo]), children, int(closed[self.at[hi]] - closed[at]), points))
        return out

    def nodes(self, left: dict[int, tuple], right: dict[int, tuple], ends: list[str]) -> tuple[np.ndarray, ...]:
        """All columns of the nodes that start here; ``left`` and ``right`` have the sums of crossing nodes by depth: least, n, children, leaves, saved."""
        x, end, depth = self.x, self.end, self.depth
        n = self.sum_n[end] - self.sum_n[x]
        leaves = self.sum_leaves[end] - self.sum_leaves[x]
        least = self._least()
        weight = np.concatenate([[0], np.cumsum(self.weights({d: s[1] for d, s in right.items()}))])
        saved = weight[self.at[end]] - weight[np.arange(len(x))]
        children = (self.size[x] > depth).astype(np.int64)
        up = self._parents()
        grown = np.flatnonzero((up >= 0) & (depth > 1) & (x != np.where(up >= 0, x[np.maximum(up, 0)], -1)))
        np.add.at(children, up[grown], 1)
        for i in np.flatnonzero(self.open):
            least[i], n[i], children[i], leaves[i], saved[i] = right[int(depth[i])]
        parent = np.where(up >= 0, least[np.maximum(up, 0)], -1)
        known = up >= 0
        for i in np.flatnonzero(~known & (depth > 1)):
            parent[i] = left[int(depth[i]) - 1][0]
            known[i] = True
        end_of = [ends[s] if self.size[s] == d else NO_END for s, d in zip(x.tolist(), depth.tolist(), strict=True)]
        return least, depth, parent, depth > 1, n, children, leaves, saved, end_of

    def _least(self) -> np.ndarray:
        """The least member of each node's interval."""
        if not len(self.x):
            return np.zeros(0, np.int64)
        padded = np.append(self.least, np.iinfo(np.int64).max)
        return np.minimum.reduceat(padded, np.stack([self.x, self.end], 1).ravel())[::2]

    def _parents(self) -> np.ndarray:
        """The index of each node's parent in the block (-1: the root, or a node that starts before the block)."""
        before, _ = nearest_smaller(self.lcp)
        up = np.arange(len(self.x)) - 1
        for i in np.flatnonzero(self.depth == self.lcp[self.x] + 1):  # the topmost of a sequence
            x, d = int(self.x[i]), int(self.depth[i]) - 1
            p = int(before[x]) if x > 0 else -1
            up[i] = -1 if d == 0 or p < 0 and (x == 0 or self.lcp[0] >= d) else self.at[max(p, 0)] + d - self.lcp[max(p, 0)] - 1
        return up


def _block(batch: pa.RecordBatch, i: int) -> Block:
    value = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
    return Block(value("lcp"), value("size"), value("points"), value("n"), value("least"))


_PART_DDL = "block long, depth int, side int, x int, n long, least long, leaves long, children long, saved long, points long"


def crossing(table: DataFrame) -> DataFrame:
    """The parts of nodes that cross a block's border, a row for each block and depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(batch.column("block")[i].as_py(), *p) for i in range(batch.num_rows) for p in _block(batch, i).parts()]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in _PART_DDL.split(", ")], r, strict=True)) for r in rows], pa.schema([(f.split()[0], pa.int32() if f.endswith(" int") else pa.int64()) for f in _PART_DDL.split(", ")]))

    return table.mapInArrow(run, _PART_DDL)


def crossing_sums(parts: DataFrame) -> DataFrame:
    """For each block and side (1 left, 2 right) the sums of the whole nodes that cross its border, by depth."""
    line = Window.partitionBy("depth").orderBy("block", "side")
    start = F.last(F.when(F.col("x") >= 0, F.col("block")), True).over(line)
    named = written(parts.withColumn("start", start), "crossing")
    whole = named.groupBy("start", "depth").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("leaves").alias("leaves"), F.sum("children").alias("children"), F.max("points").alias("points"))
    # what nodes weigh that start in a block and stay open counts for every part that lies around their start
    begun = named.filter("x >= 0").select("block", "depth").join(whole.withColumnRenamed("start", "block"), ["block", "depth"]).select("block", F.col("depth").alias("deeper"), ((F.col("n") - 1) * F.col("points")).alias("weight"))
    around = named.filter("side <> 1").join(begun, "block").filter("deeper >= depth").groupBy("start", "depth").agg(F.sum("weight").alias("open_saved"))
    saved = named.groupBy("start", "depth").agg(F.sum("saved").alias("saved"))
    sums = whole.join(saved, ["start", "depth"]).join(around, ["start", "depth"], "left").withColumn("saved", F.col("saved") + F.coalesce("open_saved", F.lit(0)))
    fact = F.struct("depth", "side", "least", "n", "children", "leaves", "saved")
    return named.select("block", "depth", "side", "start").join(sums, ["start", "depth"]).groupBy("block").agg(F.collect_list(fact).alias("sums"))


_NODE_DDL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(table: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """A row for each node of the prefix trie of the rebuilt conversations of conv_id, turn, role and text."""
    found = written(sequences(rebuilt(table, group, most)), "sequences")
    lined = found.filter(F.size("e") > 0).orderBy("e")
    cut = written(with_borders(written(blocks(lined), "blocks")), "bordered")
    ready = cut.join(crossing_sums(crossing(cut)), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _block(batch, i)
                sums = batch.column("sums")[i].as_py() or []
                of = {s: {r["depth"]: (r["least"], r["n"], r["children"], r["leaves"], r["saved"]) for r in sums if r["side"] in (0, s)} for s in (1, 2)}
                least, depth, parent, has, n, children, leaves, saved, ends = block.nodes(of[1], of[2], batch.column("ends")[i].as_py())
                above = pa.array(parent, pa.int64(), mask=~has)
                yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(depth), above, *map(pa.array, (n, children, leaves, saved)), pa.array(ends, pa.string())], names=[f.split()[0] for f in _NODE_DDL.split(", ")])

    below = written(ready.mapInArrow(run, _NODE_DDL), "trie_nodes")
    # the parent of a node of depth 1 is the root, whose least member is that of all conversations
    empty = found.filter(F.size("e") == 0).select("least", "n", "ends")
    facts = below.filter("depth = 1").agg(F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    facts = facts.crossJoin(empty.agg(F.min("least").alias("e_least"), F.sum("n").alias("e_n"), F.max("ends").alias("e_ends")))  # one row each
    zero = F.lit(0)
    root = facts.filter("n IS NOT NULL OR e_n IS NOT NULL").select(
        F.least("least", "e_least").alias("conv_id"), zero.cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), (F.coalesce("n", zero) + F.coalesce("e_n", zero)).alias("n_convs"), F.col("children").alias("n_children"),
        F.greatest(F.coalesce("leaves", zero), F.lit(1)).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("e_ends", F.lit(NO_END)).alias("ends_sha256"))
    root = written(root, "root")
    top = below.crossJoin(F.broadcast(root.select(F.col("conv_id").alias("root_least"))))  # one row
    return top.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_least")).otherwise(F.col("parent_conv_id"))).drop("root_least").unionByName(root)
