"""Operators on streams that keep several variables of state for a key, in event order, with timers and expiry.

Rows of a key wait in its state until the watermark has passed them, and are then taken in the order of time and id; what
comes out is what the batch form gives for the same rows. A timer for the earliest waiting row releases what is ready;
where a processor has a time to keep, another clears a key's state that long after its last row. State lives in
RocksDB beside the checkpoint, so a query that is started again from its checkpoint goes on where it was.

``ledger_taint``  a seed's haircut: balances of addresses and what each holds of the seed, over whole transactions;
                  all that waits is one list of the seed's state, so much waiting at once is for ``ledger.TaintLedger``
``peel_pointers`` an address's latest peeling spend, told whenever it changes
``chained``       a hash chain of events: number and head
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that these operators need, for the queries that start inside."""
    was = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was)


class Ordered(StatefulProcessor):
    """Takes a key's rows in event order once the watermark has passed them.

    Subclasses name the columns of their rows (``row``: a DDL that begins with "at long, id string", microseconds and a
    tie-break), open their own state, and turn a row into rows in ``take``. ``keep`` is how many milliseconds after its
    last released row a key's state goes (0: never).
    """

    row, keep = "at long, id string", 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.last = handle.getValueState("last", "at long")
        self.open(handle)

    def names(self) -> list[str]:
        return [f.split()[0] for f in self.row.split(", ")]

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def begin(self, key: tuple) -> None: ...

    def take(self, key: tuple, row: Row) -> Iterator[Row]:
        raise NotImplementedError

    def end(self, key: tuple) -> None: ...

    def forget(self) -> None: ...

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [tuple(r[n] for n in self.names()) for r in rows]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(r[0] for r in fresh) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= passed * 1000]
        rest = rows[len(ready) :]
        if ready:
            (self.waiting.put(rest) if rest else self.waiting.clear())
            if rest:
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            self.begin(key)
            for r in ready:
                yield from self.take(key, Row(*self.names())(*r))
            self.end(key)
            self.last.update((ready[-1][0],))
            if self.keep:
                self.handle.registerTimer(ready[-1][0] // 1000 + self.keep)
        elif self.keep and not rest and self.last.exists() and self.last.get()[0] // 1000 + self.keep <= passed:
            self.forget()
            self.last.clear()

    def close(self) -> None: ...


class _Ledger(Ordered):
    """State: each address's balance and what it holds of the key's seed (held, exposed, hops)."""

    row = "at long, id string, senders array<string>, sent array<long>, receivers array<string>, received array<long>"

    def __init__(self, decay: float, seeds: list[str]):
        self.decay, self.seeds = decay, set(seeds)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.purses = handle.getMapState("purses", "address string", "sats long, held double, exposed double, hops int")

    def begin(self, key: tuple) -> None:
        self.near: dict[str, list] = {}  # purses that the released rows touch; written back at their end

    def _purse(self, address: str) -> list:
        if address not in self.near:
            self.near[address] = list(self.purses.getValue((address,))) if self.purses.containsKey((address,)) else [0, 0.0, 0.0, 0]
        return self.near[address]

    def take(self, key: tuple, row: Row) -> Iterator[Row]:
        seed, mass, way = key[0], 0.0, 0
        for address, amount in zip(row.senders, row.sent, strict=True):
            purse = self._purse(address)
            had, purse[0] = purse[0], max(0, purse[0] - amount)
            if address in self.seeds:
                if address == seed:
                    mass, way = mass + amount, 0
            elif (taken := purse[1] * (amount / max(had, amount, 1))) > 0:
                purse[1] -= taken
                mass, way = mass + taken, purse[3]
        total = max(sum(row.sent), 1)
        for address, amount in zip(row.receivers, row.received, strict=True):
            purse = self._purse(address)
            purse[0] += amount
            if address not in self.seeds and (gain := mass * (amount / total * self.decay)) > 0:
                purse[3] = min(purse[3], way + 1) if purse[2] > 0 else way + 1
                purse[1] += gain
                purse[2] += gain
                yield Row("seed", "txid", "at", "address", "gain", "exposed", "hops")(seed, row.id, row.at, address, gain, purse[2], purse[3])

    def end(self, key: tuple) -> None:
        for address, purse in self.near.items():
            self.purses.updateValue((address,), tuple(purse))
        self.near = {}


def ledger_taint(transactions: DataFrame, seeds: list[str], decay: float = 0.9, late: str = "1 hour") -> DataFrame:
    """seed, txid, at, address, gain, exposed, hops: what each transaction passes on of each seed's money.

    ``transactions`` is a stream of (timestamp, txid, inputs, outputs), the last two arrays of (address, amount). Seeds
    are a setting; every transaction goes to each of them, as each seed has a ledger of its own. What seeds receive isn't
    traced further.
    """
    timed = transactions.withWatermark("timestamp", late)
    sides = [F.col("inputs.address").alias("senders"), F.transform("inputs", lambda p: p["amount"].cast("long")).alias("sent"), F.col("outputs.address").alias("receivers"), F.transform("outputs", lambda p: p["amount"].cast("long")).alias("received")]
    rows = timed.select(F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"), "timestamp", F.unix_micros("timestamp").alias("at"), F.col("txid").cast("string").alias("id"), *sides)
    return rows.groupBy("seed").transformWithState(_Ledger(decay, seeds), "seed string, txid string, at long, address string, gain double, exposed double, hops int", "append", "eventTime")


class _Peel(Ordered):
    """State: the latest peeling spend of an address."""

    row = "at long, id string, next string"

    def __init__(self, keep: int):
        self.keep = keep

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.pointer = handle.getValueState("pointer", "txid string, next string")

    def take(self, key: tuple, row: Row) -> Iterator[Row]:
        if not self.pointer.exists() or tuple(self.pointer.get()) != (row.id, row.next):
            self.pointer.update((row.id, row.next))
            yield Row("address", "at", "txid", "next")(key[0], row.at, row.id, row.next)

    def forget(self) -> None:
        self.pointer.clear()


def peel_pointers(spends: DataFrame, late: str = "1 hour", keep_days: int = 0) -> DataFrame:
    """address, at, txid, next: where each address's latest peeling spend leads, told when it changes.

    ``spends`` is a stream of one-input two-output spends with a dominant output: timestamp, txid, address, next. After
    ``keep_days`` without one an address's state goes (0: never).
    """
    rows = spends.withWatermark("timestamp", late).select("address", "timestamp", F.unix_micros("timestamp").alias("at"), F.col("txid").cast("string").alias("id"), "next")
    return rows.groupBy("address").transformWithState(_Peel(keep_days * 86_400_000), "address string, at long, txid string, next string", "append", "eventTime")


class _Chain(Ordered):
    """State: number and head of a chain."""

    row = "at long, id string, payload string"

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq long, hash string")

    def begin(self, key: tuple) -> None:
        self.seq, self.hash = self.head.get() if self.head.exists() else (0, "0" * 64)

    def take(self, key: tuple, row: Row) -> Iterator[Row]:
        before, self.seq = self.hash, self.seq + 1
        self.hash = hashlib.sha256((before + row.payload).encode()).hexdigest()
        yield Row("chain", "seq", "payload", "prev_hash", "hash")(key[0], self.seq, row.payload, before, self.hash)

    def end(self, key: tuple) -> None:
        self.head.update((self.seq, self.hash))


def chained(events: DataFrame, chain: str = "chain", late: str = "1 hour") -> DataFrame:
    """chain, seq, payload, prev_hash, hash of a stream of (timestamp, id, payload), a chain for each value of ``chain``."""
    rows = events.withWatermark("timestamp", late).select(F.col(chain).cast("string").alias("chain"), "timestamp", F.unix_micros("timestamp").alias("at"), F.col("id").cast("string").alias("id"), "payload")
    return rows.groupBy("chain").transformWithState(_Chain(), "chain string, seq long, payload string, prev_hash string, hash string", "append", "eventTime")
