"""Streaming forms of the time operators; each gives the rows of its batch form once the watermark has passed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, time: str = "timestamp", late: str = "2 hours") -> DataFrame:
    """hour, n: tumbling counts."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "n")


def sessions(events: DataFrame, key: str, gap: str = "10 minutes", time: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """key, start, end, n: runs of events without a longer gap."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_of_each(observations: DataFrame, late: str = "1 day") -> DataFrame:
    """Observations without repeats of an id."""
    return observations.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])


def relay_pairs(left: DataFrame, right: DataFrame, window: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Pairs of observations by one source within a window: a join of two streams with bounded state."""
    a = left.withWatermark("timestamp", late).alias("a")
    b = right.withWatermark("timestamp", late).alias("b")
    near = F.expr(f"a.src_ip = b.src_ip AND b.timestamp >= a.timestamp AND b.timestamp <= a.timestamp + INTERVAL {window} AND a.txid <> b.txid")
    return a.join(b, near).select(F.col("a.src_ip").alias("src_ip"), F.col("a.txid").alias("txid"), F.col("b.txid").alias("other_txid"), F.expr("unix_micros(b.timestamp) - unix_micros(a.timestamp)").alias("delta_micros"))


def first_seen(observations: DataFrame) -> DataFrame:
    """txid, first_seen: the least time so far, which a late observation lowers (for the update or complete mode)."""
    return observations.groupBy("txid").agg(F.min("timestamp").alias("first_seen"))


def running_gaps(events: DataFrame, key: str, most: float = 86_400.0, late: str = "1 hour", keep: str = "30 days") -> DataFrame:
    """key, timestamp, gap_seconds: events further than ``most`` from the key's event before, in the order of time.

    Events wait in a key's state until the watermark has passed them, so late ones take their place; what comes behind
    the watermark is dropped. A key's state goes once the watermark has passed its last event by ``keep``.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    hold = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        last, waiting = state.get if state.exists else (None, [])
        fresh = [] if state.hasTimedOut else [pdf["timestamp"].to_numpy("datetime64[us]").astype("int64") for pdf in batches]
        micros = np.sort(np.concatenate([np.array(waiting, np.int64), *fresh]))
        ready, rest = micros[micros <= passed * 1000], micros[micros > passed * 1000]
        if len(ready):
            gaps = np.diff(ready, prepend=ready[0] if last is None else last) / 1e6
            last, far = int(ready[-1]), gaps > most
            if far.any():
                yield pd.DataFrame({key: own[0], "timestamp": ready[far].astype("datetime64[us]"), "gap_seconds": gaps[far]})
        if not len(rest) and last is not None and last // 1000 + hold <= passed:
            state.remove()
            return
        state.update((last, rest.tolist()))
        state.setTimeoutTimestamp(max(passed + 1, int(rest[0]) // 1000 + 1 if len(rest) else last // 1000 + hold))

    kind = events.schema[key].dataType.simpleString()
    timed = events.select(key, "timestamp").withWatermark("timestamp", late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, timestamp timestamp, gap_seconds double", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def import_files(case, folder: str, **options):
    """A stream that imports every new file of a folder into a case; each import outdates the alerts scored before it."""
    from trailweave.sources.ingest import ingest

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.select("path").distinct().collect():  # new files of a trigger
            ingest(case, row.path, **options)

    files = case.spark.readStream.format("binaryFile").option("maxFilesPerTrigger", 16).schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")
    return files.writeStream.foreachBatch(each)
