"""Hash-chained audit trail: appended by an ordered fold, verified in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AUDIT = "seq long, payload string, prev_hash string, hash string"
ZERO = "0" * 64


def extend(events: DataFrame, order: list[str], payload: str = "payload", seq: int = 0, head: str = ZERO) -> DataFrame:
    """Audit rows of ``events`` in the given order after (seq, head).

    A hash covers the one before, so hashing is one ordered task, batch by batch; what makes the events is not part of it.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = seq, head
        for pdf in batches:
            rows = []
            for text in pdf["payload"]:
                at += 1
                own = hashlib.sha256((last + text).encode()).hexdigest()
                rows.append((at, text, last, own))
                last = own
            yield pd.DataFrame(rows, columns=["seq", "payload", "prev_hash", "hash"])

    narrow = events.select(*dict.fromkeys([*order, payload])).repartition(1).sortWithinPartitions(*order)
    return narrow.select(F.col(payload).alias("payload")).mapInPandas(fold, AUDIT)


def broken_links(audit: DataFrame) -> DataFrame:
    """Rows whose number, link or hash is wrong: every row is hashed anew, and compared with the row before it.

    A row's predecessor comes by its number, so the check is a join and needs no order over the whole table.
    """
    before = audit.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    rows = audit.join(before, "seq", "left")
    wanted = F.when(F.col("seq") == 1, ZERO).otherwise(F.col("before"))
    wrong = F.when(F.col("seq") > 1, F.col("before").isNull()).otherwise(F.col("seq") < 1)
    why = F.when(wrong, "missing predecessor").when(~F.col("prev_hash").eqNullSafe(wanted), "broken link").when(~F.col("hash").eqNullSafe(F.sha2(F.concat("prev_hash", "payload"), 256)), "altered payload")
    twice = F.count(F.lit(1)).over(Window.partitionBy("seq")) > 1
    return rows.withColumn("why", F.when(twice, "repeated number").otherwise(why)).filter("why IS NOT NULL").select("seq", "why")


def verify(audit: DataFrame, expected_head: str | None = None) -> dict:
    """Whether the chain holds, the first break, and the head."""
    first = broken_links(audit).orderBy("seq").limit(1).first()
    last = audit.agg(F.max_by("hash", "seq").alias("head"), F.count(F.lit(1)).alias("n")).first()
    head = last.head or ZERO
    return {"valid": first is None and expected_head in (None, head), "first_break": first.seq if first else None, "reason": first.why if first else None, "head": head, "rows": last.n}
