"""Reviews of alerts, stored in the case: a review is appended, a confirmed false positive changes the weights once.

Everything that a review does is one batch: the review's row, its audit rows, and where the weights change the new
weights and the alerts with the index computed anew. Detectors aren't run again, as no term's value depends on the
weights. Reviews outdate no alerts; imports and references do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.plans import index
from trailweave.sources.ingest import Case

_REVIEW = "id long, address string, status string, reason string, false_positive boolean, at timestamp"


def weights(case: Case) -> tuple[int, dict[str, float]]:
    """Version and weights that hold now."""
    rows = case.table("weights")
    if rows is None:
        return 1, dict(index.WEIGHTS)
    last = rows.agg(F.max("version")).first()[0]
    return last, {r.term: r.weight for r in rows.filter(F.col("version") == last).collect()}  # five rows


def review(case: Case, address: str, status: str, reason: str, false_positive: bool = False) -> dict:
    """Stores a review of an address's alert; tells whether the weights changed, and from what to what."""
    row = index.review(status, reason, false_positive)
    alerts, known = case.alerts(), case.table("reviews")
    one = None if alerts is None else alerts.filter(F.col("address") == address).select("subscores").first()
    if one is None:
        raise KeyError("the address has no scored profile")
    number = 1 if known is None else known.agg(F.max("id")).first()[0] + 1
    before = known is not None and not known.filter((F.col("address") == address) & F.col("false_positive")).isEmpty()
    version, old = weights(case)
    stored = case.spark.createDataFrame([(number, address, row["status"], row["reason"], false_positive, None)], _REVIEW).withColumn("at", F.current_timestamp())
    told = [{"event": "analyst_review", "address": address, "status": row["status"], "reason": row["reason"], "false_positive": false_positive}]
    tables, new, changed = {"reviews": stored}, old, false_positive and not before
    if changed:
        version, new = version + 1, index.feedback_weights(old, {k: one.subscores[k]["value"] for k in old})
        told.append({"event": "fracture_weight_update", "address": address, "before": old, "after": new, "version": version})
        tables["weights"] = case.spark.createDataFrame([(version, k, w) for k, w in new.items()], "version int, term string, weight double")
        tables["alerts"] = index.case_note(index.fracture_index(alerts, new))
    events = case.spark.createDataFrame([(i, json.dumps(e, sort_keys=True)) for i, e in enumerate(told)], "step int, payload string")
    case.publish("reviewed", tables | {"audit": case.audited(events, ["step"])})
    return {"weights_changed": changed, "weights_before": old, "weights_after": new, "version": version}


def alert_view(case: Case) -> DataFrame | None:
    """The alerts, ranked first to last, with the latest status and all reviews (status, reason, at) in order."""
    alerts, rows = case.alerts(), case.table("reviews")
    if alerts is None:
        return None
    if rows is None:
        return alerts.withColumn("reviews", F.array().cast("array<struct<status:string,reason:string,at:timestamp>>")).orderBy(F.desc("priority"), "address")
    listed = rows.groupBy("address").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "status", "reason", "at"))), lambda r: F.struct(r["status"].alias("status"), r["reason"].alias("reason"), r["at"].alias("at"))).alias("reviews"))
    out = index.with_reviews(alerts, rows).join(listed, "address", "left")
    return out.withColumn("reviews", F.coalesce("reviews", F.array().cast("array<struct<status:string,reason:string,at:timestamp>>"))).orderBy(F.desc("priority"), "address")

