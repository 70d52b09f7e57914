"""The five-term weighted index: component values, priority, bands, notes. A priority is a triage score, no probability."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.operators.rules import LATE, reason_text

#: Weights of the terms, decay of taint by hop and rate of feedback.
WEIGHTS = {"taint": 0.25, "behavioral_link": 0.20, "timing": 0.20, "address_reuse": 0.20, "network_exposure": 0.15}
DECAY, FEEDBACK_RATE = 0.9, 0.15
HIGH, MIDDLE = 60, 30
STATES = ("New", "Triaging", "Escalated", "Dismissed")


def check_config(weights: dict[str, float], decay: float) -> None:
    """Refuses weights and decays that would take the index out of 0 to 100."""
    if missing := WEIGHTS.keys() ^ weights.keys():
        raise ValueError(f"weights must be of the five terms: {sorted(missing)}")
    for term, weight in weights.items():
        if not 0 <= weight < math.inf:
            raise ValueError(f"the weight of {term} must be finite and nonnegative")
    if not math.isclose(math.fsum(weights.values()), 1, rel_tol=0, abs_tol=1e-6):
        raise ValueError("weights must sum to 1")
    if decay > 1 or not decay > 0:
        raise ValueError("decay must be above 0 and at most 1")


def band(priority: Column, middle: str = "Moderate") -> Column:
    return F.when(priority > HIGH, "High").when(priority > MIDDLE, middle).otherwise("Low")


def component_values() -> dict[str, Column]:
    """Of a row with taint, fused_percentile, graph_score, rule_score, drift_score, log_median_gap_seconds, rules, relay_associations, network_coverage; null where there is no evidence."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pace = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("log_median_gap_seconds") / math.log1p(3600)))
    return {
        "taint": F.col("taint"),
        "behavioral_link": F.greatest(zero("fused_percentile"), zero("graph_score"), zero("rule_score"), zero("drift_score")),
        "timing": F.greatest(pace, zero("drift_score")),
        "address_reuse": F.exists("rules", lambda r: r["name"].isin("Address reuse", LATE)).cast("double"),
        "network_exposure": F.when(F.col("network_coverage") > 0, F.least(F.lit(1.0), F.least(F.col("relay_associations"), F.lit(50.0)) / 3)),
    }


def fracture_index(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``rows`` with subscores, priority (0 to 100), bands, component_coverage and reason."""
    check_config(weights, DECAY)
    values = component_values()
    score = F.round(100 * sum(F.coalesce(values[k], F.lit(0.0)) * w for k, w in weights.items()), 2)
    coverage = sum(F.when(values[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items())
    out = rows.withColumns({"subscores": F.struct(*[F.struct(values[k].alias("value"), F.lit(w).alias("weight")).alias(k) for k, w in weights.items()]), "priority": score, "component_coverage": coverage})
    return out.withColumns({"confidence_band": band(F.col("priority")), "priority_band": band(F.col("priority"), "Review"), "confidence_scope": F.lit("A band of scores, not calibrated certainty"), "reason": reason_text(F.col("rules")), "status": F.lit("New")})


def evidence_quality(network_coverage: Column, script_missing: Column) -> Column:
    """Completeness, 0 to 100."""
    return F.round(100 * (0.65 + 0.25 * network_coverage + 0.10 * (1 - script_missing)), 1)


def caveats(has_network: Column, geo_complete: Column, shared_relay: Column) -> Column:
    texts = [F.lit("Patterns have lawful explanations."), F.lit("Amounts are of whole transactions."), F.when(~has_network, "Network evidence is incomplete."), F.when(~geo_complete, "Places and networks of sources are incomplete."), F.when(shared_relay, "A source relays for many transactions."), F.lit("Entity membership is a revisable heuristic; change and relay candidates are not merged.")]
    return F.filter(F.array(*texts), lambda t: t.isNotNull())


def case_note(rows: DataFrame) -> DataFrame:
    """``rows`` (address, n, priority, confidence_band, taint, rules) with case_note."""
    parts = F.array(
        F.format_string("Address %s spends in %d observed transactions.", F.col("address"), F.col("n")), F.format_string("Its index is %.2f of 100 (%s band).", F.col("priority"), F.col("confidence_band")),
        F.when(F.col("taint").isNull(), "No seed references were given.").when(F.col("taint") > 0, F.format_string("Its decayed exposure to seeds is %.1f%%, by proportional accounting.", F.col("taint") * 100)),
        F.when(F.size("rules") > 0, F.concat(F.lit("Patterns: "), F.array_join(F.transform("rules", lambda r: r["name"]), ", "), F.lit("."))), F.lit("Relay associations and patterns establish neither ownership nor crime."))
    return rows.withColumn("case_note", F.array_join(F.filter(parts, lambda p: p.isNotNull()), " "))


def feedback_weights(weights: dict[str, float], values: dict[str, float | None], rate: float = FEEDBACK_RATE) -> dict[str, float]:
    """Weights after a confirmed false positive: terms that spoke loudest lose most, and all are normalised again."""
    cut = {k: max(0.01, w * math.exp(-rate * (values.get(k) or 0))) for k, w in weights.items()}
    return {k: v / sum(cut.values()) for k, v in cut.items()}


def review(status: str, reason: str, false_positive: bool = False) -> dict:
    """A row for the table of reviews, checked."""
    if status not in STATES or len(reason.strip()) < 5:
        raise ValueError("a known state and a reason of five characters are needed")
    if false_positive and status != "Dismissed":
        raise ValueError("a confirmed false positive must be dismissed")
    return {"status": status, "reason": reason.strip(), "false_positive": false_positive}


def with_reviews(alerts: DataFrame, reviews: DataFrame) -> DataFrame:
    """``alerts`` with the latest review's status (reviews: id, address, status), New without one."""
    last = reviews.groupBy("address").agg(F.max_by("status", "id").alias("_status"))
    return alerts.join(last, "address", "left").withColumn("status", F.coalesce("_status", F.lit("New"))).drop("_status")


def feature_drift(rows: DataFrame, names: list[str], center: dict[str, float], scale: dict[str, float], least: float = 0.2) -> DataFrame:
    """feature, share of rows with |z| over 3, for features where it is over ``least``."""
    far = rows.agg(*[F.avg((F.abs((F.col(c) - center[c]) / max(scale[c], 1e-12)) > 3).cast("double")).alias(c) for c in names])
    return far.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("feature", "share")).filter(F.col("share") > least)
