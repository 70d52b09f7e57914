"""Rules over address profiles: name, strength, reason, supporting txids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and strengths.
STRENGTHS = {"High fan-out": 0.55, "Rapid repeated spending": 0.65, "Repeated equal outputs": 0.35, "Peeling-chain pattern": 0.85, "Address reuse": 0.30, "CoinJoin-like shape": 0.35, "High fan-in": 0.55, "Address reuse after mixing pattern": 0.65}
REASONS = {
    "High fan-out": "Many outputs in one transaction; payouts by a service look alike.",
    "Rapid repeated spending": "Five or more spends with short gaps; automation has many honest uses.",
    "Repeated equal outputs": "Outputs of equal amounts recur; salaries do so too.",
    "Peeling-chain pattern": "Linked spends in time order, each with a dominant remainder; ordinary payments can chain so.",
    "Address reuse": "An output went to an address seen before, which by itself means little.",
    "CoinJoin-like shape": "Several inputs and three or more equal outputs; a privacy measure with honest uses.",
    "High fan-in": "Many inputs in one transaction; savings are gathered so.",
    "Address reuse after mixing pattern": "Spends again after a transaction of mixing shape; shared spending is another reading.",
}
LATE = "Address reuse after mixing pattern"


def _rule(name: str, when: Column, txids: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("name"), F.lit(STRENGTHS[name]).alias("strength"), F.lit(REASONS[name]).alias("reason"), F.array_sort(txids).alias("txids")))


def apply_rules(profiles: DataFrame, spent: DataFrame, peel: DataFrame, reused: DataFrame, mixers: DataFrame) -> DataFrame:
    """``profiles`` with rules (an array of structs) and rule_score, the strongest of them.

    The score is taken before the last rule is added: reuse after mixing supports a component of its own.
    """
    flagged = spent.select("address", "txid", "first_seen")
    for name, table in (("peel", peel), ("reused", reused), ("mixer", mixers)):
        flagged = flagged.join(table.select("txid", F.lit(True).alias(name)), "txid", "left")
    hit = lambda c: F.collect_list(F.when(F.col(c), F.col("txid")))
    per = flagged.groupBy("address").agg(
        F.collect_list("txid").alias("txids"), hit("peel").alias("peel_tx"), hit("reused").alias("reused_tx"), hit("mixer").alias("mixer_tx"),
        F.min(F.when(F.col("mixer"), F.col("first_seen"))).alias("mixed_at"), F.collect_list(F.struct("first_seen", "txid")).alias("timed"))
    rows = profiles.join(per, "address")
    later = F.transform(F.filter("timed", lambda t: t.first_seen > F.col("mixed_at")), lambda t: t.txid)
    gap = F.expm1("log_median_gap_seconds")
    early = F.array(
        _rule("High fan-out", F.col("max_fan_out") >= 8, F.col("txids")),
        _rule("Rapid repeated spending", (F.col("n") >= 5) & (F.round(gap, 6) <= 90), F.col("txids")),
        _rule("Repeated equal outputs", F.col("equal_output_fraction") >= 0.5, F.col("txids")),
        _rule("Peeling-chain pattern", F.size("peel_tx") > 0, F.col("peel_tx")),
        _rule("Address reuse", F.size("reused_tx") > 0, F.col("reused_tx")),
        _rule("CoinJoin-like shape", F.size("mixer_tx") > 0, F.col("mixer_tx")),
        _rule("High fan-in", F.col("max_fan_in") >= 8, F.col("txids")))
    kept = F.filter(early, lambda r: r.isNotNull())
    last = F.filter(F.array(_rule(LATE, F.size(later) > 0, F.concat("mixer_tx", later))), lambda r: r.isNotNull())
    score = F.coalesce(F.array_max(F.transform(kept, lambda r: r.strength)), F.lit(0.0))
    return rows.select(*profiles.columns, score.alias("rule_score"), F.concat(kept, last).alias("rules"))


def reason_text(rules: Column) -> Column:
    names = F.array_join(F.transform(rules, lambda r: r["name"]), "; ")
    return F.coalesce(F.nullif(names, F.lit("")), F.lit("No rule fired; ranked by the anomaly and graph scores."))
