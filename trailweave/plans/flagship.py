"""Ranked profiles: features, rules and a rule score for every address that spends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators import context as cx
from trailweave.operators import features as ft
from trailweave.operators.rules import apply_rules, reason_text
from trailweave.plans.proxies import flows, transactions


def ranked_profiles(spark: SparkSession, sf_dir: str, top: int = 100) -> DataFrame:
    f, t = flows(spark, sf_dir), transactions(spark, sf_dir)
    spent = ft.spends(f, t)
    ruled = apply_rules(ft.chain_features(spent), spent, cx.peel_chains(cx.peel_links(f, t)), cx.reused(f, t), cx.mixer_shapes(f))
    return ruled.select("address", "n", *ft.CHAIN, "rule_score", reason_text(F.col("rules")).alias("reason")).orderBy(F.desc("rule_score"), F.desc("n"), "address").limit(top)
