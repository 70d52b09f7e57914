"""Registered queries over a case in which shapes and rules occur that the plain case of the tables lacks.

A third of the orders are merged into one transaction for four in a row, two addresses are in many of them, some others
pass on to one another, transactions are seconds apart, and half of the outputs have the same round amount. So there are
transactions of eight inputs and more, quick spends, equal and round outputs, mixer shapes and what follows them. All
rules fire but the peeling chain, which the plain case has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.operators import context as cx
from trailweave.operators import features as ft
from trailweave.operators import rules
from trailweave.plans import more_queries, queries
from trailweave.plans.proxies import FLOWS, TX, observations, table
from trailweave.session import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

MERGED_FLOWS = """p_named AS (
    SELECT CASE WHEN l_orderkey // 4 % 3 > 0 THEN l_orderkey ELSE 1000000000000 + l_orderkey // 4 END AS txid, CASE WHEN l_returnflag = 'R' THEN 'input' ELSE 'output' END AS direction,
           CASE WHEN l_returnflag = 'R' AND l_partkey % 97 < 40 THEN 'H' || l_partkey % 2 WHEN l_returnflag <> 'R' AND l_linestatus = 'O' AND l_suppkey % 3 = 0 THEN 'S' || l_suppkey WHEN l_partkey % 4 = 0 THEN 'B' || l_partkey % 149 ELSE 'A' || l_partkey END AS address,
           CASE WHEN l_returnflag <> 'R' AND l_partkey % 2 = 0 THEN 5000000 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS amount_sats, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
p_flows AS MATERIALIZED (
    SELECT txid, direction, CAST(row_number() OVER (PARTITION BY txid, direction ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, amount_sats) - 1 AS INTEGER) AS ordinal, address, amount_sats FROM p_named)"""
MERGED_TX = """p_tx AS (SELECT txid, TIMESTAMP '1997-03-01 05:00:00' + to_seconds(CASE WHEN txid >= 1000000000000 THEN 40 * (txid - 1000000000000) ELSE 10 * txid END) AS first_seen, CASE WHEN txid % 5 > 0 THEN CAST(140 + txid % 211 AS INTEGER) END AS vsize FROM (SELECT DISTINCT txid FROM p_named))"""


def merged_case(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flows and transactions of the merged case."""
    back, part = F.col("l_returnflag") == "R", F.col("l_partkey")
    name = lambda letter, value: F.concat(F.lit(letter), value.cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.floor(F.col("l_orderkey") / 4) % 3 > 0, F.col("l_orderkey")).otherwise(F.lit(10**12) + F.floor(F.col("l_orderkey") / 4)).cast("long").alias("txid"), F.when(back, "input").otherwise("output").alias("direction"),
        F.when(back & (part % 97 < 40), name("H", part % 2)).when(~back & (F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 3 == 0), name("S", F.col("l_suppkey"))).when(part % 4 == 0, name("B", part % 149)).otherwise(name("A", part)).alias("address"),
        F.when(~back & (part % 2 == 0), F.lit(5_000_000)).otherwise(F.round(F.col("l_extendedprice") * 100)).cast("long").alias("amount_sats"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = Window.partitionBy("txid", "direction").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount_sats")
    flows = written(rows.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int")).select("txid", "direction", "ordinal", "address", "amount_sats"), "merged_flows")
    txid = F.col("txid")
    first_seen = F.timestamp_seconds(F.unix_timestamp(F.lit("1997-03-01 05:00:00").cast("timestamp")) + F.when(txid >= 10**12, 40 * (txid - 10**12)).otherwise(10 * txid))
    transactions = flows.select("txid").distinct().select("txid", first_seen.alias("first_seen"), F.lit(None).cast("long").alias("fee_sats"), F.when(txid % 5 > 0, (140 + txid % 211).cast("int")).alias("vsize"))
    return flows, written(transactions, "merged_transactions")


def query(sql: str):
    """Registers a query with the SQL of another one over the merged case."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace(FLOWS, MERGED_FLOWS).replace(TX, MERGED_TX)
        return f

    return add


@query(more_queries.ORACLES["rule_flags"])
def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the merged case: seven fire."""
    f, t = merged_case(spark, sf_dir)
    spent = written(ft.spends(f, t), "merged_spends")
    ruled = rules.apply_rules(ft.profiles(f, t, observations(spark, sf_dir), spent=spent), spent, cx.peel_chains(cx.peel_links(f, t)), cx.reused(f, t), cx.mixer_shapes(f))
    return ruled.select("address", F.inline("rules"), "rule_score").select("address", F.col("name").alias("rule"), "strength", F.size("txids").cast("long").alias("txids"), "rule_score")


@query(queries.ORACLES["chain_features"])
def merged_chain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.chain_features(ft.spends(*merged_case(spark, sf_dir)))
    return out.select("address", "n", *[F.round(c, 6).alias(c) if not c.startswith("max") else F.col(c) for c in ft.CHAIN])


@query(queries.ORACLES["timing_features"])
def merged_timing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.timing_features(ft.spends(*merged_case(spark, sf_dir)))
    rate = F.when(F.abs("fee_rate_cv") < 1e6, F.round("fee_rate_cv", 6))
    return out.select("address", F.abs(F.round("interval_entropy", 6)).alias("interval_entropy"), F.round("hour_concentration", 6).alias("hour_concentration"), F.round("round_output_ratio", 6).alias("round_output_ratio"), rate.alias("fee_rate_cv"), "fee_rate_available")


@query(queries.ORACLES["mixer_shape"])
def merged_mixer_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.mixer_shapes(merged_case(spark, sf_dir)[0])


@query(queries.ORACLES["equal_outputs"])
def merged_equal_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.transaction_shapes(merged_case(spark, sf_dir)[0]).select("txid", "n_in", "n_out", "in_sats", "out_sats", "round_outs", "most_equal")
