"""Case tables made from the star-schema test tables, for queries that have no case of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.session import spread, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(spread(spark, f"{sf_dir}/{name}.parquet"))


def flows(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, together: bool = False) -> DataFrame:
    """Lines as inputs (returned) and outputs; with ``of`` (txid) those of these transactions alone, chosen before they are numbered.

    ``together`` is for those who join or group them by transaction next: they are dealt out by txid once, for that and for the numbers.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    if of is not None:
        lines = lines.join(of, F.col("l_orderkey") == F.col("txid"), "left_semi")
    back = F.col("l_returnflag") == "R"
    rows = lines.select(
        F.col("l_orderkey").alias("txid"), F.when(back, "input").otherwise("output").alias("direction"),
        F.when(~back & (F.col("l_linestatus") == "O"), F.concat(F.lit("S"), F.col("l_suppkey"))).otherwise(F.concat(F.lit("A"), F.col("l_partkey"))).alias("address"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_sats"), "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.repartition("txid") if together else rows
    order = Window.partitionBy("txid", "direction").orderBy("l_linenumber", "l_partkey", "l_suppkey", "amount_sats")
    return rows.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int")).select("txid", "direction", "ordinal", "address", "amount_sats")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txid"), F.col("o_orderdate").alias("first_seen"), F.lit(None).cast("long").alias("fee_sats"), F.when(F.col("o_orderkey") % 5 > 0, (140 + F.col("o_orderkey") % 211).cast("int")).alias("vsize"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("txid"), F.col("ts").alias("timestamp"), F.concat(F.lit("ip"), F.col("user_id")).alias("src_ip"))


def ego_case(spark: SparkSession, sf_dir: str, address: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(flows of the address's own transactions, all flows, transactions, observations): only the first need ordinals, so only they are numbered."""
    every = flows(spark, sf_dir).drop("ordinal")
    own = written(every.filter(F.col("address") == address).select("txid").distinct(), "ego_txids")
    return written(flows(spark, sf_dir, own), "ego_flows"), every, transactions(spark, sf_dir), written(observations(spark, sf_dir), "ego_observations")


def seeds(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The first k addresses of inputs."""
    return flows(spark, sf_dir).filter("direction = 'input'").select("address").distinct().orderBy("address").limit(k)


FLOWS = """p_lines AS (
    SELECT l_orderkey AS txid, CASE WHEN l_returnflag = 'R' THEN 'input' ELSE 'output' END AS direction,
           CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'O' THEN 'S' || l_suppkey ELSE 'A' || l_partkey END AS address,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_sats, l_linenumber, l_partkey, l_suppkey FROM lineitem),
p_flows AS MATERIALIZED (
    SELECT txid, direction, CAST(row_number() OVER (PARTITION BY txid, direction ORDER BY l_linenumber, l_partkey, l_suppkey, amount_sats) - 1 AS INTEGER) AS ordinal,
           address, amount_sats FROM p_lines)"""
TX = "p_tx AS (SELECT o_orderkey AS txid, o_orderdate AS first_seen, CASE WHEN o_orderkey % 5 > 0 THEN CAST(140 + o_orderkey % 211 AS INTEGER) END AS vsize FROM orders)"
OBS = "p_obs AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS txid, ts AS timestamp, 'ip' || user_id AS src_ip FROM events)"
