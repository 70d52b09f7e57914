"""Features of every address that spends: one row per input address, in aggregates over all addresses at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.operators.context import degrees_of, edges, is_input, relay_associations, seed_distances, transaction_shapes
from trailweave.schema import SATS
from trailweave.session import written

CHAIN = ("log_tx_count", "log_total_btc", "log_mean_btc", "amount_variation", "max_fan_out", "max_fan_in", "log_median_gap_seconds", "mean_fee_ratio", "equal_output_fraction")
EXTRA = ("in_degree", "out_degree", "seed_hop_distance", "seed_evidence_available", "round_output_ratio", "interval_entropy", "hour_concentration", "fee_rate_cv", "fee_rate_available")
NETWORK = ("mean_observations_per_tx", "mean_source_ips_per_tx", "log_relay_span_seconds", "network_coverage", "mean_source_transaction_degree")
#: The vector's order.
FEATURES = (*CHAIN, *EXTRA, *NETWORK, "relay_associations")
NO_GAP, UNREACHED = 86_400.0, 7
#: Powers of two of seconds that gaps are counted by; the last also takes what is beyond (a million years).
GAP_BINS = 46


def spends(flows: DataFrame, transactions: DataFrame) -> DataFrame:
    """(address, txid) of inputs, once each, with the transaction's columns and shape.

    Flows are dealt by txid first: the counts of equal amounts, the shapes, the distinct inputs and the joins all keep to
    that partitioning.
    """
    dealt = flows.repartition("txid")
    mine = dealt.filter(is_input()).select("address", "txid").distinct()
    shaped = transactions.join(transaction_shapes(dealt), "txid")
    return mine.join(shaped, "txid")


def placed(spent: DataFrame) -> DataFrame:
    """``spent`` with place, the number of the spend among those of its address, in the total order of time and txid."""
    return spent.withColumn("place", F.row_number().over(Window.partitionBy("address").orderBy("first_seen", "txid")).cast("long"))


def gaps(spent: DataFrame) -> DataFrame:
    """``spent`` with gap, the seconds since the address's spend before."""
    order = Window.partitionBy("address").orderBy("first_seen", "txid")
    micros = F.unix_micros(F.col("first_seen").cast("timestamp"))
    return spent.withColumn("gap", (micros - F.lag(micros).over(order)) / 1e6)


def _chain_parts() -> dict[str, Column]:
    total, n = F.sum("out_sats"), F.count(F.lit(1))
    fee = F.coalesce(F.col("fee_sats"), F.col("in_sats") - F.col("out_sats"))
    return {
        "n": n, "log_tx_count": F.log1p(n), "log_total_btc": F.log1p(total / SATS), "log_mean_btc": F.log1p(total / n / SATS),
        "amount_variation": F.coalesce(F.stddev_pop("out_sats"), F.lit(0.0)) / SATS / F.greatest(total / n / SATS, F.lit(1e-12)),
        "max_fan_out": F.max("n_out").cast("double"), "max_fan_in": F.max("n_in").cast("double"), "log_median_gap_seconds": F.log1p(F.coalesce(F.median("gap"), F.lit(NO_GAP))),
        "mean_fee_ratio": F.avg(fee / F.greatest(F.lit(1), F.col("in_sats"))), "equal_output_fraction": F.avg((F.col("most_equal") >= 3).cast("double")),
    }


def _counts(of: Column, values: int) -> Column:
    """How often a whole number takes each value from 0: one conditional count for each, so no second aggregate is needed."""
    return F.array(*[F.count_if(of == i) for i in range(values)])


def _timing_parts() -> dict[str, Column]:
    rate = F.when(F.col("vsize") > 0, F.coalesce(F.col("fee_sats"), F.col("in_sats") - F.col("out_sats")) / F.col("vsize"))
    bins = F.when(F.col("gap").isNotNull(), F.least(F.floor(F.log2(F.greatest(F.lit(1.0), F.col("gap")))), F.lit(GAP_BINS - 1)))
    return {
        "_bins": _counts(bins, GAP_BINS), "_hours": _counts(F.hour("first_seen"), 24), "_gaps": F.count("gap"), "_n": F.count(F.lit(1)),
        "round_output_ratio": F.sum("round_outs") / F.greatest(F.lit(1), F.sum("n_out")),
        "fee_rate_cv": F.coalesce(F.stddev_pop(rate) / F.greatest(F.avg(rate), F.lit(1e-8)), F.lit(0.0)), "fee_rate_available": (F.count(rate) > 0).cast("int"),
    }


def _timed(rows: DataFrame) -> DataFrame:
    """Entropy of the gaps' powers of two and share of the busiest hour, from the counts."""
    share = lambda k: k / F.greatest(F.col("_gaps"), F.lit(1))
    entropy = F.aggregate("_bins", F.lit(0.0), lambda total, k: F.when(k > 0, total - share(k) * F.log2(share(k))).otherwise(total))
    return rows.withColumns({"interval_entropy": entropy, "hour_concentration": F.array_max("_hours") / F.col("_n")}).drop("_bins", "_hours", "_gaps", "_n")


def chain_features(spent: DataFrame) -> DataFrame:
    """The nine chain features and n (transactions). Sums are of whole satoshis, divided last."""
    return gaps(spent).groupBy("address").agg(*[c.alias(n) for n, c in _chain_parts().items()])


def timing_features(spent: DataFrame) -> DataFrame:
    """interval_entropy, hour_concentration, round_output_ratio, fee_rate_cv and fee_rate_available."""
    return _timed(gaps(spent).groupBy("address").agg(*[c.alias(n) for n, c in _timing_parts().items()]))


def history_features(spent: DataFrame) -> DataFrame:
    """Chain and timing features in one aggregate over each address's ordered spends."""
    return _timed(gaps(spent).groupBy("address").agg(*[c.alias(n) for n, c in (_chain_parts() | _timing_parts()).items()]))


def hour_histogram(spent: DataFrame) -> DataFrame:
    """address, hour_histogram: 24 counts of spends by hour."""
    per = spent.groupBy("address", F.hour("first_seen").alias("hour")).agg(F.count(F.lit(1)).alias("k"))
    held = per.groupBy("address").agg(F.map_from_entries(F.collect_list(F.struct("hour", "k"))).alias("m"))
    return held.select("address", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at("m", h), F.lit(0))).alias("hour_histogram"))


def source_degrees(observations: DataFrame) -> DataFrame:
    """src_ip, degree: distinct transactions."""
    return observations.filter(F.col("src_ip").isNotNull()).groupBy("src_ip").agg(F.count_distinct("txid").alias("degree"))


def network_features(spent: DataFrame, observations: DataFrame) -> DataFrame:
    """The five network features; observations are summed up by transaction before they meet the addresses."""
    seen = observations.filter(F.col("src_ip").isNotNull()).join(source_degrees(observations), "src_ip")
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    per_tx = seen.groupBy("txid").agg(F.count(F.lit(1)).alias("obs"), F.count_distinct("src_ip").alias("ips"), ((F.max(micros) - F.min(micros)) / 1e6).alias("span"), F.sum("degree").alias("degree_sum"))
    rows = spent.select("address", "txid").join(per_tx, "txid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy("address").agg(
        F.avg(zero(F.col("obs"))).alias("mean_observations_per_tx"), F.avg(zero(F.col("ips"))).alias("mean_source_ips_per_tx"), F.log1p(F.avg(zero(F.col("span")))).alias("log_relay_span_seconds"),
        F.avg(F.col("obs").isNotNull().cast("double")).alias("network_coverage"), F.coalesce(F.log1p(F.sum("degree_sum") / F.sum("obs")), F.lit(0.0)).alias("mean_source_transaction_degree"))


def evidence(spent: DataFrame, observations: DataFrame, hub_limit: int = 20) -> DataFrame:
    """address, network_coverage, geo_coverage, script_missing, shared_relay, first_seen, last_seen, total_btc: how complete the observations are.

    Observations are summed up by transaction before they meet the addresses.
    """
    seen = observations.filter(F.col("src_ip").isNotNull()).join(source_degrees(observations), "src_ip")
    located = (F.col("geo_country").isNotNull() | F.col("asn").isNotNull()).cast("long")
    per_tx = seen.groupBy("txid").agg(F.count(F.lit(1)).alias("obs"), F.sum(located).alias("located"), F.max("degree").alias("degree"))
    rows = spent.join(per_tx, "txid", "left")
    return rows.groupBy("address").agg(
        F.avg(F.col("obs").isNotNull().cast("double")).alias("network_coverage"), (F.coalesce(F.sum("located"), F.lit(0)) / F.greatest(F.coalesce(F.sum("obs"), F.lit(0)), F.lit(1))).alias("geo_coverage"),
        F.avg(F.col("script_type").isNull().cast("double")).alias("script_missing"), F.coalesce(F.max("degree") > hub_limit, F.lit(False)).alias("shared_relay"),
        F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("last_seen"), (F.sum("out_sats") / SATS).alias("total_btc"))


def profiles(flows: DataFrame, transactions: DataFrame, observations: DataFrame, seeds: DataFrame | None = None, window_s: int = 60, hub_limit: int = 20, spent: DataFrame | None = None) -> DataFrame:
    """address with all features and n; ``spent`` are the ``spends``, where they are written already.

    Spends are written once, as several features are made of them; so are edges where seeds are followed along them.
    """
    spent = written(spends(flows, transactions), "profile_spends") if spent is None else spent
    linking = edges(flows) if seeds is None else written(edges(flows), "profile_edges")
    linked = relay_associations(flows, observations, window_s, hub_limit)
    touched = linked.select(F.explode(F.array("source", "target")).alias("address")).groupBy("address").agg(F.count(F.lit(1)).cast("double").alias("relay_associations"))
    out = history_features(spent).join(degrees_of(linking), "address", "left").join(network_features(spent, observations), "address").join(touched, "address", "left")
    if seeds is not None:
        out = out.join(seed_distances(linking, seeds, kept=True), "address", "left")
    else:
        out = out.withColumn("hops", F.lit(None).cast("int"))
    out = out.withColumns({"seed_hop_distance": F.coalesce("hops", F.lit(UNREACHED)), "seed_evidence_available": F.lit(int(seeds is not None)), "in_degree": F.coalesce("in_degree", F.lit(0)), "out_degree": F.coalesce("out_degree", F.lit(0)), "relay_associations": F.coalesce("relay_associations", F.lit(0.0))})
    return out.select("address", "n", *[F.col(c).cast("double").alias(c) for c in FEATURES])
