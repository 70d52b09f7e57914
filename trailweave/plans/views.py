"""Views of a case: layered ego graph, evidence graph, alerts page, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.operators import context as cx
from trailweave.plans import index
from trailweave.session import written

BANDS = {"all": (None, None), "high": (60, None), "review": (30, 60), "low": (None, 30)}
EDGE = ("source", "target", "kind", "amount_sats", "certainty")


def summary(flows: DataFrame, transactions: DataFrame, observations: DataFrame, alerts: DataFrame, reviews: DataFrame) -> DataFrame:
    """The counts of a case in one row: tables, addresses, amounts, alerts by band and reviewed ones."""
    n = F.count(F.lit(1))
    parts = [
        flows.agg(F.count_distinct("address").alias("addresses"), (F.coalesce(F.sum(F.when(cx.is_output(), F.col("amount_sats"))), F.lit(0)) / 1e8).alias("output_btc"), F.count_if(cx.is_input()).alias("input_flows")),
        observations.agg(n.alias("observations"), F.count_distinct("txid").alias("observed_transactions")), transactions.agg(n.alias("transactions")),
        alerts.agg(F.count_if(band_is("high")).alias("high"), F.count_if(band_is("review")).alias("review")),
        alerts.join(reviews, "address", "left_semi").agg(F.count_distinct("address").alias("reviewed")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def hourly_counts(observations: DataFrame) -> DataFrame:
    """hour (text to the hour), n: observations by hour."""
    return observations.groupBy(F.date_format(F.date_trunc("hour", "timestamp"), "yyyy-MM-dd'T'HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def until(transactions: DataFrame, at: str) -> DataFrame:
    """Transactions seen by then."""
    return transactions.filter(F.col("first_seen") <= F.lit(at).cast("timestamp"))


def band_is(name: str) -> Column:
    """Whether ``priority`` lies in a band."""
    low, high = BANDS[name]
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("priority") > low)
    return inside & (F.col("priority") <= high) if high is not None else inside


def alerts_page(alerts: DataFrame, band: str = "all", text: str = "", limit: int = 20, offset: int = 0, status: str = "all", reviews: DataFrame | None = None) -> DataFrame:
    """A page of alerts by falling priority, 1 to 100 rows, each with the number of all that match (total) and its status."""
    reviewed = index.with_reviews(alerts, reviews) if reviews is not None else alerts.withColumn("status", F.col("status") if "status" in alerts.columns else F.lit("New"))
    hits = reviewed.filter(band_is(band))
    hits = hits.filter(F.instr("address", text) > 0) if text else hits
    hits = hits.filter(F.col("status") == status) if status != "all" else hits
    page = hits.orderBy(F.desc("priority"), "address").offset(max(0, offset)).limit(min(100, max(1, limit)))
    return page.join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total"))), F.lit(True)).orderBy(F.desc("priority"), "address")


def recent_audit(audit: DataFrame, rows: int = 30) -> DataFrame:
    """The last audit rows, the latest first."""
    return audit.orderBy(F.desc("seq")).limit(rows)


def quarantine_page(quarantine: DataFrame, rows: int = 100) -> DataFrame:
    """source_hash, ordinal and error of the first quarantined records."""
    return quarantine.orderBy("source_hash", "ordinal").limit(rows).select("source_hash", "ordinal", "error")


def ego_edges(flows: DataFrame, transactions: DataFrame, observations: DataFrame, address: str, layer: str = "fused", limit: int = 80, before: str | None = None, flows_per_tx: int = 40, observations_per_tx: int = 60) -> DataFrame:
    """Edges (source, target, kind, amount_sats, certainty) around an address, up to limits for each transaction.

    Observed relays never stand for ownership. The filter by address comes first, so all joins are of its
    transactions alone.
    """
    if layer not in ("fused", "chain", "network"):
        raise ValueError("layer is fused, chain or network")
    mine = flows.filter(F.col("address") == address).select("txid").distinct().join(transactions.select("txid", "first_seen"), "txid")
    if before:
        mine = until(mine, before)
    chosen = mine.orderBy("txid").limit(limit).select("txid")
    tx = F.concat(F.lit("tx:"), F.col("txid"))
    parts = []
    if layer != "network":
        order = Window.partitionBy("txid").orderBy((F.col("address") == address).desc(), "direction", "ordinal")
        near = flows.join(chosen, "txid", "left_semi").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= flows_per_tx)
        node = F.concat(F.lit("address:"), F.col("address"))
        parts.append(near.select(F.when(cx.is_input(), node).otherwise(tx).alias("source"), F.when(cx.is_input(), tx).otherwise(node).alias("target"), F.col("direction").alias("kind"), "amount_sats", F.lit("reported_transaction_metadata").alias("certainty")))
    else:
        parts.append(chosen.select(F.lit(f"address:{address}").alias("source"), tx.alias("target"), F.lit("transaction_context").alias("kind"), F.lit(None).cast("long").alias("amount_sats"), F.lit("reported_transaction_metadata").alias("certainty")))
    if layer != "chain":
        order = Window.partitionBy("txid").orderBy("timestamp", "id")
        seen = observations.join(chosen, "txid", "left_semi").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= observations_per_tx)
        roles = [("src_ip", "observed_source"), ("dst_ip", "observed_destination")]
        for column, kind in roles:
            if column in observations.columns:
                parts.append(seen.filter(F.col(column).isNotNull()).select(F.concat(F.lit("ip:"), F.col(column)).alias("source"), tx.alias("target"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("amount_sats"), F.lit("observed_relay_only").alias("certainty")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ego_context(flows: DataFrame, transactions: DataFrame, observations: DataFrame, address: str, window_s: int = 60, members: int = 20, associations: int = 20, changes: int = 10) -> DataFrame:
    """Edges of ``ego_edges``' columns that stand for hypotheses: members of the address's entity, relay associations, change candidates.

    Only the address's own cluster is walked, and associations and changes are sought among what its transactions touch.
    """
    member = cx.entity_of(flows, address).orderBy("address").limit(members)
    node = lambda c: F.concat(F.lit("address:"), F.col(c))
    none = F.lit(None).cast("long")
    touching = (F.col("source") == address) | (F.col("target") == address)
    seen = cx.observed_around(flows, observations, address)
    spent = flows.filter(cx.is_input()).join(written(seen.select("txid").distinct(), "associable"), "txid", "left_semi")
    related = cx.relay_associations(written(spent, "associable_inputs"), seen, window_s).filter(touching).orderBy("txid", "other_txid", "source", "target", "src_ip").limit(associations)
    change = cx.change_candidates(cx.around(flows.select("txid", "direction", "address"), address), transactions).filter(touching).orderBy("txid").limit(changes)
    parts = [
        member.select(F.col("entity_id").alias("source"), node("address").alias("target"), F.lit("candidate_member").alias("kind"), none.alias("amount_sats"), F.lit("heuristic_not_verified").alias("certainty")),
        related.select(node("source").alias("source"), node("target").alias("target"), F.lit("relay_association").alias("kind"), none.alias("amount_sats"), F.lit("weak_no_ownership_claim").alias("certainty")),
        change.select(node("source").alias("source"), node("target").alias("target"), F.lit("change_candidate").alias("kind"), none.alias("amount_sats"), F.lit("heuristic_not_merged").alias("certainty")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ego_totals(flows: DataFrame, transactions: DataFrame, observations: DataFrame, address: str, layer: str = "fused", limit: int = 80, before: str | None = None, flows_per_tx: int = 40, observations_per_tx: int = 60) -> DataFrame:
    """One row: how much of an address's graph the limits show, and whether they cut any of it off."""
    mine = flows.filter(F.col("address") == address).select("txid").distinct()
    timed = mine.join(transactions.select("txid", "first_seen"), "txid")
    chosen = (until(timed, before) if before else timed).orderBy("txid").limit(limit)
    cut = lambda rows, most: rows.join(chosen, "txid", "left_semi").groupBy("txid").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.least(F.col("n"), F.lit(most))), F.lit(0)).alias("shown"))
    parts = [
        mine.agg(F.count(F.lit(1)).alias("total_transactions")), chosen.agg(F.count(F.lit(1)).alias("shown_transactions"), F.min("first_seen").alias("time_min"), F.max("first_seen").alias("time_max")),
        cut(flows, flows_per_tx).select(F.col("total").alias("total_flows"), F.col("shown").alias("shown_flows")), cut(observations, observations_per_tx).select(F.col("total").alias("total_observations"), F.col("shown").alias("shown_observations")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))
    over = F.col("total_transactions") > F.col("shown_transactions")
    if layer != "network":
        over = over | (F.col("total_flows") > F.col("shown_flows"))
    if layer != "chain":
        over = over | (F.col("total_observations") > F.col("shown_observations"))
    return out.withColumns({"truncated": over, "ownership_claims": F.lit(0)})


def graph_nodes(edges: DataFrame) -> DataFrame:
    """id, kind, label of the ends of edges."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    head = F.substring_index("id", ":", 1)
    return ends.select("id", F.when(head == "tx", "transaction").otherwise(head).alias("kind"), F.expr("substring(id, instr(id, ':') + 1)").alias("label"))


def evidence_transactions(alerts: DataFrame, changes: DataFrame | None = None, tainted: DataFrame | None = None) -> DataFrame:
    """txids that support alerts (address, rules, txids); where nothing does, an alert's first.

    Support are the rules' transactions, those of ``changes`` in behaviour (address, txid, before_txids, after_txids) with
    the ones on both sides, and those on the paths of ``tainted`` (address, path).
    """
    support = alerts.select("address", F.explode(F.flatten(F.transform("rules", lambda r: r["txids"]))).alias("txid"))
    own = alerts.select("address").distinct()
    if changes is not None:
        around = F.concat(F.array("txid"), F.coalesce("before_txids", F.array().cast("array<string>")), F.coalesce("after_txids", F.array().cast("array<string>")))
        support = support.unionByName(changes.join(own, "address", "left_semi").select("address", F.explode(around).alias("txid")))
    if tainted is not None:
        support = support.unionByName(tainted.join(own, "address", "left_semi").select("address", F.explode("path").alias("txid")))
    bare = alerts.join(support.select("address").distinct(), "address", "left_anti").select(F.explode(F.slice("txids", 1, 1)).alias("txid"))
    return support.select("txid").unionByName(bare).distinct()


def evidence_edges(flows: DataFrame, observations: DataFrame, txids: DataFrame) -> DataFrame:
    """Edges of the supporting transactions with the first relay seen for each."""
    tx, node = F.concat(F.lit("tx:"), F.col("txid")), F.concat(F.lit("address:"), F.col("address"))
    own = flows.join(txids, "txid", "left_semi").select(F.when(cx.is_input(), node).otherwise(tx).alias("source"), F.when(cx.is_input(), tx).otherwise(node).alias("target"), F.col("direction").alias("kind"), "amount_sats")
    first = observations.filter("src_ip IS NOT NULL").join(txids, "txid", "left_semi").groupBy("txid").agg(F.min_by("src_ip", F.struct("timestamp", "id")).alias("src_ip"))
    return own.unionByName(first.select(F.concat(F.lit("ip:"), F.col("src_ip")).alias("source"), tx.alias("target"), F.lit("first_observed_relay").alias("kind"), F.lit(None).cast("long").alias("amount_sats")))


def violations(records: DataFrame, flows: DataFrame, transactions: DataFrame) -> DataFrame:
    """(kind, txid) where stored flows or times disagree with the records that they come from."""
    once = records.groupBy("txid").agg(F.any_value(F.struct("input_addresses", "input_sats", "output_addresses", "output_sats")).alias("c"), F.min("timestamp").alias("least"), F.count_distinct("chain").alias("chains"))
    sides = [once.select("txid", F.lit(s).alias("direction"), F.posexplode(F.arrays_zip(F.col(f"c.{s}_addresses").alias("address"), F.col(f"c.{s}_sats").alias("amount_sats"))).alias("ordinal", "x")) for s in ("input", "output")]
    wanted = sides[0].unionByName(sides[1]).select("txid", "direction", F.col("ordinal").cast("int").alias("ordinal"), "x.address", "x.amount_sats")
    key = ["txid", "direction", "ordinal", "address", "amount_sats"]
    bad_flows = wanted.select(key).exceptAll(flows.select(key)).unionAll(flows.select(key).exceptAll(wanted.select(key))).select(F.lit("flow").alias("kind"), "txid").distinct()
    times = once.join(transactions.select("txid", "first_seen"), "txid", "full").filter(~F.col("least").eqNullSafe(F.col("first_seen"))).select(F.lit("first_seen").alias("kind"), "txid")
    return bad_flows.unionAll(times).unionAll(once.filter("chains > 1").select(F.lit("chain").alias("kind"), "txid"))


def snapshot_digest(alerts: DataFrame) -> str:
    """Digest of a set of alerts: rows are hashed, and the four quarters of all hashes added up, so no task needs the whole."""
    rows = alerts.select(F.sha2(F.to_json(F.struct("address", "priority", "subscores"), {"ignoreNullFields": "false"}), 256).alias("h"))
    quarters = [F.sum(F.conv(F.substring("h", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.select(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.coalesce(q, F.lit("0")) for q in quarters]), 256)).first()[0]


def unproved(records: DataFrame, audit: DataFrame, digest: Column) -> DataFrame:
    """(kind, observation_id): stored records that the audit doesn't prove as they are, and proofs without a record."""
    kind = "event string, observation_id string, normalized_sha256 string, row long, source string"
    proofs = audit.select(F.from_json("payload", kind).alias("e")).select("e.*").filter("event = 'accepted'")
    both = records.select("observation_id", digest.alias("now"), "source_hash", "ordinal", F.lit(True).alias("stored")).join(proofs, "observation_id", "full")
    why = F.when(F.col("stored").isNull(), "audited record is missing").when(F.col("event").isNull(), "record without proof")
    why = why.when((F.col("now") != F.col("normalized_sha256")) | (F.col("source_hash") != F.col("source")) | (F.col("ordinal") != F.col("row")), "record or its provenance was altered")
    return both.withColumn("kind", why).filter("kind IS NOT NULL").select("kind", "observation_id")
