"""Patterns of a whole case: shapes of transactions, clusters, chains, distances and relay associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.session import written


def is_input() -> Column:
    return F.col("direction") == "input"


def is_output() -> Column:
    return F.col("direction") == "output"


def sides(flows: DataFrame) -> DataFrame:
    """address, kind: whether an address is among inputs, outputs or both. One aggregate gives intersection and both differences."""
    seen = flows.groupBy("address").agg(F.max(is_input()).alias("i"), F.max(is_output()).alias("o"))
    return seen.select("address", F.when(F.col("i") & F.col("o"), "both").when(F.col("i"), "inputs only").otherwise("outputs only").alias("kind"))


def transaction_shapes(flows: DataFrame) -> DataFrame:
    """Per txid: n_in, n_out, in_sats, out_sats, round_outs, most_equal (largest number of equal outputs), distinct_in.

    Equal amounts are counted first, so the second aggregate reads one row for each amount of a transaction.
    """
    sized = flows.groupBy("txid", "direction", "amount_sats").agg(F.count(F.lit(1)).alias("n"))
    amounts = sized.groupBy("txid").agg(
        F.coalesce(F.sum(F.when(is_input(), F.col("n"))), F.lit(0)).alias("n_in"),
        F.coalesce(F.sum(F.when(is_output(), F.col("n"))), F.lit(0)).alias("n_out"),
        F.coalesce(F.sum(F.when(is_input(), F.col("n") * F.col("amount_sats"))), F.lit(0)).alias("in_sats"),
        F.coalesce(F.sum(F.when(is_output(), F.col("n") * F.col("amount_sats"))), F.lit(0)).alias("out_sats"),
        F.coalesce(F.sum(F.when(is_output() & (F.col("amount_sats") % 1_000_000 == 0), F.col("n"))), F.lit(0)).alias("round_outs"),
        F.coalesce(F.max(F.when(is_output(), F.col("n"))), F.lit(0)).alias("most_equal"),
    )
    return amounts


def near_outputs(flows: DataFrame) -> DataFrame:
    """txids with three outputs within max(1, 1 %) of the least of them."""
    ordered = Window.partitionBy("txid").orderBy("amount_sats")
    return flows.filter(is_output()).withColumn("third", F.lead("amount_sats", 2).over(ordered)).filter(F.col("third") - F.col("amount_sats") <= F.greatest(F.lit(1.0), F.col("amount_sats") * 0.01)).select("txid").distinct()


def mixer_shapes(flows: DataFrame) -> DataFrame:
    """txids with over one distinct input and three outputs within max(1, 1 %) of the least of them."""
    many = flows.filter(is_input()).groupBy("txid").agg(F.count_distinct("address").alias("n")).filter("n > 1")
    return near_outputs(flows).join(many.select("txid"), "txid", "left_semi")


def appearances(flows: DataFrame, transactions: DataFrame) -> DataFrame:
    """``flows`` with first_seen and seen_before: whether the address is in an earlier transaction of the total order."""
    placed = flows.join(transactions.select("txid", "first_seen"), "txid")
    here = F.struct("first_seen", "txid")
    first = placed.groupBy("address").agg(F.min(here).alias("_first"))
    return placed.join(first, "address").withColumn("seen_before", F.col("_first") < here).drop("_first")


def change_candidates(flows: DataFrame, transactions: DataFrame) -> DataFrame:
    """txid, source, target of transactions with one input and two outputs, exactly one of them new and no input."""
    seen = appearances(flows, transactions)
    own = seen.filter(is_input()).select("txid", "address").distinct().withColumn("_own", F.lit(True))
    new = is_output() & ~F.col("seen_before") & F.col("_own").isNull()
    shaped = seen.join(own, ["txid", "address"], "left").groupBy("txid").agg(
        F.count_if(is_input()).alias("n_in"), F.count_if(is_output()).alias("n_out"), F.count_if(new).alias("n_new"),
        F.max(F.when(is_input(), F.col("address"))).alias("source"), F.max(F.when(new, F.col("address"))).alias("target"))
    return shaped.filter("n_in = 1 AND n_out = 2 AND n_new = 1").select("txid", "source", "target")


def reused(flows: DataFrame, transactions: DataFrame) -> DataFrame:
    """txids with an output address that an earlier transaction has."""
    return appearances(flows, transactions).filter(is_output() & F.col("seen_before")).select("txid").distinct()


def edges(flows: DataFrame) -> DataFrame:
    """Distinct (src, dst) from the inputs to the outputs of each transaction."""
    return flows.filter(is_input()).select("txid", F.col("address").alias("src")).distinct().join(flows.filter(is_output()).select("txid", F.col("address").alias("dst")).distinct(), "txid").select("src", "dst").distinct()


def degrees(flows: DataFrame) -> DataFrame:
    """address, out_degree, in_degree: distinct neighbours (an address that pays itself counts)."""
    return degrees_of(edges(flows))


def degrees_of(both: DataFrame) -> DataFrame:
    """``degrees`` from distinct edges (src, dst)."""
    out = both.groupBy(F.col("src").alias("address")).agg(F.count(F.lit(1)).alias("n_out"), F.lit(0).alias("n_in"))
    into = both.groupBy(F.col("dst").alias("address")).agg(F.lit(0).alias("n_out"), F.count(F.lit(1)).alias("n_in"))
    return out.unionByName(into).groupBy("address").agg(F.sum("n_out").alias("out_degree"), F.sum("n_in").alias("in_degree"))


def components(pairs: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for the nodes of ``pairs`` (a, b of any ordered type): the least node that each is connected with.

    Large-star and small-star contraction over written tables; every round is two aggregates and two joins.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    links = written(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}_0")
    before, turn = state(links), 0
    while before[0]:
        turn += 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct(), f"{label}_{turn}")
        if (after := state(links)) == before:
            break
        before = after
    tops = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)


def common_input_links(flows: DataFrame, most_inputs: int = 20) -> DataFrame:
    """(a, b): the least input of a transaction with each other one; mixer shapes and over ``most_inputs`` left out.

    Inputs are read and dealt by txid once, then the amounts of outputs: the least input and the number of inputs are
    windows, so inputs aren't joined with themselves.
    """
    inputs = flows.filter(is_input() & F.col("txid").isNotNull()).select("txid", "address").repartition("txid").distinct()
    whole = Window.partitionBy("txid")
    sized = inputs.withColumns({"a": F.min("address").over(whole), "_n": F.count(F.lit(1)).over(whole)}).filter(F.col("_n").between(2, most_inputs) & (F.col("address") != F.col("a")))
    return sized.join(near_outputs(flows), "txid", "left_anti").select("a", F.col("address").alias("b")).distinct()


def clusters(flows: DataFrame) -> DataFrame:
    """(address, root) of common-input clusters; every address is at least its own cluster."""
    found = components(common_input_links(flows), "clusters")
    return flows.select("address").distinct().join(found, F.col("address") == F.col("node"), "left").select("address", F.coalesce("root", "address").alias("root"))


def entities(flows: DataFrame) -> DataFrame:
    """(address, entity_id, n_members); an entity's id is a digest of its sorted members."""
    own = clusters(flows)
    named = own.groupBy("root").agg(F.array_sort(F.collect_list("address")).alias("members"))
    ids = named.select("root", F.concat(F.lit("entity:"), F.substring(F.sha2(F.array_join("members", "|"), 256), 1, 16)).alias("entity_id"), F.size("members").alias("n_members"))
    return own.join(ids, "root").select("address", "entity_id", "n_members")


def entity_of(flows: DataFrame, address: str) -> DataFrame:
    """(address, entity_id, n_members) of one address's entity alone: its cluster is walked from it, link by link of distance.

    The frontier is joined with the links each round, so no other cluster is labelled.
    """
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(common_input_links(flows).select(F.inline(turned)), "both_ways")
    frontier = reached = written(flows.filter(F.col("address") == address).select("address").limit(1), "member")
    turn = 0
    while not frontier.isEmpty():
        turn += 1
        near = links.join(frontier, F.col("a") == F.col("address"), "left_semi").select(F.col("b").alias("address")).distinct()
        frontier = written(near.join(reached, "address", "left_anti"), f"member_{turn}")
        reached = reached.unionByName(frontier)
    named = reached.agg(F.array_sort(F.collect_list("address")).alias("members"))
    ids = named.select(F.concat(F.lit("entity:"), F.substring(F.sha2(F.array_join("members", "|"), 256), 1, 16)).alias("entity_id"), F.size("members").alias("n_members"))
    return reached.crossJoin(F.broadcast(ids))  # one row


def around(flows: DataFrame, address: str) -> DataFrame:
    """All flows of the addresses in the transactions of ``address``: what tells their first appearance.

    What is sought is written at each step, so where it is small the flows are only read, not shuffled.
    """
    mine = written(flows.filter(F.col("address") == address).select("txid").distinct(), "around_txids")
    met = written(flows.join(mine, "txid", "left_semi").select("address").distinct(), "around_addresses")
    return written(flows.join(met, "address", "left_semi"), "around")


def observed_around(flows: DataFrame, observations: DataFrame, address: str) -> DataFrame:
    """All observations of the transactions that a source saw which saw one that ``address`` spends in: what tells those sources' first observations.

    What is sought is written at each step, as in ``around``.
    """
    mine = written(flows.filter(is_input() & (F.col("address") == address)).select("txid").distinct(), "spent_txids")
    sources = written(observations.join(mine, "txid", "left_semi").filter(F.col("src_ip").isNotNull()).select("src_ip").distinct(), "spent_sources")
    return written(observations.join(written(observations.join(sources, "src_ip", "left_semi").select("txid").distinct(), "seen_txids"), "txid", "left_semi"), "seen_around")


def peel_spends(flows: DataFrame, transactions: DataFrame, share: float = 0.7) -> DataFrame:
    """txid, address, next, first_seen of one-in two-out spends with a dominant output."""
    two = flows.groupBy("txid").agg(
        F.count_if(is_input()).alias("n_in"), F.count_if(is_output()).alias("n_out"), F.max(F.when(is_input(), F.col("address"))).alias("address"),
        F.max_by("address", F.when(is_output(), F.struct("amount_sats", -F.col("ordinal")))).alias("next"), F.max(F.when(is_output(), F.col("amount_sats"))).alias("most"),
        F.sum(F.when(is_output(), F.col("amount_sats"))).alias("total"))
    return two.filter(f"n_in = 1 AND n_out = 2 AND most / greatest(total, 1) >= {share}").join(transactions.select("txid", "first_seen"), "txid")


def peel_links(flows: DataFrame, transactions: DataFrame, share: float = 0.7) -> DataFrame:
    """address, next, txid, first_seen: where an address's last one-in two-out spend with a dominant output leads."""
    shaped = peel_spends(flows, transactions, share)
    return shaped.groupBy("address").agg(F.max_by(F.struct("next", "txid", "first_seen"), F.struct("first_seen", "txid")).alias("p")).select("address", "p.*")


def peel_chains(links: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """txids on a walk of at least ``least`` links, in time order, without revisits, at most ``most`` long."""
    links = written(links, "peel_links")
    step = links.select(F.col("address").alias("_at"), F.col("next").alias("_next"), F.col("txid").alias("_txid"), F.col("first_seen").alias("_time"))
    walk = links.select("address", F.col("next").alias("at"), F.col("first_seen").alias("time"), F.array("address").alias("visited"), F.array("txid").alias("path"))
    done = None
    for turn in range(1, most + 1):
        grown = walk.join(step, (walk["at"] == step["_at"]) & ~F.array_contains("visited", F.col("at")) & (F.col("_time") >= F.col("time")), "left")
        grown = written(grown, f"peel_{turn}")
        ended = grown.filter(F.col("_at").isNull() | (F.size("path") >= most)).filter(F.size("path") >= least).select(F.explode("path").alias("txid")).distinct()
        done = ended if done is None else done.unionByName(ended)
        walk = grown.filter(F.col("_at").isNotNull() & (F.size("path") < most)).select("address", F.col("_next").alias("at"), F.col("_time").alias("time"), F.concat("visited", F.array("at")).alias("visited"), F.concat("path", F.array("_txid")).alias("path"))
        if walk.isEmpty():
            break
    return done.distinct()


def seed_distances(out_edges: DataFrame, seeds: DataFrame, hops: int = 6, kept: bool = False) -> DataFrame:
    """(address, hops): least number of edges from any seed, up to ``hops``; a frontier joins the edges each round.

    The edges are written first, unless they are a table already (``kept``).
    """
    links = out_edges if kept else written(out_edges, "seed_edges")
    reached = written(seeds.select("address", F.lit(0).alias("hops")).distinct(), "seeds")
    frontier = reached
    for turn in range(1, hops + 1):
        new = frontier.join(links, frontier.address == links.src).select(F.col("dst").alias("address")).distinct().join(reached, "address", "left_anti").withColumn("hops", F.lit(turn))
        frontier = written(new, f"frontier_{turn}")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def first_observed(observations: DataFrame) -> DataFrame:
    """Distinct (txid, src_ip, timestamp) of the earliest observation of a transaction that has a source, ties kept."""
    seen = observations.filter(F.col("src_ip").isNotNull()).select("txid", "src_ip", "timestamp")
    earliest = seen.groupBy("txid").agg(F.min("timestamp").alias("timestamp"))
    return seen.join(earliest, ["txid", "timestamp"], "left_semi").select("txid", "src_ip", "timestamp").distinct()


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def relay_pairs(observations: DataFrame, window_s: int = 60, hub_limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(src_ip, txid, other_txid, delta_seconds) of first observations by one source within a window; and the hubs left out.

    A source of over ``hub_limit`` transactions is a hub. Time is cut into bins as wide as the window, so the join's
    key is (source, bin) and a source's pairs are never compared beyond neighbouring bins.
    """
    first = first_observed(observations)
    counted = first.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
    hubs = counted.filter(F.col("n") > hub_limit)
    kept = first.join(counted.filter(F.col("n") <= hub_limit).select("src_ip"), "src_ip").withColumn("t", _micros(F.col("timestamp")))
    width = max(1, window_s) * 1_000_000
    left = kept.select("src_ip", "txid", "t", F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) + 1)).alias("bin"))
    right = kept.select(F.col("src_ip").alias("src_ip"), F.col("txid").alias("other_txid"), F.col("t").alias("t2"), F.floor(F.col("t") / width).alias("bin"))
    later = (F.col("t2") > F.col("t")) | ((F.col("t2") == F.col("t")) & (F.col("other_txid") > F.col("txid")))
    pairs = left.join(right, ["src_ip", "bin"]).filter(later & (F.col("t2") - F.col("t") <= width)).select("src_ip", "txid", "other_txid", ((F.col("t2") - F.col("t")) / 1e6).alias("delta_seconds"))
    return pairs, hubs


def relay_associations(flows: DataFrame, observations: DataFrame, window_s: int = 60, hub_limit: int = 20) -> DataFrame:
    """source, target, src_ip, txid, other_txid, delta_seconds: inputs of two transactions that one source relayed first.

    Inputs that occur twice in a transaction give two rows; an association claims no ownership.
    """
    pairs, _ = relay_pairs(observations, window_s, hub_limit)
    inputs = flows.filter(is_input())
    source = inputs.select("txid", F.col("address").alias("source"))
    target = inputs.select(F.col("txid").alias("other_txid"), F.col("address").alias("target"))
    return pairs.join(source, "txid").join(target, "other_txid").filter("source <> target").select("source", "target", "src_ip", "txid", "other_txid", "delta_seconds").withColumn("ownership_claim", F.lit(False))
