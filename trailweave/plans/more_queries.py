"""Registered queries of graph views, stateful operators, models and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.models import forest, learn
from trailweave.operators import context as cx
from trailweave.operators import drift, rules, taint
from trailweave.operators import features as ft
from trailweave.plans import audit, index, metrics, views
from trailweave.plans.proxies import FLOWS, OBS, TX, ego_case, flows, observations, seeds, table, transactions
from trailweave.plans.queries import ASSOCIATIONS, CHANGES, EDGES, FIRST, MIXERS, PEEL, SEEN, SHAPES
from trailweave.session import written

ENTITIES = """inputs AS (SELECT DISTINCT txid, address FROM p_flows WHERE direction = 'input'),
sized AS (SELECT txid, min(address) AS a FROM inputs WHERE txid NOT IN (SELECT txid FROM mixers) GROUP BY txid HAVING count(*) BETWEEN 2 AND 20),
links AS (SELECT DISTINCT a, address AS b FROM inputs JOIN sized USING (txid) WHERE address <> a), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
steps AS (SELECT a, b FROM both_ways UNION SELECT address, address FROM p_flows),
labels AS (SELECT DISTINCT address, address AS root, 0 AS it FROM p_flows UNION ALL SELECT w.b, min(l.root), max(it) + 1 FROM labels l JOIN steps w ON w.a = l.address WHERE it < 40 GROUP BY w.b),
roots AS (SELECT address, root FROM labels WHERE it = 40),
named AS (SELECT root, 'entity:' || substr(sha256(string_agg(address, '|' ORDER BY address)), 1, 16) AS entity_id, CAST(count(*) AS INTEGER) AS n_members FROM roots GROUP BY root)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH RECURSIVE {FLOWS}, {TX}, {OBS}, {MIXERS}, {ENTITIES}, {FIRST}, {ASSOCIATIONS}, {SEEN}, {CHANGES}, chosen AS (SELECT DISTINCT txid FROM p_flows JOIN p_tx USING (txid) WHERE address = 'A7' ORDER BY txid LIMIT 80),
near AS (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY (address = 'A7') DESC, direction, ordinal) AS n FROM p_flows WHERE txid IN (SELECT txid FROM chosen)),
obs AS (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY timestamp, id) AS n FROM p_obs WHERE txid IN (SELECT txid FROM chosen))
SELECT CASE WHEN direction = 'input' THEN 'address:' || address ELSE 'tx:' || txid END AS source, CASE WHEN direction = 'input' THEN 'tx:' || txid ELSE 'address:' || address END AS target, direction AS kind, amount_sats, 'reported_transaction_metadata' AS certainty FROM near WHERE n <= 40
UNION ALL SELECT DISTINCT 'ip:' || src_ip, 'tx:' || txid, 'observed_source', CAST(NULL AS BIGINT), 'observed_relay_only' FROM obs WHERE n <= 60
UNION ALL (SELECT entity_id, 'address:' || r.address, 'candidate_member', NULL, 'heuristic_not_verified' FROM roots r JOIN named USING (root) WHERE root = (SELECT root FROM roots WHERE address = 'A7') ORDER BY r.address LIMIT 20)
UNION ALL (SELECT 'address:' || source, 'address:' || target, 'relay_association', NULL, 'weak_no_ownership_claim' FROM assoc WHERE 'A7' IN (source, target) ORDER BY txid, other_txid, source, target, src_ip LIMIT 20)
UNION ALL (SELECT 'address:' || source, 'address:' || target, 'change_candidate', NULL, 'heuristic_not_merged' FROM changes WHERE 'A7' IN (source, target) ORDER BY txid LIMIT 10)""")
def ego_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, f, t, o = ego_case(spark, sf_dir, "A7")
    return views.ego_edges(own, t, o, "A7").unionByName(views.ego_context(f, t, o, "A7", window_s=604_800))


@query(f"""WITH {FLOWS}, {TX}, {OBS}, mine AS (SELECT DISTINCT txid, first_seen FROM p_flows JOIN p_tx USING (txid) WHERE address = 'A7'), chosen AS (SELECT * FROM mine ORDER BY txid LIMIT 20),
f AS (SELECT txid, count(*) AS n FROM p_flows WHERE txid IN (SELECT txid FROM chosen) GROUP BY txid), o AS (SELECT txid, count(*) AS n FROM p_obs WHERE txid IN (SELECT txid FROM chosen) GROUP BY txid),
t AS (SELECT (SELECT count(*) FROM mine) AS total_transactions, (SELECT count(*) FROM chosen) AS shown_transactions, (SELECT strftime(min(first_seen), '%Y-%m-%d') FROM chosen) AS time_min, (SELECT strftime(max(first_seen), '%Y-%m-%d') FROM chosen) AS time_max,
      (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM f) AS total_flows, (SELECT CAST(coalesce(sum(least(n, 4)), 0) AS BIGINT) FROM f) AS shown_flows, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM o) AS total_observations, (SELECT CAST(coalesce(sum(least(n, 60)), 0) AS BIGINT) FROM o) AS shown_observations)
SELECT *, total_transactions > shown_transactions OR total_flows > shown_flows OR total_observations > shown_observations AS truncated, 0 AS ownership_claims FROM t""")
def ego_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.ego_totals(flows(spark, sf_dir), transactions(spark, sf_dir), observations(spark, sf_dir), "A7", limit=20, flows_per_tx=4)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("time_min", "time_max")})


@query(f"""WITH RECURSIVE {FLOWS}, {EDGES}, roots AS (SELECT DISTINCT address FROM p_flows WHERE direction = 'input' ORDER BY address LIMIT 3),
ends AS (SELECT dst AS address, count(*) AS funders FROM edges WHERE dst NOT IN (SELECT src FROM edges) GROUP BY dst HAVING count(*) >= 3),
walk AS (SELECT address AS root, address, 0 AS hops FROM roots UNION SELECT root, dst, hops + 1 FROM walk JOIN edges ON src = address WHERE hops < 6),
least_hops AS (SELECT root, address, min(hops) AS hops FROM walk GROUP BY ALL),
ranked AS (SELECT root, l.address AS endpoint, hops, round(least(0.75, 0.3 + funders * 0.02), 6) AS score, row_number() OVER (PARTITION BY root ORDER BY least(0.75, 0.3 + funders * 0.02) DESC, l.address) AS n FROM least_hops l JOIN ends ON ends.address = l.address WHERE hops > 0)
SELECT root AS address, endpoint, CAST(hops AS INTEGER) AS hops, CAST(score AS DOUBLE) AS score FROM ranked WHERE n <= 5""")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.endpoints(flows(spark, sf_dir), seeds(spark, sf_dir)).select("address", "endpoint", "hops", F.round("score", 6).alias("score"))




#: Taint in waves over spends, without hops.
WAVES = """seeds AS (SELECT DISTINCT address FROM p_flows WHERE direction = 'input' ORDER BY address LIMIT 3),
timed AS MATERIALIZED (SELECT f.*, first_seen, f.address IN (SELECT address FROM seeds) AS seed FROM p_flows f JOIN p_tx USING (txid)),
sums AS (SELECT *, coalesce(sum(CASE WHEN direction = 'input' THEN -amount_sats ELSE amount_sats END) OVER b, 0) AS s, coalesce(count(*) FILTER (direction = 'input') OVER b, 0) AS spent, count(*) FILTER (direction = 'input') OVER (PARTITION BY address) AS spends
         FROM timed WINDOW b AS (PARTITION BY address ORDER BY first_seen, txid, direction, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lows AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY address ORDER BY first_seen, txid, direction, ordinal ROWS UNBOUNDED PRECEDING)) AS balance FROM sums),
spends AS MATERIALIZED (SELECT address, spent + 1 AS k, txid, amount_sats, amount_sats::DOUBLE / greatest(balance, amount_sats, 1)::DOUBLE AS share, spent + 1 = spends AS last, seed FROM lows WHERE direction = 'input'),
totals AS (SELECT txid, greatest(sum(amount_sats), 1)::DOUBLE AS total FROM p_flows WHERE direction = 'input' GROUP BY txid),
outs AS MATERIALIZED (SELECT l.txid, address, CASE WHEN spent < spends THEN spent + 1 END AS k, amount_sats / total * 0.9 AS part FROM lows l JOIN totals t ON t.txid = l.txid WHERE direction = 'output' AND NOT seed),
steps AS MATERIALIZED (
    SELECT i.address AS a, i.k AS ka, o.address AS b, o.k AS kb, sum(i.share * o.part) AS w FROM spends i JOIN outs o ON o.txid = i.txid WHERE NOT i.seed AND o.k IS NOT NULL GROUP BY ALL
    UNION ALL SELECT address, k, address, k + 1, 1 - share FROM spends WHERE NOT seed AND NOT last),
begin AS (SELECT i.address AS seed, o.address, o.k, sum(i.amount_sats * o.part) AS mass FROM spends i JOIN outs o ON o.txid = i.txid WHERE i.seed GROUP BY ALL),
waves AS (SELECT seed, address, k, mass, 0 AS it FROM begin WHERE k IS NOT NULL
          UNION ALL SELECT v.seed, t.b, t.kb, sum(v.mass * t.w), max(it) + 1 FROM waves v JOIN steps t ON t.a = v.address AND t.ka = v.k GROUP BY v.seed, t.b, t.kb HAVING sum(v.mass * t.w) > 0),
at_spend AS (SELECT seed, address, k, sum(mass) AS mass FROM waves GROUP BY ALL),
gains AS (SELECT seed, address, mass FROM begin UNION ALL SELECT v.seed, o.address, v.mass * i.share * o.part FROM at_spend v JOIN spends i ON i.address = v.address AND i.k = v.k JOIN outs o ON o.txid = i.txid),
exposed AS (SELECT seed, address, sum(mass) AS exposed FROM gains WHERE mass > 0 GROUP BY ALL), got AS (SELECT address, sum(amount_sats)::DOUBLE AS received FROM p_flows WHERE direction = 'output' GROUP BY address)"""

#: The whole ledger, transaction by transaction: (address, seed) holds bal (of the address), held, exposed, hops and path; row '#' counts.
LEDGER = """seeds AS (SELECT DISTINCT address FROM p_flows WHERE direction = 'input' ORDER BY address LIMIT 3),
spending AS (SELECT txid, row_number() OVER (ORDER BY first_seen, txid) AS i FROM p_tx WHERE txid IN (SELECT txid FROM p_flows WHERE direction = 'input')),
timed AS (SELECT f.*, first_seen, CASE WHEN direction = 'input' THEN -amount_sats ELSE amount_sats END AS signed FROM p_flows f JOIN p_tx USING (txid)),
sums AS (SELECT *, coalesce(sum(signed) OVER (PARTITION BY address ORDER BY first_seen, txid, direction, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM timed),
shares AS (SELECT *, amount_sats::DOUBLE / greatest(s - least(0, min(s) OVER (PARTITION BY address ORDER BY first_seen, txid, direction, ordinal ROWS UNBOUNDED PRECEDING)), amount_sats, 1)::DOUBLE AS share FROM sums),
ins AS MATERIALIZED (SELECT i, txid, ordinal, address, amount_sats, share * coalesce(product(1 - share) OVER (PARTITION BY txid, address ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS share, product(1 - share) OVER (PARTITION BY txid, address) AS rest, address IN (SELECT address FROM seeds) AS seed, greatest(sum(amount_sats) OVER (PARTITION BY txid), 1) AS total FROM shares JOIN spending USING (txid) WHERE direction = 'input'),
outs AS MATERIALIZED (SELECT i, txid, address, amount_sats FROM shares JOIN spending USING (txid) WHERE direction = 'output' AND address NOT IN (SELECT address FROM seeds)),
steps AS MATERIALIZED (SELECT i, any_value(txid) AS txid, any_value(total)::DOUBLE AS total, list({'a': address, 'v': amount_sats::DOUBLE, 'share': share, 'rest': rest, 'seed': seed} ORDER BY ordinal) AS spent FROM ins GROUP BY i),
gets AS MATERIALIZED (SELECT i, list({'a': address, 'v': amount_sats::DOUBLE}) AS got FROM outs GROUP BY i)"""



@query(f"""WITH RECURSIVE {FLOWS}, {TX}, {LEDGER},
led(address, seed, held, exposed, hops, path, i) USING KEY (address, seed) AS (
    SELECT '#', '#', 0.0::DOUBLE, 0.0::DOUBLE, 0, [0]::BIGINT[], 0::BIGINT
    UNION
    SELECT * FROM (
        WITH nxt AS (SELECT s.* FROM steps s JOIN recurring.led c ON c.address = '#' AND s.i = c.i + 1),
        spent AS (SELECT n.i, txid, total, unnest(spent) AS p, generate_subscripts(spent, 1) AS o FROM nxt n),
        taken AS (
            SELECT p.a AS address, p.a AS seed, o, p.v AS amount, 0 AS hops, []::BIGINT[] AS path, NULL::DOUBLE AS kept, txid, total, spent.i AS i FROM spent WHERE p.seed
            UNION ALL SELECT p.a, l.seed, o, l.held * p.share, l.hops, l.path, l.held * p.rest, txid, total, spent.i FROM spent JOIN recurring.led l ON l.address = p.a WHERE NOT p.seed AND l.held * p.share > 0),
        moving AS (SELECT seed, sum(amount) AS mass, arg_max(hops, o) AS hops, arg_max(path, o) AS path, any_value(txid) AS txid, any_value(total) AS total, any_value(i) AS i FROM taken GROUP BY seed),
        gained AS (SELECT g.got.a AS address, m.seed, sum(g.got.v / m.total * 0.9 * m.mass) AS gain, any_value(m.hops) + 1 AS hops, list_append(any_value(m.path), any_value(m.txid)) AS path, any_value(m.i) AS i
                   FROM moving m JOIN (SELECT i, unnest(got) AS got FROM gets WHERE i IN (SELECT i FROM nxt)) g ON true GROUP BY g.got.a, m.seed HAVING sum(g.got.v / m.total * 0.9 * m.mass) > 0),
        kept AS (SELECT address, seed, min(kept) AS kept, any_value(i) AS i FROM taken WHERE kept IS NOT NULL GROUP BY address, seed),
        both_sides AS (SELECT coalesce(g.address, k.address) AS address, coalesce(g.seed, k.seed) AS seed, g.gain, g.hops, g.path, k.kept, coalesce(g.i, k.i) AS i FROM gained g FULL JOIN kept k ON g.address = k.address AND g.seed = k.seed)
        SELECT b.address, b.seed, coalesce(b.kept, l.held, 0) + coalesce(gain, 0), coalesce(l.exposed, 0) + coalesce(gain, 0), CASE WHEN l.hops IS NULL OR b.hops < l.hops THEN b.hops ELSE l.hops END, CASE WHEN l.hops IS NULL OR b.hops < l.hops THEN b.path ELSE l.path END, b.i
        FROM both_sides b LEFT JOIN recurring.led l ON l.address = b.address AND l.seed = b.seed
        UNION ALL SELECT '#', '#', 0, 0, 0, [0], i FROM nxt)),
got AS (SELECT address, sum(amount_sats)::DOUBLE AS received FROM p_flows WHERE direction = 'output' GROUP BY address)
SELECT address, seed, round(least(1.0, exposed / greatest(received, 1.0)), 6) AS fraction, received, hops, array_to_string(path, '>') AS path FROM led JOIN got USING (address) WHERE exposed > 0
UNION ALL SELECT DISTINCT address, address, 1.0, 0.0, 0, '' FROM ins WHERE seed""")
def taint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint of all seeds with hops and path; the SQL keeps the whole ledger transaction by transaction."""
    out = taint.haircut(flows(spark, sf_dir, together=True), transactions(spark, sf_dir), seeds(spark, sf_dir))
    return out.select("address", "seed", F.round("fraction", 6).alias("fraction"), "received", "hops", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {FLOWS}, {TX}, {WAVES}
SELECT address, seed, round(least(1.0, exposed / greatest(received, 1.0)), 6) AS fraction, received FROM exposed JOIN got USING (address)
UNION ALL SELECT DISTINCT address, address, 1.0, 0.0 FROM spends WHERE seed""")
def haircut_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.haircut(flows(spark, sf_dir, together=True), transactions(spark, sf_dir), seeds(spark, sf_dir)).select("address", "seed", F.round("fraction", 6).alias("fraction"), "received")


@query()
def behavioural_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.behavioural_drift(ft.spends(flows(spark, sf_dir), transactions(spark, sf_dir)))


@query(f"""WITH RECURSIVE {FLOWS}, {MIXERS}, {ENTITIES}
SELECT address, entity_id, n_members FROM roots JOIN named USING (root)""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.entities(flows(spark, sf_dir))




def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, t = flows(spark, sf_dir), transactions(spark, sf_dir)
    spent = written(ft.spends(f, t), "spent")
    return rules.apply_rules(ft.profiles(f, t, observations(spark, sf_dir), spent=spent), spent, cx.peel_chains(cx.peel_links(f, t)), cx.reused(f, t), cx.mixer_shapes(f))


@query(f"""WITH RECURSIVE {FLOWS}, {TX}, {SHAPES}, {MIXERS}, {SEEN}, {PEEL}, links AS (SELECT address, p.next AS next, p.txid AS txid, p.t AS t FROM pointers),
walk AS (
    SELECT address, next AS spot, t, [address] AS visited, [txid] AS path FROM links
    UNION ALL SELECT w.address, l.next, l.t, list_append(visited, w.spot), list_append(path, l.txid) FROM walk w JOIN links l ON l.address = w.spot WHERE NOT list_contains(visited, w.spot) AND l.t >= w.t AND len(path) < 30),
peeled AS (SELECT DISTINCT unnest(path) AS txid FROM walk WHERE len(path) >= 3), reuse AS (SELECT DISTINCT txid FROM placed WHERE direction = 'output' AND seen_before),
marked AS (SELECT r.*, txid IN (SELECT txid FROM peeled) AS peel, txid IN (SELECT txid FROM reuse) AS reused, txid IN (SELECT txid FROM mixers) AS mixer FROM rows r),
mixed AS (SELECT *, min(first_seen) FILTER (mixer) OVER (PARTITION BY address) AS mixed_at FROM marked),
flags AS (SELECT address, count(*) >= 5 AND coalesce(median(gap), 86400.0) <= 90 AS rapid, max(n_out) >= 8 AS fan_out, max(n_in) >= 8 AS fan_in, avg(CASE WHEN most_equal >= 3 THEN 1.0 ELSE 0.0 END) >= 0.5 AS equal_outs, count(*) AS n,
          count(*) FILTER (peel) AS peel_n, count(*) FILTER (reused) AS reused_n, count(*) FILTER (mixer) AS mixer_n, count(*) FILTER (first_seen > mixed_at) AS later_n FROM mixed GROUP BY address),
listed AS (SELECT address, unnest([
    {{'rule': CASE WHEN fan_out THEN 'High fan-out' END, 'strength': 0.55, 'txids': n}}, {{'rule': CASE WHEN rapid THEN 'Rapid repeated spending' END, 'strength': 0.65, 'txids': n}}, {{'rule': CASE WHEN equal_outs THEN 'Repeated equal outputs' END, 'strength': 0.35, 'txids': n}},
    {{'rule': CASE WHEN peel_n > 0 THEN 'Peeling-chain pattern' END, 'strength': 0.85, 'txids': peel_n}}, {{'rule': CASE WHEN reused_n > 0 THEN 'Address reuse' END, 'strength': 0.30, 'txids': reused_n}}, {{'rule': CASE WHEN mixer_n > 0 THEN 'CoinJoin-like shape' END, 'strength': 0.35, 'txids': mixer_n}},
    {{'rule': CASE WHEN fan_in THEN 'High fan-in' END, 'strength': 0.55, 'txids': n}}, {{'rule': CASE WHEN mixer_n > 0 AND later_n > 0 THEN 'Address reuse after mixing pattern' END, 'strength': 0.65, 'txids': mixer_n + later_n}}]) AS r FROM flags)
SELECT address, r.rule AS rule, CAST(r.strength AS DOUBLE) AS strength, r.txids AS txids, CAST(coalesce(max(r.strength) FILTER (r.rule <> 'Address reuse after mixing pattern') OVER (PARTITION BY address), 0) AS DOUBLE) AS rule_score FROM listed WHERE r.rule IS NOT NULL""")
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight rules: a row for each that an address shows, the number of its supporting transactions, and the score."""
    return _ruled(spark, sf_dir).select("address", F.inline("rules"), "rule_score").select("address", F.col("name").alias("rule"), "strength", F.size("txids").cast("long").alias("txids"), "rule_score")


@query(f"""WITH RECURSIVE {FLOWS}, {TX}, {OBS}, {FIRST}, {ASSOCIATIONS}, {EDGES}, {SHAPES}, start AS (SELECT DISTINCT address FROM p_flows WHERE direction = 'input' ORDER BY address DESC LIMIT 2),
hopped AS (SELECT address, 0 AS hops FROM start UNION SELECT dst, hops + 1 FROM hopped JOIN edges ON src = address WHERE hops < 6), near AS (SELECT address, min(hops) AS hops FROM hopped GROUP BY address),
ends AS (SELECT address, count(*) AS k FROM (SELECT source AS address FROM assoc UNION ALL SELECT target FROM assoc) GROUP BY address), hits AS (SELECT address, count(*) AS n FROM rows GROUP BY address)
SELECT address, CAST(n AS BIGINT) AS n, CAST(coalesce(hops, 7) AS DOUBLE) AS seed_hop_distance, CAST(1 AS DOUBLE) AS seed_evidence_available, CAST(coalesce(k, 0) AS DOUBLE) AS relay_associations,
       CAST(coalesce((SELECT count(*) FROM edges e WHERE e.src = hits.address), 0) AS DOUBLE) AS out_degree, CAST(coalesce((SELECT count(*) FROM edges e WHERE e.dst = hits.address), 0) AS DOUBLE) AS in_degree
FROM hits LEFT JOIN near USING (address) LEFT JOIN ends USING (address)""")
def profile_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that come from an address's surroundings, seeds and associations included."""
    f, t = flows(spark, sf_dir), transactions(spark, sf_dir)
    last = f.filter(cx.is_input()).select("address").distinct().orderBy(F.desc("address")).limit(2)
    return ft.profiles(f, t, observations(spark, sf_dir), last, window_s=604_800).select("address", "n", "seed_hop_distance", "seed_evidence_available", "relay_associations", "out_degree", "in_degree")


def with_percentiles(scored: DataFrame, column: str) -> DataFrame:
    """``scored`` with ``column`` + '_percentile', the share of all its rows at or below each score."""
    values = scored.select(F.col(column).alias("v"))
    ranks = metrics.percentile_ranks(values.distinct().withColumn("id", F.lit(0)), values).select(F.col("v").alias(column), F.col("percentile").alias(f"{column}_percentile"))
    return scored.drop(f"{column}_percentile").join(ranks, column)


@query()
def fracture_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest, drift and rules in the weighted index, ranked."""
    ruled = written(_ruled(spark, sf_dir), "ruled")
    names = list(ft.FEATURES)
    grown = forest.fit(ruled, names)
    scored = with_percentiles(written(forest.score(ruled, grown, "fused"), "scored"), "fused")
    moved = drift.behavioural_drift(ft.spends(flows(spark, sf_dir), transactions(spark, sf_dir))).groupBy("address").agg(F.max("score").alias("drift_score"))
    rows = scored.join(moved, "address", "left").withColumns({"taint": F.lit(None).cast("double"), "graph_score": F.lit(None).cast("double")})
    out = index.case_note(index.fracture_index(rows))
    return out.select("address", "n", "fused", "fused_percentile", "rule_score", "drift_score", "priority", "priority_band", "component_coverage", "reason", "case_note").orderBy(F.desc("priority"), "address")


@query()
def behaviour_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ft.chain_features(ft.spends(flows(spark, sf_dir), transactions(spark, sf_dir)))
    return learn.behaviour_groups(rows, list(ft.CHAIN), seeds=2).select("address", "behavior_group")


@query(f"""WITH {OBS}, ordered AS (SELECT src_ip, timestamp, CASE WHEN epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY src_ip ORDER BY timestamp, id) < 3600000000 THEN 0 ELSE 1 END AS starts, id FROM p_obs),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY src_ip ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS s FROM ordered)
SELECT src_ip, epoch_us(min(timestamp)) AS start_micros, count(*) AS n FROM numbered GROUP BY src_ip, s""")
def relay_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observations(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out = seen.groupBy("src_ip", F.session_window("timestamp", "1 hour").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("src_ip", F.unix_micros("s.start").alias("start_micros"), "n")


@query("""WITH s AS (SELECT l.toxic AS label, CASE WHEN d.lang IS NULL THEN 'none' ELSE d.lang END AS scenario, CAST(n_chars AS DOUBLE) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
benign AS (SELECT count(*) FILTER (score > 3000) AS benign_over FROM s WHERE label = 0)
SELECT scenario, label, count(*) AS n, CASE WHEN label = 1 THEN round(count(*) FILTER (score > 3000) / count(*), 9) END AS recall,
       CASE WHEN label = 1 THEN round(count(*) FILTER (score > 3000) / greatest(1, count(*) FILTER (score > 3000) + any_value(benign_over)), 9) END AS precision,
       CASE WHEN label = 0 THEN round(count(*) FILTER (score > 3000) / count(*), 9) END AS fpr FROM s, benign GROUP BY scenario, label""")
def scenario_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.plans.metrics import by_scenario

    scored = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"), F.coalesce("lang", F.lit("none")).alias("scenario"))
    out = by_scenario(scored, 3000.0)
    return out.select("scenario", "label", "n", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "fpr")])


@query(f"""WITH {FLOWS} SELECT txid, address, amount_sats, printf('%d.%08d', amount_sats // 100000000, amount_sats % 100000000) AS btc FROM p_flows""")
def btc_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.sources.references import btc

    return flows(spark, sf_dir).select("txid", "address", "amount_sats", btc(F.col("amount_sats")).alias("btc"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey AS value FROM customer), z AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, median(c_acctbal) AS med FROM customer)
SELECT c_custkey AS id, round((c_acctbal - m) / s, 6) AS z, abs((c_acctbal - m) / s) > 1.5 AS far, round(med, 6) AS median FROM customer, z""")
def feature_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    middle, mean, std = learn.scales(rows, ["c_acctbal"])["c_acctbal"]
    z = (F.col("c_acctbal") - mean) / std
    return rows.select(F.col("c_custkey").alias("id"), F.round(z, 6).alias("z"), (F.abs(z) > 1.5).alias("far"), F.round(F.lit(middle), 6).alias("median"))


@query(f"""WITH {FLOWS} SELECT address, round(median(amount_sats), 3) AS amount, round(median(ordinal), 3) AS place FROM p_flows GROUP BY address""")
def exact_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median amount and place of each address's flows; addresses of over 32 flows (at sf0.01 all) go through the rounds on bits."""
    from trailweave.functions.selection import medians

    rows = flows(spark, sf_dir).select("address", F.col("amount_sats").alias("amount"), F.col("ordinal").alias("place"))
    return medians(rows, ["amount", "place"], "address", most=32).select("address", F.round("amount", 3).alias("amount"), F.round("place", 3).alias("place"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir)
    linked = cx.relay_associations(f, observations(spark, sf_dir), window_s=604_800)
    lists = learn.neighbour_lists(cx.clusters(f).withColumnRenamed("root", "entity_id"), linked)
    return lists.select("address", F.posexplode("neighbours").alias("place", "neighbour")).select("address", "neighbour", (F.col("place") + 1).alias("place"))


@query(f"""WITH RECURSIVE {FLOWS}, {MIXERS}, {ENTITIES}, {OBS}, {FIRST},
kept AS (SELECT * FROM first_obs WHERE src_ip IN (SELECT src_ip FROM first_obs GROUP BY src_ip HAVING count(*) <= 20)),
pairs AS (SELECT a.txid AS t1, b.txid AS t2 FROM kept a JOIN kept b ON a.src_ip = b.src_ip AND (b.timestamp > a.timestamp OR (b.timestamp = a.timestamp AND b.txid > a.txid)) AND epoch_us(b.timestamp) - epoch_us(a.timestamp) <= 604800000000),
assoc AS (SELECT s.address AS x, t.address AS y FROM pairs JOIN inputs s ON s.txid = t1 JOIN inputs t ON t.txid = t2 WHERE s.address <> t.address),
near AS (SELECT a.address AS address, b.address AS other FROM roots a JOIN roots b ON a.root = b.root AND a.address <> b.address UNION SELECT x, y FROM assoc UNION SELECT y, x FROM assoc)
SELECT address, other AS neighbour, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY other) AS n FROM near) WHERE n <= 16""")
def neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir)




@query("""SELECT o_custkey AS actor, o_orderkey AS txid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders""")
def ordered_spends(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("address"), F.col("o_orderkey").alias("txid"), F.col("o_orderdate").alias("first_seen"))
    return ft.placed(spent).select(F.col("address").alias("actor"), "txid", "place")
