"""Registered queries of the engine over the proxy case, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.operators import context as cx
from trailweave.operators import features as ft
from trailweave.models import workflow
from trailweave.plans import audit, index, metrics, views
from trailweave.session import written
from trailweave.sources import ingest
from trailweave.plans.proxies import FLOWS, OBS, TX, flows, observations, seeds, table, transactions



def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as alerts."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("address"), (F.col("c_acctbal") / 100).alias("priority"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events but views as reviews of customers."""
    return table(spark, sf_dir, "events").filter("event_type <> 'view'").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("address"), F.col("event_type").alias("status"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SHAPES = """shapes AS (
    SELECT txid, count(*) FILTER (direction = 'input') AS n_in, count(*) FILTER (direction = 'output') AS n_out,
           coalesce(sum(amount_sats) FILTER (direction = 'input'), 0) AS in_sats, coalesce(sum(amount_sats) FILTER (direction = 'output'), 0) AS out_sats,
           count(*) FILTER (direction = 'output' AND amount_sats % 1000000 = 0) AS round_outs FROM p_flows GROUP BY txid),
equal_outs AS (SELECT txid, max(n) AS most_equal FROM (SELECT txid, amount_sats, count(*) AS n FROM p_flows WHERE direction = 'output' GROUP BY ALL) GROUP BY txid),
spent AS (SELECT DISTINCT address, txid FROM p_flows WHERE direction = 'input'),
rows AS (
    SELECT s.address, s.txid, t.first_seen, t.vsize, h.* EXCLUDE (txid), coalesce(e.most_equal, 0) AS most_equal,
           (epoch_us(t.first_seen) - lag(epoch_us(t.first_seen)) OVER (PARTITION BY s.address ORDER BY t.first_seen, s.txid)) / 1e6 AS gap
    FROM spent s JOIN p_tx t USING (txid) JOIN shapes h USING (txid) LEFT JOIN equal_outs e USING (txid))"""


@query(f"""WITH {FLOWS}, {TX}, {SHAPES}
SELECT address, count(*) AS n, CAST(round(ln(1 + count(*)), 6) AS DOUBLE) AS log_tx_count, round(ln(1 + sum(out_sats) / 1e8), 6) AS log_total_btc,
       round(ln(1 + sum(out_sats) / count(*) / 1e8), 6) AS log_mean_btc, round(stddev_pop(out_sats) / 1e8 / greatest(sum(out_sats) / count(*) / 1e8, 1e-12), 6) AS amount_variation,
       CAST(max(n_out) AS DOUBLE) AS max_fan_out, CAST(max(n_in) AS DOUBLE) AS max_fan_in, round(ln(1 + coalesce(median(gap), 86400.0)), 6) AS log_median_gap_seconds,
       round(avg((in_sats - out_sats) / greatest(1, in_sats)), 6) AS mean_fee_ratio, round(avg(CASE WHEN most_equal >= 3 THEN 1.0 ELSE 0.0 END), 6) AS equal_output_fraction
FROM rows GROUP BY address""")
def chain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.chain_features(ft.spends(flows(spark, sf_dir), transactions(spark, sf_dir)))
    return out.select("address", "n", *[F.round(c, 6).alias(c) if not c.startswith("max") else F.col(c) for c in ft.CHAIN])


@query(f"""WITH {FLOWS}, {TX}, {SHAPES},
bins AS (SELECT address, floor(log2(greatest(1.0, gap))) AS bin, count(*) AS k FROM rows WHERE gap IS NOT NULL GROUP BY ALL),
entropy AS (SELECT address, -sum(p * log2(p)) AS e FROM (SELECT address, k / sum(k) OVER (PARTITION BY address) AS p FROM bins) GROUP BY address),
hours AS (SELECT address, max(k) AS top FROM (SELECT address, hour(first_seen) AS h, count(*) AS k FROM rows GROUP BY ALL) GROUP BY address),
flat AS (SELECT address, count(*) AS n, sum(round_outs) / greatest(1, sum(n_out)) AS r, coalesce(stddev_pop((in_sats - out_sats)::DOUBLE / vsize) / greatest(avg((in_sats - out_sats)::DOUBLE / vsize), 1e-8), 0) AS cv, CAST(count(vsize) > 0 AS INTEGER) AS rated FROM rows GROUP BY address)
SELECT address, abs(round(coalesce(e, 0), 6)) AS interval_entropy, round(top / n, 6) AS hour_concentration, round(r, 6) AS round_output_ratio, CASE WHEN abs(cv) < 1e6 THEN round(cv, 6) END AS fee_rate_cv, rated AS fee_rate_available
FROM flat JOIN hours USING (address) LEFT JOIN entropy USING (address)""")
def timing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.timing_features(ft.spends(flows(spark, sf_dir), transactions(spark, sf_dir)))
    return out.select("address", F.abs(F.round("interval_entropy", 6)).alias("interval_entropy"), F.round("hour_concentration", 6).alias("hour_concentration"), F.round("round_output_ratio", 6).alias("round_output_ratio"), F.when(F.abs("fee_rate_cv") < 1e6, F.round("fee_rate_cv", 6)).alias("fee_rate_cv"), "fee_rate_available")


@query(f"""WITH {FLOWS}, {TX}, {OBS}, spent AS (SELECT DISTINCT address, txid FROM p_flows JOIN p_tx USING (txid) WHERE direction = 'input'),
deg AS (SELECT src_ip, count(DISTINCT txid) AS degree FROM p_obs WHERE src_ip IS NOT NULL GROUP BY src_ip),
per AS (SELECT txid, count(*) AS obs, count(DISTINCT src_ip) AS ips, (max(epoch_us(timestamp)) - min(epoch_us(timestamp))) / 1e6 AS span, sum(degree) AS ds FROM p_obs JOIN deg USING (src_ip) GROUP BY txid)
SELECT address, round(avg(coalesce(obs, 0)), 6) AS mean_observations_per_tx, round(avg(coalesce(ips, 0)), 6) AS mean_source_ips_per_tx, round(ln(1 + avg(coalesce(span, 0))), 6) AS log_relay_span_seconds,
       round(avg(CASE WHEN obs IS NULL THEN 0.0 ELSE 1.0 END), 6) AS network_coverage, round(coalesce(ln(1 + sum(ds) / sum(obs)), 0), 6) AS mean_source_transaction_degree
FROM spent LEFT JOIN per USING (txid) GROUP BY address""")
def network_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = ft.spends(flows(spark, sf_dir), transactions(spark, sf_dir))
    return ft.network_features(spent, observations(spark, sf_dir)).select("address", *[F.round(c, 6).alias(c) for c in ft.NETWORK])


@query(f"""WITH {FLOWS}, {OBS}
SELECT (SELECT count(*) FROM orders) AS transactions, (SELECT count(*) FROM p_obs) AS observations, (SELECT count(DISTINCT address) FROM p_flows) AS addresses,
       (SELECT count(DISTINCT txid) FROM p_obs) AS observed_transactions, (SELECT coalesce(sum(amount_sats), 0) / 1e8 FROM p_flows WHERE direction = 'output') AS output_btc,
       (SELECT count(*) FROM p_flows WHERE direction = 'input') AS input_flows, (SELECT count(*) FROM customer WHERE c_acctbal / 100 > 60) AS high, (SELECT count(*) FROM customer WHERE c_acctbal / 100 > 30 AND c_acctbal / 100 <= 60) AS review,
       (SELECT count(DISTINCT user_id) FROM events WHERE event_type <> 'view' AND user_id IN (SELECT c_custkey FROM customer)) AS reviewed""")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(flows(spark, sf_dir), transactions(spark, sf_dir), observations(spark, sf_dir), alerts(spark, sf_dir), reviews(spark, sf_dir))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.hourly_counts(observations(spark, sf_dir))


@query(f"WITH {FLOWS} SELECT txid, count(*) FILTER (direction = 'input') AS inputs, count(*) FILTER (direction = 'output') AS outputs FROM p_flows GROUP BY txid")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).groupBy("txid").agg(F.count_if(cx.is_input()).alias("inputs"), F.count_if(cx.is_output()).alias("outputs"))


@query(f"WITH {OBS} SELECT src_ip, count(DISTINCT txid) AS degree FROM p_obs WHERE src_ip IS NOT NULL GROUP BY src_ip")
def source_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.source_degrees(observations(spark, sf_dir))


@query(f"WITH {FLOWS}, {TX} SELECT txid, strftime(first_seen, '%Y-%m-%d') AS day FROM p_tx WHERE txid IN (SELECT DISTINCT txid FROM p_flows WHERE address LIKE 'A1%' AND direction = 'input')")
def spending_tx_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = flows(spark, sf_dir).filter(cx.is_input() & F.col("address").startswith("A1"))
    return transactions(spark, sf_dir).join(mine, "txid", "left_semi").select("txid", F.date_format("first_seen", "yyyy-MM-dd").alias("day"))


@query(f"WITH {FLOWS}, {TX} SELECT txid FROM p_tx WHERE NOT EXISTS (SELECT 1 FROM p_flows f WHERE f.txid = p_tx.txid)")
def orders_without_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).join(flows(spark, sf_dir), "txid", "left_anti").select("txid")


FIRST = "first_obs AS (SELECT DISTINCT txid, src_ip, timestamp FROM p_obs o WHERE src_ip IS NOT NULL AND timestamp = (SELECT min(timestamp) FROM p_obs i WHERE i.txid = o.txid AND i.src_ip IS NOT NULL))"


@query(f"WITH {OBS}, {FIRST} SELECT txid, src_ip, epoch_us(timestamp) AS micros FROM first_obs")
def first_observed_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.first_observed(observations(spark, sf_dir)).select("txid", "src_ip", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"))


ASSOCIATIONS = """kept AS (SELECT * FROM first_obs WHERE src_ip IN (SELECT src_ip FROM first_obs GROUP BY src_ip HAVING count(*) <= 20)),
pairs AS (SELECT a.src_ip, a.txid, b.txid AS other_txid FROM kept a JOIN kept b ON a.src_ip = b.src_ip AND (b.timestamp > a.timestamp OR (b.timestamp = a.timestamp AND b.txid > a.txid)) AND epoch_us(b.timestamp) - epoch_us(a.timestamp) <= 604800000000),
assoc AS (SELECT s.address AS source, t.address AS target, src_ip, p.txid AS txid, other_txid FROM pairs p JOIN p_flows s ON s.txid = p.txid AND s.direction = 'input' JOIN p_flows t ON t.txid = p.other_txid AND t.direction = 'input' WHERE s.address <> t.address)"""


@query(f"""WITH {FLOWS}, {OBS}, {FIRST}, kept AS (SELECT * FROM first_obs WHERE src_ip IN (SELECT src_ip FROM first_obs GROUP BY src_ip HAVING count(*) <= 20)),
pairs AS (SELECT a.src_ip, a.txid, b.txid AS other_txid, (epoch_us(b.timestamp) - epoch_us(a.timestamp)) / 1e6 AS delta_seconds FROM kept a JOIN kept b ON a.src_ip = b.src_ip
          AND (b.timestamp > a.timestamp OR (b.timestamp = a.timestamp AND b.txid > a.txid)) AND epoch_us(b.timestamp) - epoch_us(a.timestamp) <= 604800000000)
SELECT s.address AS source, t.address AS target, src_ip, p.txid AS txid, other_txid, round(delta_seconds, 6) AS delta_seconds
FROM pairs p JOIN p_flows s ON s.txid = p.txid AND s.direction = 'input' JOIN p_flows t ON t.txid = p.other_txid AND t.direction = 'input' WHERE s.address <> t.address""")
def relay_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cx.relay_associations(flows(spark, sf_dir), observations(spark, sf_dir), window_s=604_800)
    return out.select("source", "target", "src_ip", "txid", "other_txid", F.round("delta_seconds", 6).alias("delta_seconds"))


@query("""WITH last AS (SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'view') WHERE n = 1)
SELECT c_custkey AS case_id, coalesce(status, 'New') AS status FROM customer LEFT JOIN last ON user_id = c_custkey""")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_reviews(alerts(spark, sf_dir), reviews(spark, sf_dir)).select(F.col("address").cast("long").alias("case_id"), "status")


@query(f"""WITH {FLOWS} SELECT txid, direction, ordinal, address, amount_sats, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY txid ORDER BY (address = 'A1') DESC, direction, ordinal) AS place FROM p_flows) WHERE place <= 3""")
def flows_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("txid").orderBy((F.col("address") == "A1").desc(), "direction", "ordinal")
    return flows(spark, sf_dir).withColumn("place", F.row_number().over(order)).filter("place <= 3").select("txid", "direction", "ordinal", "address", "amount_sats", "place")


PAGE = """WITH last AS (SELECT user_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'view') WHERE n = 1),
hits AS (SELECT CAST(c_custkey AS VARCHAR) AS address, c_acctbal / 100 AS priority, coalesce(status, 'New') AS status FROM customer LEFT JOIN last ON user_id = c_custkey
         WHERE c_acctbal / 100 > 30 AND c_acctbal / 100 <= 60 AND instr(CAST(c_custkey AS VARCHAR), '1') > 0)"""


@query(f"{PAGE} SELECT address, priority, status, (SELECT count(*) FROM hits WHERE status = 'signup') AS total FROM hits WHERE status = 'signup' ORDER BY priority DESC, address LIMIT 10 OFFSET 1")
def ranked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.alerts_page(alerts(spark, sf_dir), "review", "1", 10, 1, status="signup", reviews=reviews(spark, sf_dir)).select("address", "priority", "status", "total")


@query("SELECT CAST(c_custkey AS VARCHAR) AS address, c_acctbal / 100 AS priority FROM customer ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 1")
def top_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.alerts_page(alerts(spark, sf_dir), limit=1).select("address", "priority")


@query(f"""WITH {FLOWS}, {TX}, {SHAPES} SELECT address, count(gap) AS n_gaps, round(median(gap), 6) AS median_gap, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap FROM rows GROUP BY address""")
def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ft.gaps(ft.spends(flows(spark, sf_dir), transactions(spark, sf_dir)))
    return rows.groupBy("address").agg(F.count("gap").alias("n_gaps"), F.round(F.median("gap"), 6).alias("median_gap"), F.round(F.min("gap"), 6).alias("min_gap"), F.round(F.max("gap"), 6).alias("max_gap"))


@query(f"WITH {FLOWS} SELECT address, round(stddev_pop(amount_sats) / greatest(sum(amount_sats) / count(*), 1e-12), 6) AS variation, round(stddev_pop(amount_sats), 2) AS spread FROM p_flows GROUP BY address")
def amount_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.sum("amount_sats") / F.count(F.lit(1))
    return flows(spark, sf_dir).groupBy("address").agg(F.round(F.stddev_pop("amount_sats") / F.greatest(mean, F.lit(1e-12)), 6).alias("variation"), F.round(F.stddev_pop("amount_sats"), 2).alias("spread"))


@query(f"WITH {FLOWS}, {TX}, {SHAPES} SELECT h.txid AS txid, n_in, n_out, CAST(in_sats AS BIGINT) AS in_sats, CAST(out_sats AS BIGINT) AS out_sats, round_outs, coalesce(most_equal, 0) AS most_equal FROM shapes h LEFT JOIN equal_outs USING (txid)")
def equal_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.transaction_shapes(flows(spark, sf_dir)).select("txid", "n_in", "n_out", "in_sats", "out_sats", "round_outs", "most_equal")


EDGES = "edges AS (SELECT DISTINCT s.address AS src, d.address AS dst FROM p_flows s JOIN p_flows d ON s.txid = d.txid AND s.direction = 'input' AND d.direction = 'output')"


@query(f"""WITH {FLOWS}, {EDGES}, o AS (SELECT src AS address, count(*) AS n FROM edges GROUP BY src), i AS (SELECT dst AS address, count(*) AS n FROM edges GROUP BY dst)
SELECT address, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM o FULL JOIN i USING (address)""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.degrees(flows(spark, sf_dir))


MIXERS = """mixers AS (
    SELECT DISTINCT txid FROM (SELECT txid, amount_sats, lead(amount_sats, 2) OVER (PARTITION BY txid ORDER BY amount_sats) AS third FROM p_flows WHERE direction = 'output')
    WHERE third - amount_sats <= greatest(1.0, amount_sats * 0.01::DOUBLE) AND txid IN (SELECT txid FROM p_flows WHERE direction = 'input' GROUP BY txid HAVING count(DISTINCT address) > 1))"""


@query(f"WITH {FLOWS}, {MIXERS} SELECT txid FROM mixers")
def mixer_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.mixer_shapes(flows(spark, sf_dir))


SEEN = """seen AS (SELECT p.*, first_seen, dense_rank() OVER (ORDER BY first_seen, txid) AS spot FROM p_flows p JOIN p_tx USING (txid)),
firsts AS (SELECT address, min(spot) AS first_at FROM seen GROUP BY address), placed AS (SELECT seen.*, first_at < spot AS seen_before FROM seen JOIN firsts USING (address))"""


CHANGES = """own AS (SELECT DISTINCT txid, address FROM placed WHERE direction = 'input'),
spent_shapes AS (SELECT p.txid AS txid, count(*) FILTER (direction = 'input') AS n_in, count(*) FILTER (direction = 'output') AS n_out, count(*) FILTER (direction = 'output' AND NOT seen_before AND own.txid IS NULL) AS n_new,
           max(p.address) FILTER (direction = 'input') AS source, max(p.address) FILTER (direction = 'output' AND NOT seen_before AND own.txid IS NULL) AS target
           FROM placed p LEFT JOIN own ON own.txid = p.txid AND own.address = p.address GROUP BY p.txid),
changes AS (SELECT txid, source, target FROM spent_shapes WHERE n_in = 1 AND n_out = 2 AND n_new = 1)"""


@query(f"""WITH {FLOWS}, {TX}, {SEEN}, own AS (SELECT DISTINCT txid, address FROM placed WHERE direction = 'input'),
shaped AS (SELECT p.txid AS txid, count(*) FILTER (direction = 'input') AS n_in, count(*) FILTER (direction = 'output') AS n_out, count(*) FILTER (direction = 'output' AND NOT seen_before AND own.txid IS NULL) AS n_new,
           max(p.address) FILTER (direction = 'input') AS source, max(p.address) FILTER (direction = 'output' AND NOT seen_before AND own.txid IS NULL) AS target
           FROM placed p LEFT JOIN own ON own.txid = p.txid AND own.address = p.address GROUP BY p.txid)
SELECT txid, source, target FROM shaped WHERE n_in = 1 AND n_out = 2 AND n_new = 1""")
def change_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.change_candidates(flows(spark, sf_dir), transactions(spark, sf_dir))


@query(f"WITH {FLOWS}, {TX}, {SEEN} SELECT DISTINCT txid FROM placed WHERE direction = 'output' AND seen_before")
def address_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.reused(flows(spark, sf_dir), transactions(spark, sf_dir))


PEEL = """two AS (
    SELECT txid, max(address) FILTER (direction = 'input') AS address, arg_max(address, struct_pack(a := amount_sats, o := -ordinal)) FILTER (direction = 'output') AS next,
           max(amount_sats) FILTER (direction = 'output') AS most, sum(amount_sats) FILTER (direction = 'output') AS total
    FROM p_flows GROUP BY txid HAVING count(*) FILTER (direction = 'input') = 1 AND count(*) FILTER (direction = 'output') = 2),
pointers AS (SELECT address, arg_max(struct_pack(next := next, txid := txid, t := first_seen), struct_pack(t := first_seen, x := txid)) AS p
             FROM two JOIN p_tx USING (txid) WHERE most / greatest(total, 1) >= 0.7 GROUP BY address)"""


@query(f"WITH {FLOWS}, {TX}, {PEEL} SELECT address, p.next AS next, p.txid AS txid FROM pointers")
def peel_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.peel_links(flows(spark, sf_dir), transactions(spark, sf_dir)).select("address", "next", "txid")


@query(f"""WITH RECURSIVE {FLOWS}, {TX}, {PEEL}, links AS (SELECT address, p.next AS next, p.txid AS txid, p.t AS t FROM pointers),
walk AS (
    SELECT address, next AS spot, t, [address] AS visited, [txid] AS path FROM links
    UNION ALL SELECT w.address, l.next, l.t, list_append(visited, w.spot), list_append(path, l.txid) FROM walk w JOIN links l ON l.address = w.spot
    WHERE NOT list_contains(visited, w.spot) AND l.t >= w.t AND len(path) < 30)
SELECT DISTINCT unnest(path) AS txid FROM walk WHERE len(path) >= 3""")
def peel_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.peel_chains(cx.peel_links(flows(spark, sf_dir), transactions(spark, sf_dir)))


@query(f"""WITH RECURSIVE {FLOWS}, {EDGES}, start AS (SELECT DISTINCT address FROM p_flows WHERE direction = 'input' ORDER BY address LIMIT 3),
walk AS (SELECT address, 0 AS hops FROM start UNION SELECT dst, hops + 1 FROM walk JOIN edges ON src = address WHERE hops < 6)
SELECT address, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY address""")
def seed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.seed_distances(cx.edges(flows(spark, sf_dir)), seeds(spark, sf_dir))




@query(f"""WITH RECURSIVE {FLOWS}, {MIXERS}, inputs AS (SELECT DISTINCT txid, address FROM p_flows WHERE direction = 'input'),
sized AS (SELECT txid, min(address) AS a FROM inputs WHERE txid NOT IN (SELECT txid FROM mixers) GROUP BY txid HAVING count(*) BETWEEN 2 AND 20),
links AS (SELECT DISTINCT a, address AS b FROM inputs JOIN sized USING (txid) WHERE address <> a), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
steps AS (SELECT a, b FROM both_ways UNION SELECT address, address FROM p_flows),
labels AS (SELECT DISTINCT address, address AS root, 0 AS it FROM p_flows UNION ALL SELECT w.b, min(l.root), max(it) + 1 FROM labels l JOIN steps w ON w.a = l.address WHERE it < 40 GROUP BY w.b)
SELECT address, root FROM labels WHERE it = 40""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.clusters(flows(spark, sf_dir))




@query("""SELECT CASE WHEN c_acctbal / 100 > 60 THEN 'High' WHEN c_acctbal / 100 > 30 THEN 'Moderate' ELSE 'Low' END AS band, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer GROUP BY 1""")
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("priority") * 10_000).cast("long")).alias("cents")
    return alerts(spark, sf_dir).groupBy(index.band(F.col("priority")).alias("band")).agg(F.count(F.lit(1)).alias("n"), cents)


@query("SELECT o_orderkey AS id, round(cume_dist() OVER (ORDER BY o_totalprice), 9) AS percentile FROM orders")
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return metrics.percentile_ranks(orders, orders.select("v")).select("id", F.round("percentile", 9).alias("percentile"))


SCORED = "scored AS (SELECT d.doc_id AS id, CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"""WITH {SCORED}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM scored),
ties AS (SELECT score, sum(label) AS tp, count(*) AS n FROM scored GROUP BY score),
run AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM ties WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(sum(label) FILTER (place <= 20) / 20, 9) AS p_at_20, round(sum(label) FILTER (score > 3000) / greatest(1, count(*) FILTER (score > 3000)), 9) AS precision,
       round(sum(label) FILTER (score > 3000) / greatest(1, sum(label)), 9) AS recall, round(count(*) FILTER (score > 3000 AND label = 0) / greatest(1, count(*) FILTER (label = 0)), 9) AS fpr,
       (SELECT round(sum(tp * ctp / cn) / greatest(1, sum(tp)), 9) FROM run) AS average_precision FROM ranked""")
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", "n_chars").join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))
    return metrics.detection(scored, threshold=3000.0)


@query("""WITH p AS (SELECT least(1.0, n_chars / 8000.0)::DOUBLE AS p, toxic AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT CAST(least(floor(p / 0.2), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed, round(avg((p - y) * (p - y)), 6) AS brier FROM p GROUP BY 1""")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "n_chars").join(labels, "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 8000).alias("p"), F.col("toxic").alias("y"))
    return metrics.reliability(rows)


@query(f"""WITH {FLOWS}, i AS (SELECT DISTINCT address FROM p_flows WHERE direction = 'input'), o AS (SELECT DISTINCT address FROM p_flows WHERE direction = 'output')
SELECT 'both' AS kind, address FROM (SELECT address FROM i INTERSECT SELECT address FROM o) UNION ALL SELECT 'inputs only', address FROM (SELECT address FROM i EXCEPT SELECT address FROM o)
UNION ALL SELECT 'outputs only', address FROM (SELECT address FROM o EXCEPT SELECT address FROM i)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.sides(flows(spark, sf_dir)).select("kind", "address")


@query("""WITH ordered AS (SELECT event_id, abs(epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY event_id)) / 1e6 AS gap_seconds FROM events)
SELECT event_id, round(gap_seconds, 6) AS gap_seconds FROM ordered WHERE gap_seconds > 900""")
def gap_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("ts").cast("timestamp").alias("timestamp"))
    return ingest.file_gaps(rows, stretch=5000).filter("gap_seconds > 900").select(F.col("ordinal").alias("event_id"), F.round("gap_seconds", 6).alias("gap_seconds"))


@query(f"""WITH {FLOWS}, {TX}, gone AS (SELECT address FROM p_flows WHERE direction = 'input'),
funders AS (SELECT d.address AS address, count(DISTINCT s.address) AS funders FROM p_flows d JOIN p_flows s ON s.txid = d.txid AND s.direction = 'input' WHERE d.direction = 'output' GROUP BY d.address)
SELECT address, funders FROM funders WHERE funders >= 3 AND address NOT IN (SELECT address FROM gone)""")
def terminal_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir)
    into = cx.edges(f).groupBy(F.col("dst").alias("address")).agg(F.count(F.lit(1)).alias("funders")).filter("funders >= 3")
    return into.join(f.filter(cx.is_input()), "address", "left_anti")


@query(f"""WITH {FLOWS}, {TX} SELECT t.txid AS txid, strftime(first_seen, '%Y-%m-%d') AS day, direction, address, amount_sats FROM p_flows JOIN p_tx t USING (txid) WHERE first_seen <= TIMESTAMP '1995-01-01'""")
def flows_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = views.until(transactions(spark, sf_dir), "1995-01-01 00:00:00")
    return flows(spark, sf_dir).join(early, "txid").select("txid", F.date_format("first_seen", "yyyy-MM-dd").alias("day"), "direction", "address", "amount_sats")


@query("""WITH owned AS (SELECT 'actor' || c_nationkey AS actor, CAST(c_custkey AS VARCHAR) AS address, c_acctbal / 100 AS priority FROM customer WHERE c_custkey NOT IN (1, 2)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY priority DESC, address) AS n, count(*) OVER (PARTITION BY actor) AS profiles FROM owned)
SELECT actor, address, priority, profiles, priority > 60 AS detected FROM ranked WHERE n = 1""")
def best_per_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("address"), F.concat(F.lit("actor"), "c_nationkey").alias("actor"))
    return workflow.actor_results(alerts(spark, sf_dir).withColumn("subscores", F.lit(None).cast("string")), own, ["1", "2"]).drop("subscores")


@query("SELECT user_id, event_id, CASE WHEN event_id % 6 < 4 THEN chr(39) ELSE '' END || substr('=+-@x ', CAST(event_id % 6 + 1 AS INTEGER), 1) || event_type AS event_type, format('{:.8f}', value) AS amount FROM events")
def guarded_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.sources.sinks import formula_guard

    text = F.concat(F.expr("substring('=+-@x ', cast(event_id % 6 + 1 as int), 1)"), "event_type")
    return table(spark, sf_dir, "events").select("user_id", "event_id", formula_guard(text).alias("event_type"), F.format_string("%.8f", "value").alias("amount"))


@query("SELECT count(*) AS rows, sha256('x') = sha256('x') AS valid, list_reduce(list_concat([repeat('0', 64)], list(props ORDER BY event_id)), lambda a, x: sha256(a || x)) AS head, CAST(count(*) FILTER ((event_id + 1) % 1000 = 500) AS BIGINT) AS altered FROM events")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain over all events, its head, and what is found where every thousandth payload was altered."""
    chain = written(audit.extend(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload")), ["event_id"]), "chain")
    state = audit.verify(chain)
    tampered = chain.withColumn("payload", F.when(F.col("seq") % 1000 == 500, F.lit("x")).otherwise(F.col("payload")))
    found = audit.broken_links(tampered).filter("why = 'altered payload' AND seq % 1000 = 500").agg(F.count(F.lit(1)).alias("altered"))
    return found.select(F.lit(state["rows"]).cast("long").alias("rows"), F.lit(state["valid"]).alias("valid"), F.lit(state["head"]).alias("head"), "altered")
