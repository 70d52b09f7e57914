"""Registered queries of readers, validation, ingest decisions, references and integrity, over records made from orders.

An order is a record: a 64-digit txid, its date, one input and two outputs. The files are written to the shared folder
in each format and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import values
from trailweave.plans import dossier, index, views
from trailweave.plans.proxies import FLOWS, TX, flows, table, transactions
from trailweave.session import freed, shared_folder, written
from trailweave.sources import ingest, readers, references
from trailweave.sources.normalize import SAYS, normalize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a record of texts and arrays of texts."""
    return as_records(table(spark, sf_dir, "orders"))


def as_records(orders: DataFrame, *more: str) -> DataFrame:
    """Records of orders, and ``more`` of their columns as they are."""
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    btc = lambda sats: references.btc(sats)
    return orders.select(
        F.lpad(F.lower(F.hex(key)), 64, "0").alias("txid"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("timestamp"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("input_addresses"), F.array(btc(cents + 100)).alias("input_amounts"),
        F.array(F.lit("shop"), F.concat(F.lit("rest"), "o_custkey")).alias("output_addresses"), F.array(btc(F.lit(1000).cast("long")), btc(cents - 1000)).alias("output_amounts"),
        F.format_string("10.0.%d.%d", F.floor(key / 250) % 250, key % 250).alias("source_ip"), (1024 + key % 60000).cast("string").alias("src_port"), F.lit("0.00000100").alias("fee"), F.concat(F.lit("AS"), (key % 70000).cast("string")).alias("asn"), F.when(key % 3 == 0, "de").alias("country"), key.cast("string").alias("memo"), *more)


READ = """SELECT lpad(lower(to_hex(o_orderkey)), 64, '0') AS txid, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H') AS hour, CAST(round(o_totalprice * 100) AS BIGINT) + 100 AS in_sats, CAST(round(o_totalprice * 100) AS BIGINT) AS out_sats, CAST(100 AS BIGINT) AS fee_sats,
       '10.0.' || (o_orderkey // 250) % 250 || '.' || o_orderkey % 250 AS src_ip, CAST(1024 + o_orderkey % 60000 AS INTEGER) AS src_port, CAST(o_orderkey % 70000 AS BIGINT) AS asn, CASE WHEN o_orderkey % 3 = 0 THEN 'DE' END AS geo_country, 'memo' AS unmapped FROM orders"""


def _as_read(rows: DataFrame) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    good = normalize(rows).filter("error IS NULL")
    return good.select("txid", F.date_format("timestamp", "yyyy-MM-dd HH").alias("hour"), total("input_sats").alias("in_sats"), total("output_sats").alias("out_sats"), "fee_sats", "src_ip", "src_port", "asn", "geo_country", F.array_join("unmapped", ",").alias("unmapped"))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.to_json(n).alias(n) if t.startswith("array") else F.col(n) for n, t in rows.dtypes])


@query(READ)
def read_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'records')}/all.csv"
    _flat(order_records(spark, sf_dir)).write.option("header", True).option("escape", '"').csv(path)
    return _as_read(readers.read_records(spark, path))


@query(READ)
def read_jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'records')}/all.jsonl"
    order_records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return _as_read(readers.read_records(spark, path))


#: Records that a file holds, about: a JSON file of ``read_json_records`` is one row before it is written, an XML file is read by one task.
FILE_ROWS = 10_000
#: Such JSON files that one task writes.
TASK_FILES = 2


@query(READ)
def read_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an array each, and files of an object with ``records``: more files, not bigger ones, where there are more orders.

    A file's orders meet before they are records, whose texts are ten times as long, and the files are compressed.
    """
    path = f"{shared_folder(spark, 'records')}/all.json"
    orders = table(spark, sf_dir, "orders")
    files = max(16, orders.count() // FILE_ROWS)
    with freed(spark):
        dealt = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).alias("_p")).repartition(-(-files // TASK_FILES), "_p")
        rows = as_records(dealt, "_p")
        parts = rows.groupBy("_p").agg(F.to_json(F.collect_list(F.struct(*[c for c in rows.columns if c != "_p"]))).alias("a"))
        value = F.when(F.col("_p") % 2 == 0, F.col("a")).otherwise(F.concat(F.lit('{"records": '), "a", F.lit("}")))
        parts.select(value.alias("value"), "_p").write.partitionBy("_p").option("lineSep", " ").option("compression", "gzip").text(path)
    return _as_read(readers.read_records(spark, path))


@query(READ)
def read_xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that tasks share evenly, as no XML file is split."""
    path = f"{shared_folder(spark, 'records')}/all.xml"
    rows = order_records(spark, sf_dir)
    rows = rows.repartition(max(1, rows.count() // FILE_ROWS), "txid")
    listed = rows.select(*[F.struct(F.col(n).alias("item")).alias(n) if t.startswith("array") else F.col(n) for n, t in rows.dtypes])
    listed.write.option("rowTag", "record").option("rootTag", "records").format("xml").save(path)
    return _as_read(readers.read_records(spark, path))


@query("""WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS ordinal FROM orders)
SELECT ordinal, CASE WHEN k % 40 = 7 THEN 'Invalid JSON record' WHEN k % 40 = 9 THEN 'Blank JSONL record' END AS parse_error, CASE WHEN k % 40 NOT IN (7, 9) THEN k END AS memo FROM o""")
def read_line_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of lines over all files of a folder, with lines that are cut off and blank ones."""
    path = f"{shared_folder(spark, 'records')}/lines.jsonl"
    lines = order_records(spark, sf_dir).withColumn("k", F.col("memo").cast("long"))
    text = F.to_json(F.struct("txid", "timestamp", "input_addresses", "memo"))
    text = F.when(F.col("k") % 40 == 7, F.substring(text, 1, 90)).when(F.col("k") % 40 == 9, " ").otherwise(text)
    lines.repartitionByRange("k").sortWithinPartitions("k").select(text.alias("value")).write.text(path)
    return readers.read_records(spark, path).select("ordinal", "parse_error", F.col("fields")["memo"].cast("long").alias("memo"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS ordinal, o_orderkey AS memo, '{\"n}\": [' || o_orderkey || ', {}]}' AS odd FROM orders")
def read_array_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of elements over files of one array on one line each, read in ranges of 16 KB that cut through records, strings and lists."""
    path = f"{shared_folder(spark, 'records')}/arrays.json"
    rows = order_records(spark, sf_dir).withColumn("k", F.col("memo").cast("long"))
    odd = F.concat(F.lit('{"n}": ['), "memo", F.lit(", {}]}"))
    one = F.struct("k", F.to_json(F.struct("txid", "input_addresses", "memo", odd.alias("odd"))).alias("t"))
    arrays = rows.groupBy(F.lpad(F.floor(F.col("k") / 20_000).cast("string"), 12, "0").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["t"]), ", ").alias("value"))
    arrays.select("part", F.concat(F.lit("["), "value", F.lit("]")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        return written(readers.read_records(spark, path).select("ordinal", F.col("fields")["memo"].cast("long").alias("memo"), F.col("fields")["odd"].alias("odd")), "array_ordinals")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


FAULTS = (
    ("txid", "'xyz'", SAYS["txid"]), ("timestamp", "'2024-01-02T03:04:05'", SAYS["zone"]), ("timestamp", "'soon'", SAYS["time"] + "soon'"), ("input_addresses", "'[]'", SAYS["empty"].format("input_addresses")), ("input_addresses", "'[\"a b\"]'", SAYS["address"]),
    ("input_amounts", "'[\"1\",\"2\"]'", SAYS["lengths"].format("input")), ("input_amounts", "'[\"much\"]'", SAYS["amount"]), ("input_amounts", "'[\"0.000000001\"]'", SAYS["range"]), ("input_amounts", "'[\"0.00000001\"]'", SAYS["outputs"]), ("fee", "'0.5'", SAYS["fee"]),
    ("vsize", "'5000000'", SAYS["vsize"]), ("source_ip", "'10.0.0.300'", "'10.0.0.300" + SAYS["ip"]), ("src_port", "'70000'", SAYS["port"]), ("country", "'DEU'", SAYS["country"]), ("asn", "'AS4294967296'", SAYS["asn"]), ("output_amounts", "'nonsense'", SAYS["json"].format("output_amounts")),
)
_QUOTED = [says.replace("'", "''") for _, _, says in FAULTS]


@query("SELECT error, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, CASE o_orderkey % 20 " + " ".join(f"WHEN {i} THEN '{says}'" for i, says in enumerate(_QUOTED)) + " END AS error FROM orders) GROUP BY error")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which check each record fails first, with a fault of each kind put into a twentieth of the orders."""
    rows = _flat(order_records(spark, sf_dir)).withColumns({"_k": F.col("memo").cast("long"), "vsize": F.lit(None).cast("string")})
    for i, (name, value, _) in enumerate(FAULTS):
        rows = rows.withColumn(name, F.when(F.col("_k") % 20 == i, F.expr(value)).otherwise(F.col(name)))
    names = [c for c in rows.columns if c != "_k"]
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in names]), lambda e: e["value"].isNotNull())
    records = rows.select(F.col("_k").alias("ordinal"), F.map_from_entries(entries).alias("fields"), F.lit("").alias("raw"), F.lit(None).cast("string").alias("parse_error"))
    return normalize(records).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("ordinal").alias("keys"))


@query("""WITH o AS (SELECT o_orderkey AS k, count(*) OVER (PARTITION BY o_orderkey) AS c FROM orders)
SELECT 'accepted' AS status, CAST(count(*) + count(*) FILTER (k % 7 = 0) AS BIGINT) AS n FROM o UNION ALL SELECT 'duplicate', count(*) FROM o WHERE k % 5 = 0 UNION ALL SELECT 'conflict', count(*) FROM o WHERE k % 11 = 0""")
def ingest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses where a fifth of the orders come twice, a seventh with a later observation, an eleventh with other amounts."""
    flat = _flat(order_records(spark, sf_dir))
    names = flat.columns
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in names]), lambda e: e["value"].isNotNull())
    base = flat.select(F.col("memo").cast("long").alias("k"), F.map_from_entries(entries).alias("fields"))
    n = 1 << 40
    change = lambda key, value: F.map_concat(F.map_filter("fields", lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))
    later = base.filter("k % 7 = 0").select((F.col("k") + n).alias("k"), change("timestamp", "2030-01-01T00:00:00Z").alias("fields"))
    other = base.filter("k % 11 = 0").select((F.col("k") + 2 * n).alias("k"), change("script_type", "p2sh").alias("fields"))
    rows = base.unionByName(base.filter("k % 5 = 0").withColumn("k", F.col("k") + 3 * n)).unionByName(later).unionByName(other)
    records = rows.select(F.col("k").alias("ordinal"), "fields", F.lit("").alias("raw"), F.lit(None).cast("string").alias("parse_error"))
    return ingest.classify(written(normalize(records), "normalized").filter("error IS NULL"), None).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH ips AS (SELECT DISTINCT (o_orderkey // 250) % 250 AS b, o_orderkey % 250 AS d FROM orders)
SELECT '10.0.' || b || '.' || d AS src_ip, CASE WHEN b % 2 = 0 AND d < 128 THEN 'AA' WHEN b < 100 THEN 'BB' ELSE 'in' END AS geo_country, CAST(CASE WHEN b % 2 = 0 AND d < 128 THEN b WHEN b < 100 THEN 7 END AS BIGINT) AS asn,
       CASE WHEN b % 2 = 0 AND d < 128 OR b < 100 THEN 'local_ranges' ELSE 'input_metadata_unverified' END AS geo_source FROM ips""")
def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest range of addresses wins: half of every second network, within a wide range; others keep their input."""
    ip = order_records(spark, sf_dir).select(F.col("source_ip").alias("src_ip")).distinct().select("src_ip", F.lit("in").alias("geo_country"), F.lit(None).cast("long").alias("asn"), F.lit("input_metadata_unverified").alias("geo_source"))
    half = spark.range(0, 250, 2).select(F.format_string("10.0.%d.0", "id").alias("f"), F.format_string("10.0.%d.127", "id").alias("l"), F.lit("AA").alias("geo_country"), F.col("id").alias("asn"))
    wide = spark.createDataFrame([("10.0.0.0", "10.0.99.255", "BB", 7)], "f string, l string, geo_country string, asn long")
    ranges = half.unionByName(wide).select(values.ip_key("f").alias("first"), values.ip_key("l").alias("last"), "geo_country", "asn")
    return ingest.enrich_geo(ip, ranges)


@query("""SELECT CASE WHEN ts < TIMESTAMP '2024-01-05' OR ts > TIMESTAMP '2024-01-20' THEN 'unknown' WHEN user_id % 3 = 0 THEN 'exit' ELSE 'other' END AS tor, count(*) AS n FROM events GROUP BY 1""")
def tor_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations within a snapshot's time, by whether their source is in it."""
    seen = table(spark, sf_dir, "events").select(F.concat(F.lit("ip"), "user_id").alias("src_ip"), F.col("ts").cast("timestamp").alias("timestamp"))
    exits = table(spark, sf_dir, "events").filter("user_id % 3 = 0").select(F.concat(F.lit("ip"), "user_id").alias("ip"))
    tagged = ingest.tag_tor(seen, exits, "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z")
    return tagged.groupBy(F.when(F.col("tor_exit").isNull(), "unknown").when(F.col("tor_exit"), "exit").otherwise("other").alias("tor")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT kind, count(*) AS n FROM (SELECT 'flow' AS kind FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT 'first_seen' FROM orders WHERE o_orderkey % 17 = 0 UNION ALL SELECT 'chain' FROM orders WHERE o_orderkey % 19 = 0) GROUP BY kind""")
def state_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check of stored tables finds where amounts, times and chain fields were altered."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("txid"), F.col("o_orderdate").alias("timestamp"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    record = orders.select("k", "txid", "timestamp", F.array(F.lit("a")).alias("input_addresses"), F.array("v").alias("input_sats"), F.array(F.lit("b")).alias("output_addresses"), F.array("v").alias("output_sats"), F.lit("same").alias("chain"))
    records = record.unionByName(record.filter("k % 19 = 0").withColumn("chain", F.lit("other")))
    sides = [orders.select("k", "txid", F.lit(d).alias("direction"), F.lit(0).alias("ordinal"), F.lit(a).alias("address"), F.col("v").alias("amount_sats")) for d, a in (("input", "a"), ("output", "b"))]
    stored = sides[0].unionByName(sides[1]).withColumn("amount_sats", F.when((F.col("k") % 13 == 0) & (F.col("direction") == "output"), F.col("amount_sats") + 1).otherwise(F.col("amount_sats")))
    times = orders.select("txid", F.when(F.col("k") % 17 == 0, F.date_add("timestamp", 1).cast("timestamp_ntz")).otherwise(F.col("timestamp")).alias("first_seen"))
    return views.violations(records, stored.drop("k"), times).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS records, CAST(count(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS aggregate_input, CAST(count(*) FILTER (o_orderkey % 4 = 0) AS BIGINT) AS rounding_overflow, count(*) AS fee_recomputed, CAST(count(*) FILTER (o_orderkey % 4 = 1) AS BIGINT) AS unsupported FROM orders""")
def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of repairs: single amounts split, outputs a little or much above inputs, fees computed anew."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    over = F.when(F.col("k") % 4 == 0, 3).when(F.col("k") % 4 == 1, 50).otherwise(-10)
    rows = orders.select(F.when(F.col("k") % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"))).alias("input_addresses"), F.array("v").alias("input_sats"), F.array(F.lit("o")).alias("output_addresses"), F.array(F.col("v") + over).alias("output_sats"), F.lit(None).cast("long").alias("fee_sats"))
    return references.repair_counts(references.repair(rows))


@query("""WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS address, (c_custkey % 10) / 10.0 AS tainted, (c_custkey % 7) / 7.0 AS fused, (c_custkey % 5) / 5.0 AS drift, (c_custkey % 9) AS gap, c_custkey % 4 = 0 AS reuse, (c_custkey % 6)::DOUBLE AS related, c_custkey % 3 > 0 AS seen FROM customer),
v AS (SELECT address, CASE WHEN CAST(address AS INTEGER) % 8 > 0 THEN tainted END AS t, greatest(fused, drift) AS b, greatest(least(1, greatest(0, 1 - gap / ln(3601))), drift) AS m, CAST(reuse AS INTEGER) AS u, CASE WHEN seen THEN least(1, related / 3) END AS x FROM r),
p AS (SELECT address, round(100 * (coalesce(t, 0) * 0.25 + b * 0.2 + m * 0.2 + u * 0.2 + coalesce(x, 0) * 0.15)::DOUBLE, 2) AS priority, CASE WHEN t IS NULL THEN 0 ELSE 0.25 END + 0.6 + CASE WHEN x IS NULL THEN 0 ELSE 0.15 END AS coverage FROM v)
SELECT address, priority, round(coverage::DOUBLE, 6) AS component_coverage, CASE WHEN priority > 60 THEN 'High' WHEN priority > 30 THEN 'Review' ELSE 'Low' END AS priority_band FROM p""")
def fracture_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted index, its coverage and bands of every customer, from made-up component values."""
    k = F.col("c_custkey")
    name = "array<struct<name:string,strength:double>>"
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("address"), F.when(k % 8 > 0, (k % 10) / 10.0).alias("taint"), ((k % 7) / 7.0).alias("fused_percentile"), F.lit(None).cast("double").alias("graph_score"), F.lit(0.0).alias("rule_score"), ((k % 5) / 5.0).alias("drift_score"), (k % 9).cast("double").alias("log_median_gap_seconds"),
        F.when(k % 4 == 0, F.expr("array(named_struct('name', 'Address reuse', 'strength', 0.3D))")).otherwise(F.expr(f"CAST(array() AS {name})")).alias("rules"), (k % 6).cast("double").alias("relay_associations"), F.when(k % 3 > 0, 1.0).otherwise(0.0).alias("network_coverage"))
    return index.fracture_index(rows).select("address", "priority", F.round("component_coverage", 6).alias("component_coverage"), "priority_band")


@query("""WITH z AS (SELECT avg(CASE WHEN abs(c_acctbal / 1000 - 4.5) / 1.2 > 3 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN abs(c_nationkey - 12) / 2.0 > 3 THEN 1.0 ELSE 0.0 END) AS b FROM customer)
SELECT feature, round(share, 9) AS share FROM (SELECT 'balance' AS feature, a AS share FROM z UNION ALL SELECT 'nation', b FROM z) WHERE share > 0.05""")
def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of which more than a share of rows lies over three deviations from a training mean."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    out = index.feature_drift(rows, ["balance", "nation"], {"balance": 4.5, "nation": 12.0}, {"balance": 1.2, "nation": 2.0}, least=0.05)
    return out.select("feature", F.round("share", 9).alias("share"))


@query(f"""WITH {FLOWS}, {TX}, own AS (SELECT DISTINCT txid FROM p_flows WHERE address IN ('A7', 'A8', 'A9'))
SELECT 'transactions' AS part, count(*) AS n FROM p_tx WHERE txid IN (SELECT txid FROM own) UNION ALL SELECT 'observations', count(*) FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (SELECT txid FROM own)
UNION ALL SELECT 'members', 3 UNION ALL SELECT 'alerts', 3""")
def dossier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a dossier's tables for an entity of three addresses."""
    from trailweave.plans.proxies import observations

    members = spark.createDataFrame([(a, "e") for a in ("A7", "A8", "A9")], "address string, entity_id string")
    alerts = members.select("address", F.expr("CAST(array() AS array<struct<txids:array<bigint>>>)").alias("rules"), F.expr("CAST(array() AS array<bigint>)").alias("txids"))
    parts = dossier.dossier_tables("A7", members, alerts, flows(spark, sf_dir), transactions(spark, sf_dir), observations(spark, sf_dir))
    out = None
    for name in ("transactions", "observations", "members", "alerts"):
        one = parts[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
