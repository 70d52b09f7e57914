"""Registered queries of tables that are kept up to date by imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators import features as ft
from trailweave.plans.maintain import Maintained
from trailweave.plans.more_queries import ENTITIES
from trailweave.plans.proxies import FLOWS, TX, flows, transactions
from trailweave.plans.queries import MIXERS
from trailweave.plans.queries import ORACLES as CHAIN_SQL
from trailweave.session import shared_folder, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BUCKETS = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def two_imports(spark: SparkSession, sf_dir: str) -> tuple[Maintained, DataFrame]:
    """All orders in two imports, and the report of the second: about a hundredth are new, and a fiftieth of the others were seen three days earlier than the first said.

    The second also brings later observations of known orders, which change nothing.
    """
    f, t = written(flows(spark, sf_dir), "all_flows"), transactions(spark, sf_dir).withColumn("first_seen", F.col("first_seen").cast("timestamp"))
    later = F.col("txid") % 97 == 5
    late = (F.col("txid") % 50 == 3) & ~later
    seen = t.select("txid", F.col("first_seen").alias("timestamp"))
    store = Maintained(spark, shared_folder(spark, "maintained"), BUCKETS)
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    first = t.filter(~later).withColumn("first_seen", F.when(late, F.col("first_seen") + days(3)).otherwise(F.col("first_seen")))
    store.apply(first, f.filter(~later), seen.limit(0))
    again = seen.filter(later | late).unionByName(seen.filter(F.col("txid") % 50 == 4).withColumn("timestamp", F.col("timestamp") + days(9)))
    return store, store.apply(t.filter(later), f.filter(later), again)


@query(CHAIN_SQL["chain_features"])
def incremental_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after the second import; the SQL computes all from all orders."""
    out = two_imports(spark, sf_dir)[0].profiles()
    return out.select("address", "n", *[F.round(c, 6).alias(c) if not c.startswith("max") else F.col(c) for c in ft.CHAIN])


@query(f"WITH RECURSIVE {FLOWS}, {MIXERS}, {ENTITIES} SELECT address, root FROM roots")
def incremental_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters after the second import, whose links merged roots of the first."""
    return two_imports(spark, sf_dir)[0].entities()


@query(f"""WITH {FLOWS}, touched AS (SELECT txid, address FROM p_flows WHERE direction = 'input' AND (txid % 97 = 5 OR txid % 50 = 3)),
named AS (SELECT txid, address, ('0x' || substr(md5(txid::VARCHAR), 1, 7))::BIGINT % {BUCKETS} AS tx_bucket, ('0x' || substr(md5(address), 1, 7))::BIGINT % {BUCKETS} AS bucket FROM touched)
SELECT 'by_tx' AS "table", count(DISTINCT txid) AS keys, count(DISTINCT tx_bucket)::INTEGER AS rewritten, {BUCKETS} AS buckets FROM named
UNION ALL SELECT t, count(DISTINCT address), count(DISTINCT bucket)::INTEGER, {BUCKETS} FROM named, (VALUES ('by_address'), ('profiles')) v(t) GROUP BY t""")
def incremental_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys the second import touched, and how many buckets it wrote anew."""
    return two_imports(spark, sf_dir)[1]
