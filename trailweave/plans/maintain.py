"""Profiles and clusters that are kept up to date: an import recomputes only what it touches.

Tables are dealt into buckets by a hash of their key. A version of a bucket is never changed: an import writes new
versions of the buckets that it touches and publishes one manifest (bucket, version) of every table by a rename, so
readers see the tables before or after an import, and an import that fails leaves nothing that counts.

``by_tx``      txid, address, and the transaction's time, fees and shape: a row for each (address, txid) of inputs
``by_address`` the same rows, dealt by address
``profiles``   history features of an address, from its rows of ``by_address`` alone
``clusters``   address, cluster: common-input clusters as they were when the address came
``roots``      cluster, root: where a cluster has gone since, by merging

An observation that comes late lowers the first_seen of its transaction, never raises it. The transactions that are new
or whose time fell mark their addresses; only these addresses' features are computed again. New links between addresses
join the roots that they touch, so merging works on roots, not on members.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators import context as cx
from trailweave.operators import features as ft
from trailweave.plans.store import _fs
from trailweave.session import written

_TABLES = {"by_tx": "txid", "by_address": "address", "profiles": "address", "clusters": "address", "roots": "cluster"}


def bucket_of(key: str | Column, buckets: int) -> Column:
    """From the first 28 bits of MD5, so other engines can name the buckets too."""
    return (F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key), 1, 7), 16, 10).cast("long") % buckets).cast("int")


class Maintained:
    """A folder of bucketed tables and their manifests."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _manifests(self) -> list[str]:
        fs, at = _fs(self.spark, f"{self.folder}/manifests")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self) -> dict[str, dict[int, int]]:
        """For each table the version of each bucket: as many entries as there are buckets."""
        names, out = self._manifests(), {}
        for r in self.spark.read.parquet(f"{self.folder}/manifests/{names[-1]}").collect() if names else []:
            out.setdefault(r.table, {})[r.bucket] = r.version
        return out

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table, or some of its buckets; only their current files are read."""
        kept = {b: v for b, v in self.manifest().get(name, {}).items() if buckets is None or b in set(buckets)}
        if not kept:
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/version={v}" for v in sorted(set(kept.values()))])
        return rows.filter((F.col("version") * self.buckets + F.col("bucket")).isin([v * self.buckets + b for b, v in kept.items()])).drop("version", "bucket")

    def publish(self, changes: dict[str, tuple[DataFrame, list[int]]]) -> dict[str, int]:
        """Writes new versions of buckets (rows and which buckets they are) and the manifest; returns buckets written by table."""
        version, current = len(self._manifests()) + 1, self.manifest()
        for name, (rows, touched) in changes.items():
            dealt = rows.withColumn("bucket", bucket_of(_TABLES[name], self.buckets))
            dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/version={version}")
            current.setdefault(name, {}).update(dict.fromkeys(touched, version))
        rows = [(t, b, v) for t, of in current.items() for b, v in of.items()]
        aside = f"{self.folder}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, "table string, bucket int, version int").coalesce(1).write.parquet(aside)
        fs, target = _fs(self.spark, f"{self.folder}/manifests/{version:08d}")
        _, source = _fs(self.spark, aside)
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError("another run has published this version")
        return {name: len(touched) for name, (_, touched) in changes.items()}

    def _touched(self, keys: DataFrame, column: str) -> list[int]:
        """Buckets of some keys: no more values than there are buckets."""
        return [r.b for r in keys.select(bucket_of(column, self.buckets).alias("b")).distinct().collect()]

    def _merged(self, name: str, fresh: DataFrame, keys: list[str], buckets: list[int]) -> DataFrame:
        """The rows of some buckets with ``fresh`` ones in place of those with the same keys."""
        old = self.table(name, buckets)
        return fresh if old is None else old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)

    def apply(self, transactions: DataFrame, flows: DataFrame, observations: DataFrame, features: Callable[[DataFrame], DataFrame] = ft.history_features) -> DataFrame:
        """Takes in an import: new transactions and their flows, and observations (txid, timestamp) of new or known ones.

        Returns table, keys (touched), rewritten and buckets. Known transactions keep their flows; only their time can
        change, and only downwards.
        """
        known = self.table("by_tx")
        timed = observations.groupBy("txid").agg(F.min(F.col("timestamp").cast("timestamp")).alias("at"))
        fresh = ft.spends(flows, transactions).withColumn("first_seen", F.col("first_seen").cast("timestamp"))
        if known is not None:
            fresh = fresh.join(known.select("txid").distinct(), "txid", "left_anti")
        fresh = fresh.join(timed, "txid", "left").withColumn("first_seen", F.least("first_seen", "at")).drop("at")
        if known is not None:
            near = self.table("by_tx", self._touched(timed, "txid"))
            late = near.join(timed, "txid").filter(F.col("at") < F.col("first_seen")).withColumn("first_seen", F.col("at")).drop("at") if near is not None else fresh.limit(0)
            fresh = fresh.unionByName(late)
        fresh = written(fresh, "touched_rows")
        by_tx, by_address = self._touched(fresh, "txid"), self._touched(fresh, "address")
        addresses = fresh.select("address").distinct()
        if known is None:  # all rows are fresh and all addresses touched: nothing to merge with, and nothing that is read twice
            rows, profiles = fresh, features(fresh)
        else:
            rows = written(self._merged("by_address", fresh, ["address", "txid"], by_address), "merged_rows")
            profiles = written(features(rows.join(addresses, "address", "left_semi")), "new_profiles")
        changes = {"by_tx": (self._merged("by_tx", fresh, ["txid", "address"], by_tx), by_tx), "by_address": (rows, by_address), "profiles": (self._merged("profiles", profiles, ["address"], by_address), by_address)}
        met = flows.select("address").distinct()
        changes |= self._clusters(met, cx.common_input_links(flows))
        touched = {"by_tx": fresh.select("txid").distinct().count()} | dict.fromkeys(("by_address", "profiles"), addresses.count())
        wrote = self.publish(changes)
        report = [(n, touched[n], wrote[n], self.buckets) for n in ("by_tx", "by_address", "profiles")]
        return self.spark.createDataFrame(report, "table string, keys long, rewritten int, buckets int")

    def _clusters(self, met: DataFrame, links: DataFrame) -> dict[str, tuple[DataFrame, list[int]]]:
        """New versions of clusters and roots: addresses that are new, and roots that new links join."""
        clusters, roots = self.table("clusters"), self.table("roots")
        if clusters is None:
            label = cx.components(links).select(F.col("node").alias("address"), F.col("root").alias("cluster"))
            fresh = written(met.join(label, "address", "left").select("address", F.coalesce("cluster", "address").alias("cluster")), "first_clusters")
            tops = fresh.select("cluster", F.col("cluster").alias("root")).distinct()
            return {"clusters": (fresh, self._touched(fresh, "address")), "roots": (tops, self._touched(tops, "cluster"))}
        now = written(clusters.join(roots, "cluster").select("address", "root"), "rooted")
        of = lambda side: F.coalesce(f"{side}_root", side)
        named = now.withColumnRenamed("root", "a_root").withColumnRenamed("address", "a")
        both = links.join(named, "a", "left").join(named.withColumnsRenamed({"a": "b", "a_root": "b_root"}), "b", "left").select(of("a").alias("a"), of("b").alias("b"))
        joined = written(cx.components(both, "roots").select("node", F.col("root").alias("to")), "joined_roots")
        fresh = met.join(now.select("address"), "address", "left_anti").withColumn("cluster", F.col("address"))
        fresh = written(fresh, "fresh_clusters")
        # clusters whose root goes elsewhere, and those of new addresses
        moved = roots.join(joined, roots.root == joined.node).select("cluster", F.col("to").alias("root")).join(roots, ["cluster", "root"], "left_anti")
        begun = fresh.select("cluster").join(joined, F.col("cluster") == F.col("node"), "left").select("cluster", F.coalesce("to", "cluster").alias("root"))
        changed = written(moved.unionByName(begun), "changed_roots")
        parts = self._touched(fresh, "address"), self._touched(changed, "cluster")
        return {"clusters": (self._merged("clusters", fresh, ["address"], parts[0]), parts[0]), "roots": (self._merged("roots", changed, ["cluster"], parts[1]), parts[1])} if parts[1] else {}

    def profiles(self) -> DataFrame:
        return self.table("profiles")

    def entities(self) -> DataFrame:
        """address, root: the least address of those of a common-input cluster."""
        return self.table("clusters").join(self.table("roots"), "cluster").select("address", "root")
