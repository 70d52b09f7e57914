"""Ingest: records of a file become rows of a case, are recognised as duplicates, or go to quarantine.

All decisions are made in one pass of joins and windows by txid. New rows are appended to the case's tables; a file
whose hash the case has is skipped, and a file without records changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions.values import canonical
from trailweave.plans import audit
from trailweave.sources.normalize import SAYS, normalize
from trailweave.sources.readers import file_hash, read_records
from trailweave.session import written

CHAIN = ("txid", "input_addresses", "output_addresses", "input_sats", "output_sats", "fee_sats", "script_type", "vsize")
OBSERVED = ("txid", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port")


@dataclass
class Case:
    """Tables of a case below a folder that all executors share.

    Whatever an import or a scoring run adds is one batch: it is written aside, all its tables, and published by one
    rename. A run that dies leaves nothing that readers see, and can be run again. One writer at a time is assumed.
    """

    spark: SparkSession
    folder: str

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _found(self, pattern: str) -> list[str]:
        fs, at = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])

    def batches(self) -> list[str]:
        """Names of the published batches, the oldest first."""
        return [p.rsplit("/", 1)[-1] for p in self._found(f"{self.folder}/batches/*")]

    def has(self, name: str) -> bool:
        return bool(self._found(f"{self.folder}/batches/*/{name}"))

    def table(self, name: str) -> DataFrame | None:
        paths = self._found(f"{self.folder}/batches/*/{name}")
        return self.spark.read.parquet(*paths) if paths else None

    def publish(self, label: str, tables: dict[str, DataFrame]) -> None:
        """Adds the tables' rows, all or none."""
        aside = f"{self.folder}/aside/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{aside}/{name}")
        fs, source = self._at(aside)
        _, target = self._at(f"{self.folder}/batches/{len(self.batches()):08d}-{label}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"another run has published {target.getName()}")

    def accepted(self) -> DataFrame:
        return self.table("records")

    def alerts(self) -> DataFrame | None:
        """The latest alerts, if no records and no references were published after them."""
        for batch in reversed(self.batches()):
            if paths := self._found(f"{self.folder}/batches/{batch}/alerts"):
                return self.spark.read.parquet(*paths)
            if self._found(f"{self.folder}/batches/{batch}/records") or self._found(f"{self.folder}/batches/{batch}/references_*"):
                return None
        return None

    def references(self, kind: str) -> DataFrame | None:
        """The last import of a kind (seeds or exchanges)."""
        paths = self._found(f"{self.folder}/batches/*/references_{kind}")
        return self.spark.read.parquet(paths[-1]) if paths else None

    def archive(self, path: str, name: str) -> str:
        """A copy of a source file in the case's folder."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        (from_fs, source), (to_fs, copy) = self._at(path), self._at(f"{self.folder}/evidence/{name}")
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, copy.getFileSystem(conf), copy, False, conf)
        return copy.toString()

    def audited(self, events: DataFrame, order: list[str]) -> DataFrame:
        """Audit rows for events (payload and columns to order by) after those of the case."""
        chain = self.table("audit")
        last = chain.agg(F.max("seq"), F.max_by("hash", "seq")).first() if chain is not None else (0, audit.ZERO)
        return audit.extend(events, order, seq=last[0], head=last[1])

    def event(self, **payload: object) -> DataFrame:
        """One audit row, for a batch that has no other."""
        row = self.spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "payload string")
        return self.audited(row, ["payload"])

    def transactions(self) -> DataFrame:
        """First seen is the least time of all observations of a transaction, whenever they came."""
        rows = self.accepted()
        return rows.groupBy("txid").agg(F.min("timestamp").alias("first_seen"), F.any_value("fee_sats").alias("fee_sats"), F.any_value("vsize").alias("vsize"), F.any_value("script_type").alias("script_type"))

    def flows(self) -> DataFrame:
        rows = self.accepted()
        once = rows.groupBy("txid").agg(F.any_value(F.struct("input_addresses", "input_sats", "output_addresses", "output_sats")).alias("c"))
        sides = [once.select("txid", F.lit(side).alias("direction"), F.posexplode(F.arrays_zip(F.col(f"c.{side}_addresses").alias("address"), F.col(f"c.{side}_sats").alias("amount_sats"))).alias("ordinal", "x")) for side in ("input", "output")]
        return sides[0].unionByName(sides[1]).select("txid", "direction", F.col("ordinal").cast("int").alias("ordinal"), F.col("x.address").alias("address"), F.col("x.amount_sats").alias("amount_sats"))

    def observations(self) -> DataFrame:
        return self.accepted().select(F.col("observation_id").alias("id"), *OBSERVED, "geo_country", "asn", "geo_source", "tor_exit", "source_hash", F.col("ordinal").alias("source_row"))


def enrich_geo(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Country and ASN of ``src_ip`` from ranges (first, last as 32 hexadecimal digits, geo_country, asn): the narrowest range wins.

    Rows meet ranges by the first digits that a range's ends share, so no row is compared with ranges elsewhere.
    """
    from trailweave.functions.values import ip_key

    keyed = rows.select("src_ip").filter("src_ip IS NOT NULL").distinct().withColumn("k", ip_key("src_ip"))
    # a range whose ends share 24 (or 4) digits is filed under every value of the next 4 that it touches
    touched = lambda at: F.sequence(F.conv(F.substring("first", at, 4), 16, 10).cast("int"), F.conv(F.substring("last", at, 4), 16, 10).cast("int"))
    filed = lambda mark, n: F.transform(touched(n + 1), lambda i: F.concat(F.lit(mark), F.substring("first", 1, n), F.lpad(F.lower(F.hex(i)), 4, "0")))
    shared = lambda n: F.substring("first", 1, n) == F.substring("last", 1, n)
    cells = ranges.withColumn("cell", F.explode(F.when(shared(24), filed("a", 24)).when(shared(4), filed("b", 4)).otherwise(F.array(F.lit("c")))))
    looked = keyed.withColumn("cell", F.explode(F.array(F.concat(F.lit("a"), F.substring("k", 1, 28)), F.concat(F.lit("b"), F.substring("k", 1, 8)), F.lit("c"))))
    narrow = looked.join(cells, "cell").filter((F.col("k") >= F.col("first")) & (F.col("k") <= F.col("last")))
    best = narrow.groupBy("src_ip").agg(F.max_by(F.struct(F.col("geo_country").alias("c"), F.col("asn").alias("a")), F.struct(F.col("first"), F.translate("last", "0123456789abcdef", "fedcba9876543210"))).alias("g"))
    joined = rows.join(best, "src_ip", "left")
    return joined.withColumns({"geo_country": F.coalesce("g.c", "geo_country"), "asn": F.coalesce("g.a", "asn"), "geo_source": F.when(F.col("g.c").isNotNull() | F.col("g.a").isNotNull(), "local_ranges").otherwise(F.col("geo_source"))}).drop("g").select(rows.columns)


def tag_tor(rows: DataFrame, exits: DataFrame | None, valid_from: str = "", valid_until: str = "") -> DataFrame:
    """tor_exit: null without a snapshot, a source or outside the snapshot's time; else whether the source is in it."""
    if exits is None:
        return rows.withColumn("tor_exit", F.lit(None).cast("boolean"))
    inside = F.col("timestamp").between(F.to_timestamp(F.lit(valid_from)), F.to_timestamp(F.lit(valid_until)))
    known = exits.select(F.col("ip").alias("_ip")).distinct()
    return rows.join(known, F.col("src_ip") == F.col("_ip"), "left").withColumn("tor_exit", F.when(inside & F.col("src_ip").isNotNull(), F.col("_ip").isNotNull())).drop("_ip")


def strict_gaps(rows: DataFrame, most: float) -> DataFrame:
    """Rows (ordinal, timestamp) too far from the last row that passed: a fold over two numbers a row, so in one sorted task."""
    import pandas as pd

    def fold(batches):
        last = None
        for pdf in batches:
            bad = []
            for ordinal, at in zip(pdf["ordinal"], pdf["t"], strict=True):
                if last is not None and abs(at - last) > most:
                    bad.append((ordinal, abs(at - last)))
                else:
                    last = at
            yield pd.DataFrame(bad, columns=["ordinal", "gap_seconds"]).astype({"ordinal": "int64", "gap_seconds": "float64"})

    slim = rows.select("ordinal", (F.unix_micros("timestamp") / 1e6).alias("t")).repartition(1).sortWithinPartitions("ordinal")
    return slim.mapInPandas(fold, "ordinal long, gap_seconds double")


def file_gaps(rows: DataFrame, stretch: int = 1_000_000) -> DataFrame:
    """(ordinal, gap_seconds): absolute distance in time from the row before in the file.

    Rows are taken in stretches of ordinals; each stretch also gets the last row before it.
    """
    slim = rows.select("ordinal", F.unix_micros("timestamp").alias("t"), F.floor(F.col("ordinal") / stretch).alias("s"))
    ends = slim.groupBy("s").agg(F.max_by("t", "ordinal").alias("end"))
    before = ends.withColumn("end", F.lag("end").over(Window.orderBy("s")))
    step = F.coalesce(F.lag("t").over(Window.partitionBy("s").orderBy("ordinal")), F.col("end"))
    return slim.join(before, "s").select("ordinal", (F.abs(F.col("t") - step) / 1e6).alias("gap_seconds"))


def record_digest() -> Column:
    """Digest of everything that a record says, for the audit and for the check of stored rows against it."""
    return F.sha2(canonical({n: F.col(n) for n in (*CHAIN, "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "geo_country", "asn", "geo_source")}), 256)


def import_references(case: Case, path: str, kind: str) -> int:
    """Stores a list of seeds or exchanges in the case and its audit; alerts scored before it no longer count."""
    from trailweave.sources.references import read_references

    if kind not in ("seeds", "exchanges"):
        raise ValueError("references are seeds or exchanges")
    rows = written(read_references(case.spark, path).dropDuplicates(["address"]), "references")
    n = rows.count()
    if not n:
        raise ValueError("the file names no reference")
    case.publish(f"{kind}", {f"references_{kind}": rows, "audit": case.event(event="references_imported", kind=kind, rows=n, sha256=file_hash(case.spark, path))})
    return n


def classify(good: DataFrame, known: DataFrame | None) -> DataFrame:
    """``good`` with chain, observation_id and status: accepted, duplicate or conflict.

    The first valid row of a txid (in the case, else in the file) fixes its chain fields; of equal observations the
    first is accepted.
    """
    rows = good.withColumns({"chain": canonical({n: F.col(n) for n in CHAIN}), "observation_id": F.sha2(canonical({n: F.col(n) for n in OBSERVED}), 256)})
    first = rows.groupBy("txid").agg(F.min_by("chain", "ordinal").alias("file_chain"))
    if known is not None:
        stored = known.groupBy("txid").agg(F.any_value("chain").alias("case_chain"))
        rows = rows.join(first.join(stored, "txid", "left"), "txid").withColumn("fixed", F.coalesce("case_chain", "file_chain")).drop("case_chain", "file_chain")
        rows = rows.join(known.select("observation_id", F.lit(True).alias("stored")).distinct(), "observation_id", "left")
    else:
        rows = rows.join(first, "txid").withColumnRenamed("file_chain", "fixed").withColumn("stored", F.lit(None).cast("boolean"))
    fits = F.col("chain") == F.col("fixed")
    earliest = F.min(F.when(fits, F.col("ordinal"))).over(Window.partitionBy("observation_id"))
    status = F.when(~fits, "conflict").when(F.col("stored") | (F.col("ordinal") > earliest), "duplicate").otherwise("accepted")
    return rows.withColumn("status", status).drop("fixed", "stored")


def ingest(case: Case, path: str, mapping: dict[str, str] | None = None, ranges: DataFrame | None = None, tor: tuple[DataFrame, str, str] | None = None, max_gap_seconds: float | None = None, allow_fee_mismatch: bool = False) -> dict:
    """Adds a file to a case; returns counts by status and what a reviewer should look at."""
    spark = case.spark
    source = file_hash(spark, path)
    if (known_sources := case.table("sources")) is not None and not known_sources.filter(F.col("hash") == source).isEmpty():
        return {"already_ingested": True, "source_sha256": source}
    stored = case.archive(path, f"{source}.{path.rsplit('.', 1)[-1].lower()}")
    if file_hash(spark, stored) != source:
        raise ValueError("the file changed while it was copied")
    rows = written(normalize(read_records(spark, stored), mapping, allow_fee_mismatch), "normalized")
    if rows.isEmpty():
        raise ValueError("the file holds no records")
    good = rows.filter("error IS NULL")
    if ranges is not None:
        good = enrich_geo(good, ranges)
    good = tag_tor(good, *(tor or (None,)))
    limit = max_gap_seconds or 86_400
    if max_gap_seconds:
        gaps = written(strict_gaps(good, max_gap_seconds), "gaps")
        good = good.join(gaps.select("ordinal"), "ordinal", "left_anti")
        refused = rows.join(gaps.select("ordinal"), "ordinal", "left_semi").withColumn("error", F.lit(SAYS["gap"]))
    else:
        gaps = file_gaps(good).filter(F.col("gap_seconds") > limit)
        refused = rows.limit(0)
    judged = written(classify(good, case.accepted()), "judged").withColumn("source_hash", F.lit(source))
    conflict = judged.filter("status = 'conflict'").select(F.col("ordinal"), "raw").withColumn("error", F.lit(SAYS["conflict"]))
    out = ("ordinal", "raw", "error")
    quarantine = rows.filter("error IS NOT NULL").select(*out).unionByName(refused.select(*out)).unionByName(conflict.select(*out)).withColumn("source_hash", F.lit(source))
    accepted = judged.filter("status = 'accepted'")
    before = case.accepted()
    new = accepted.select("txid").distinct()
    new_count = (new.join(before.select("txid"), "txid", "left_anti") if before is not None else new).count()
    counts = dict(judged.groupBy("status").count().collect())
    unmapped = sorted(r[0] for r in rows.select(F.explode("unmapped")).distinct().collect())
    warnings = gaps.orderBy("ordinal").limit(100).collect()
    raw_hash = F.sha2("raw", 256).alias("raw_sha256")
    known = judged.filter("status <> 'conflict'")
    rest = quarantine.select("ordinal", F.lit(1).alias("step"), F.to_json(F.struct(F.lit("quarantined").alias("event"), "error", raw_hash, F.col("ordinal").alias("row"), F.lit(source).alias("source"))).alias("payload"))
    told = known.select("ordinal", F.lit(1).alias("step"), F.to_json(F.struct(F.col("status").alias("event"), "observation_id", record_digest().alias("normalized_sha256"), raw_hash, F.col("ordinal").alias("row"), F.lit(source).alias("source"))).alias("payload"))
    fees = known.filter("status = 'accepted' AND fee_mismatch_sats <> 0").select("ordinal", F.lit(0).alias("step"), F.to_json(F.struct(F.lit("fee_mismatch_accepted").alias("event"), F.col("fee_sats").alias("computed_fee_sats"), "reported_fee_sats", F.col("ordinal").alias("row"), F.lit(source).alias("source"))).alias("payload"))
    review = {"event": "schema_review", "source_sha256": source, "timestamp_gap_warnings": [[r[0], r[1]] for r in warnings], "unmapped_fields": unmapped}
    ends = [(0, 0, json.dumps({"event": "source_ingested", "mapping": mapping or {}, "name": path, "sha256": source}, sort_keys=True)), (1 << 62, 0, json.dumps(review, sort_keys=True))]
    events = told.unionByName(rest).unionByName(fees).unionByName(spark.createDataFrame(ends, "ordinal long, step int, payload string"))
    file = spark.createDataFrame([(source, stored, path.rsplit(".", 1)[-1].lower())], "hash string, name string, format string")
    case.publish(f"source-{source[:16]}", {"quarantine": quarantine, "audit": case.audited(events, ["ordinal", "step"]), "records": accepted, "sources": file})
    return {"accepted": counts.get("accepted", 0), "duplicates": counts.get("duplicate", 0), "quarantined": rows.filter("error IS NOT NULL").count() + refused.count() + counts.get("conflict", 0), "new_transactions": new_count, "source_sha256": source, "unmapped_fields": unmapped, "timestamp_gap_warnings": [(r[0], r[1]) for r in warnings], "review_required": bool(unmapped or warnings)}
