"""Readers, validation, ingest, references, repairs, and streams."""

import json

import pytest
from cases import made
from pyspark.sql import functions as F

from trailweave.functions import values
from trailweave.operators import features as ft
from trailweave.plans import audit, views
from trailweave.sources import ingest as ing
from trailweave.sources import readers, references, sinks
from trailweave.sources.normalize import normalize
from trailweave.sources.readers import preview, read_records


def record(**more):
    base = {
        "timestamp": "2025-01-01T00:00:00+00:00", "src_ip": "192.0.2.77", "dst_ip": "192.0.2.8", "src_port": 41000, "dst_port": 18333, "txid": "a" * 64, "input_addresses": ["payer"], "output_addresses": ["payee"],
        "input_amounts": ["1.00000000"], "output_amounts": ["0.99999000"], "fee": "0.00001000", "vsize": 200, "script_type": "p2wpkh", "geo_country": None, "asn": None,
    }
    return base | more


def write(tmp_path, name, rows):
    path = tmp_path / name
    if name.endswith("jsonl"):
        path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    elif name.endswith("json"):
        path.write_text(json.dumps(rows))
    return str(path)


@pytest.mark.parametrize(("change", "text"), [
    ({"txid": "zz"}, "txid must contain 64 hexadecimal characters"), ({"src_ip": "300.1.1.1"}, "'300.1.1.1' does not appear to be an IPv4 or IPv6 address"), ({"src_port": 70000}, "Port outside 1..65535"),
    ({"input_amounts": ["1.000000001"]}, "BTC amount must be finite, nonnegative, and have at most 8 decimals"), ({"output_addresses": []}, "output_addresses must be a nonempty array"), ({"timestamp": "2025-01-01T00:00:00"}, "timestamp needs an explicit timezone"),
    ({"fee": "0.5"}, "Reported fee disagrees with input minus output amounts"), ({"output_amounts": ["2"]}, "Outputs exceed inputs; coinbase/partial records require a separate adapter"), ({"input_addresses": ["a b"]}, "Address identifiers must be nonempty strings without whitespace (max 200)"),
    ({"input_amounts": ["x"]}, "Invalid BTC amount"), ({"input_amounts": ["1", "2"]}, "input address/amount array lengths differ"), ({"vsize": 0}, "vsize must be a positive integer up to 4,000,000"), ({"geo_country": "USA"}, "geo_country must be a two-letter code or blank"),
    ({"asn": "AS4294967296"}, "ASN outside valid range"), ({"transaction_id": "b" * 64}, "Ambiguous field mapping for txid"), ({"input_addresses": "nope"}, "input_addresses must be a JSON array"), ({"input_amounts": ["NaN"]}, "BTC amount must be finite, nonnegative, and have at most 8 decimals"),
])
def test_first_failing_check(spark, tmp_path, change, text):
    got = normalize(read_records(spark, write(tmp_path, "r.jsonl", [record(**change)]))).first()
    assert got.error == text and got.txid is None


def test_good_record(spark, tmp_path):
    rows = [record(txid=" " + "A" * 64, timestamp="2025-01-01T02:00:00.123456+02:00", src_ip="2001:DB8:0::1", asn="AS65000", geo_country="de", surprise=1, input_amounts=["21000000"], output_amounts=["20999999.99999999"], fee=None)]
    got = normalize(read_records(spark, write(tmp_path, "r.jsonl", rows))).first()
    assert got.error is None and got.txid == "a" * 64 and str(got.timestamp) == "2025-01-01 00:00:00.123456" and got.src_ip == "2001:db8::1" and got.asn == 65000 and got.geo_country == "DE"
    assert got.input_sats == [2_100_000_000_000_000] and got.fee_sats == 1 and got.reported_fee_sats is None and got.unmapped == ["surprise"] and got.geo_source == "input_metadata_unverified"


def test_formats_agree(spark, tmp_path):
    rows = made("test", 8)[0][:30]
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in rows[0].items())
    sinks.write_samples(spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", kinds).alias("r")).select("r.*").coalesce(1), str(tmp_path / "out"))
    import glob

    paths = {"jsonl": write(tmp_path, "a.jsonl", rows), "array": write(tmp_path, "b.json", rows), "object": write(tmp_path, "c.json", {"records": rows})}
    for end in ("csv", "xml"):
        part = glob.glob(str(tmp_path / "out" / end / "part*"))[0]
        (tmp_path / f"s.{end}").write_bytes(open(part, "rb").read())
        paths[end] = str(tmp_path / f"s.{end}")
    good = {}
    for name, path in paths.items():
        got = normalize(read_records(spark, path))
        assert got.filter("error IS NOT NULL").count() == 0, name
        good[name] = sorted(map(str, got.drop("ordinal", "raw", "unmapped").collect()))
    assert len({str(g) for g in good.values()}) == 1 and len(good["csv"]) == 30
    with pytest.raises(ValueError):
        read_records(spark, "x.pdf")


def test_ingest(spark, tmp_path):
    other = record(txid="b" * 64, src_ip="192.0.2.78", timestamp="2025-01-03T00:00:01Z")
    rows = [record(), record(), record(src_ip="192.0.2.79", extra=1), record(vsize=201), "", "{bad", other]
    path = write(tmp_path, "case.jsonl", rows)
    case = ing.Case(spark, str(tmp_path / "case"))
    exits = spark.createDataFrame([("192.0.2.77",)], "ip string")
    got = ing.ingest(case, path, tor=(exits, "2025-01-01T00:00:00Z", "2025-01-02T00:00:00Z"))
    assert (got["accepted"], got["duplicates"], got["quarantined"], got["new_transactions"]) == (3, 1, 3, 2)
    assert got["unmapped_fields"] == ["extra"] and got["timestamp_gap_warnings"] == [(7, 172801.0)]
    assert sorted(r.error for r in case.table("quarantine").collect()) == ["Blank JSONL record", "Conflicting blockchain fields for an existing TXID", "Invalid JSON record"]
    assert {r.src_ip: r.tor_exit for r in case.observations().collect()} == {"192.0.2.77": True, "192.0.2.79": False, "192.0.2.78": None}
    assert ing.ingest(case, path)["already_ingested"]
    case.publish("scored", {"alerts": spark.range(1), "audit": case.event(event="scored")})
    assert case.alerts().count() == 1
    second = ing.ingest(case, write(tmp_path, "more.jsonl", [record(timestamp="2024-12-31T00:00:00Z"), record(vsize=9)]))
    assert (second["accepted"], second["new_transactions"], second["quarantined"]) == (1, 0, 1)
    assert str(case.transactions().filter(F.col("txid") == "a" * 64).first().first_seen) == "2024-12-31 00:00:00"
    assert views.violations(case.accepted(), case.flows(), case.transactions()).count() == 0
    chain = audit.verify(case.table("audit"))
    assert chain["valid"] and chain["rows"] == 7 + 2 + 1 + 2 + 2 and case.alerts() is None
    tampered = case.flows().withColumn("amount_sats", F.col("amount_sats") + F.when(F.col("direction") == "output", 1).otherwise(0))
    assert {r.kind for r in views.violations(case.accepted(), tampered, case.transactions()).collect()} == {"flow"}
    strict = ing.ingest(ing.Case(spark, str(tmp_path / "strict")), path, max_gap_seconds=3600.0)
    assert strict["quarantined"] == 4
    with pytest.raises(ValueError):
        ing.ingest(case, write(tmp_path, "none.json", []))
    seen = preview(spark, path)
    assert "txid" in seen["fields"] and seen["first"]["ordinal"] == 1


def test_an_ingest_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    from trailweave.plans import integrity

    case = ing.Case(spark, str(tmp_path / "case"))
    one = write(tmp_path, "one.jsonl", [record(), record(txid="b" * 64)])
    assert ing.ingest(case, one)["accepted"] == 2
    two = write(tmp_path, "two.jsonl", [record(txid="c" * 64), record(txid="zz")])
    rename = ing.Case.batches
    monkeypatch.setattr(ing.Case, "batches", lambda self: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        ing.ingest(case, two)
    monkeypatch.setattr(ing.Case, "batches", rename)
    assert case.accepted().count() == 2 and case.table("quarantine").count() == 0 and integrity.verify_state(case)["valid"]
    again = ing.ingest(case, two)
    assert (again["accepted"], again["quarantined"]) == (1, 1) and case.accepted().count() == 3
    state = integrity.verify_state(case)
    assert state["valid"] and audit.verify(case.table("audit"))["rows"] == state["rows"]
    flows = case.flows()
    assert integrity.verify_state(case, flows.withColumn("amount_sats", F.col("amount_sats") + 1))["problems"] == {"flow disagrees with its records": 3}
    records, chain = case.accepted(), case.table("audit")
    kinds = lambda r: {x.kind for x in views.unproved(r, chain, ing.record_digest()).collect()}
    assert kinds(records) == set() and kinds(records.filter(F.col("txid") != "c" * 64)) == {"audited record is missing"}
    assert kinds(records.withColumn("asn", F.lit(1).cast("long"))) == {"record or its provenance was altered"}


def test_references_are_stored(spark, tmp_path):
    case = ing.Case(spark, str(tmp_path / "case"))
    ing.ingest(case, write(tmp_path, "one.jsonl", [record()]))
    case.publish("scored", {"alerts": spark.range(1), "audit": case.event(event="scored")})
    (tmp_path / "s.csv").write_text("address,source\nwallet-a,list\nwallet-a,list\n")
    assert ing.import_references(case, str(tmp_path / "s.csv"), "seeds") == 1
    assert case.alerts() is None and [r.address for r in case.references("seeds").collect()] == ["wallet-a"] and case.references("exchanges") is None
    assert audit.verify(case.table("audit"))["valid"]
    with pytest.raises(ValueError):
        ing.import_references(case, str(tmp_path / "s.csv"), "friends")


def test_dossiers_are_sealed(spark, tmp_path):
    from trailweave.plans import integrity

    path = str(tmp_path / "d")
    integrity.write_dossier({"a": spark.range(5), "b": spark.createDataFrame([("x", None)], "t string, n int")}, path)
    assert integrity.verify_dossier(spark, path) == []
    spark.range(6).write.mode("overwrite").parquet(f"{path}/a")
    assert integrity.verify_dossier(spark, path) == ["a"]


def test_xml_of_any_names(spark, tmp_path):
    path = tmp_path / "r.xml"
    path.write_text("<records><record><txid>1.50</txid><mystery_field>m</mystery_field><list><item>a</item><item>b</item></list></record><transaction><when>now</when><list><item>c</item></list></transaction></records>")
    assert [r.fields for r in readers.read_records(spark, str(path)).orderBy("ordinal").collect()] == [{"txid": "1.50", "mystery_field": "m", "list": '["a","b"]'}, {"when": "now", "list": '["c"]'}]
    path.write_text('<!DOCTYPE x [<!ENTITY e "v">]><records><record><txid>&e;</txid></record></records>')
    with pytest.raises(ValueError):
        readers.read_records(spark, str(path))


def test_geo_ranges(spark):
    key = lambda ip: spark.createDataFrame([(ip,)], "ip string").select(values.ip_key("ip")).first()[0]
    spans = [("198.0.0.0", "198.255.255.255", "AA", 1), ("198.51.100.0", "198.51.100.255", "BB", 2), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "CC", 3)]
    ranges = spark.createDataFrame([(key(a), key(b), c, n) for a, b, c, n in spans], "first string, last string, geo_country string, asn long")
    rows = spark.createDataFrame([("198.51.100.7", "XX", None, "u"), ("198.7.7.7", None, 9, "u"), ("2001:db8::5", None, None, "u"), ("9.9.9.9", "XX", 9, "u"), (None, "YY", None, "u")], "src_ip string, geo_country string, asn long, geo_source string")
    assert {(r.src_ip, r.geo_country, r.asn) for r in ing.enrich_geo(rows, ranges).collect()} == {("198.51.100.7", "BB", 2), ("198.7.7.7", "AA", 1), ("2001:db8::5", "CC", 3), ("9.9.9.9", "XX", 9), (None, "YY", None)}


def test_references_and_repair(spark, tmp_path):
    good, bad = tmp_path / "r.csv", tmp_path / "bad.csv"
    good.write_text("address,source,currency\nabc,list,XBT\ndef,list,\n")
    bad.write_text("address,source,currency\nabc,list,ETH\n")
    assert {r.currency for r in references.read_references(spark, str(good)).collect()} == {"XBT"}
    with pytest.raises(ValueError):
        references.read_references(spark, str(bad))
    rows = spark.createDataFrame([(["a", "b", "c"], [100], ["x"], [99], 5), (["a"], [10], ["x", "y"], [6, 6], 0), (["a"], [10], ["x"], [99], 0)], "input_addresses array<string>, input_sats array<long>, output_addresses array<string>, output_sats array<long>, fee_sats long")
    out = references.repair(rows).collect()
    assert out[0].input_sats == [34, 33, 33] and out[0].aggregate_input and out[0].fee_sats == 1 and out[1].output_sats == [6, 4] and out[1].rounding_overflow and out[2].unsupported


def test_values_and_guard(spark):
    row = spark.createDataFrame([("=1+1", 5), ("plain", 123456789)], "t string, s long")
    assert [r[0] for r in row.select(sinks.formula_guard(F.col("t"))).collect()] == ["'=1+1", "plain"]
    assert [r[0] for r in row.select(values.btc_text(F.col("s"))).collect()] == ["0.00000005", "1.23456789"]
    text = row.select(values.canonical({"b": F.lit("é"), "a": F.lit(None).cast("int")})).first()[0]
    assert text == '{"a":null,"b":"é"}'


def test_profiles_of_a_case(spark, tmp_path):
    rows, labels = made("test", 20)
    case = ing.Case(spark, str(tmp_path / "case"))
    got = ing.ingest(case, write(tmp_path, "all.jsonl", rows))
    assert got["quarantined"] == 0 and got["accepted"] + got["duplicates"] == len(rows)
    out = ft.profiles(case.flows(), case.transactions(), case.observations()).toPandas()
    assert set(out.address) == {r[0] for r in labels} and list(out.columns) == ["address", "n", *ft.FEATURES] and len(ft.FEATURES) == 24
    assert not out.isna().any().any() and (out.seed_hop_distance == 7).all()


def test_streams(spark, tmp_path):
    from trailweave.streaming import windows

    source = tmp_path / "in"
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("src_ip"), F.col("id").cast("string").alias("txid"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20 + F.when(F.col("id") > 120, 100_000).otherwise(0)).alias("timestamp"))
    rows.coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(source))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    batch = rows.groupBy(F.window("timestamp", "1 hour").start.alias("hour")).count()
    got = run(windows.hourly_counts(stream()), "hours")
    assert got.count() > 0 and got.join(batch, "hour").filter("n <> count").count() == 0
    assert run(windows.first_of_each(stream()), "firsts").count() == 200
    pairs = run(windows.relay_pairs(stream(), stream()), "pairs")
    assert {(int(r.txid), int(r.other_txid)) for r in pairs.collect()} == {(i, i + 3) for i in range(197) if (i <= 120) == (i + 3 <= 120)}
    gaps = run(windows.running_gaps(stream(), "src_ip", late="10 minutes"), "gaps")
    assert gaps.count() == 3
    assert run(windows.sessions(stream(), "src_ip"), "runs").count() >= 3


def test_json_files_stay_small(spark, tmp_path, monkeypatch):
    """More orders are more files: no group of records that is written as one row grows with the table."""
    from trailweave.plans import source_queries

    monkeypatch.setattr(source_queries, "FILE_ROWS", 40)
    seen = []
    monkeypatch.setattr(source_queries.readers, "read_records", lambda s, path: seen.append(path) or read_records(s, path))
    got = source_queries.read_json_records(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert got.count() == n
    longest = spark.read.text(seen[0], wholetext=True).select(F.max(F.regexp_count("value", F.lit('"txid"')))).first()[0]
    assert longest < 120 < n // 10


def test_xml_is_read_for_the_kinds_that_occur(spark, tmp_path):
    """A kind of element that no file names costs no pass; texts that merely end like its name don't either."""
    record = "<records><record><txid>{}</txid><memo>a transaction</memo></record>{}</records>"
    for name, more in (("one", ""), ("two", "<transaction><txid>t</txid></transaction>")):
        (tmp_path / f"{name}.xml").write_text(record.format(name, more))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    one, two = (readers.read_records(spark, str(tmp_path / f"{n}.xml")) for n in ("one", "two"))
    assert [r.fields["txid"] for r in one.orderBy("ordinal").collect()] == ["one"] and [r.fields["txid"] for r in two.orderBy("ordinal").collect()] == ["two", "t"]
    assert 0 < 2 * scans(one) == scans(two)


def test_checks_are_made_once(spark):
    """A filter on the error reads its column; it doesn't repeat all checks of a record."""
    from trailweave.sources.normalize import SAYS, normalize

    rows = spark.createDataFrame([(1, {"txid": "x"}, "{}", None)], "ordinal long, fields map<string,string>, raw string, parse_error string")
    good = normalize(rows).filter("error IS NULL").select("txid", "timestamp", "fee_sats")
    assert good._jdf.queryExecution().optimizedPlan().toString().count(SAYS["txid"]) == 1
    assert [r.error for r in normalize(rows).collect()] == [SAYS["txid"]]


def test_json_records_are_written_small(spark, tmp_path, monkeypatch):
    """The files take a fraction of their text, and so do the elements that are cut from them; no record is lost by it."""
    from trailweave.plans import source_queries
    from trailweave.sources import jsonarray

    monkeypatch.setattr(source_queries, "shared_folder", lambda s, label: str(tmp_path / label))
    monkeypatch.setattr(jsonarray, "shared_folder", lambda s, label: str(tmp_path / label), raising=False)
    got = source_queries.read_json_records(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    files = [p for p in (tmp_path / "records").rglob("part-*") if p.is_file()]
    text = spark.read.text(str(tmp_path / "records/all.json"), wholetext=True).agg(F.sum(F.length("value"))).first()[0]
    assert len(files) == 16 and sum(p.stat().st_size for p in files) < text / 4
    assert sum(p.stat().st_size for p in (tmp_path / "json_elements").glob("part-*")) < text / 4
