"""Reviews of a case's alerts."""

import math

import pytest
from pyspark.sql import functions as F

from trailweave.plans import audit, index, triage
from trailweave.sources.ingest import Case

ROWS = "address string, n long, taint double, fused_percentile double, graph_score double, rule_score double, drift_score double, log_median_gap_seconds double, relay_associations double, network_coverage double"


@pytest.fixture
def case(spark, tmp_path):
    out = Case(spark, str(tmp_path / "case"))
    rows = spark.createDataFrame([(f"w{i}", 3, 0.1 * i, 0.2 * i, None, 0.3, 0.0, 2.0, 1.0 * i, 1.0) for i in range(5)], ROWS)
    rule = F.array(F.struct(F.lit("Address reuse").alias("name"), F.lit(0.3).alias("strength"), F.array(F.lit("t")).alias("txids")))
    rows = rows.withColumn("rules", F.when(F.col("address") == "w0", F.filter(rule, lambda r: F.lit(False))).otherwise(rule))
    out.publish("scored", {"alerts": index.case_note(index.fracture_index(rows)), "audit": out.event(event="scored")})
    return out


def test_a_false_positive_changes_weights_once(case):
    one = case.alerts().filter("address = 'w3'").first()
    got = triage.review(case, "w3", "Dismissed", "a known exchange", True)
    cut = {k: max(0.01, w * math.exp(-index.FEEDBACK_RATE * (one.subscores[k]["value"] or 0))) for k, w in index.WEIGHTS.items()}
    assert got["weights_changed"] and got["version"] == 2 and got["weights_after"] == {k: v / sum(cut.values()) for k, v in cut.items()}
    assert triage.weights(case) == (2, got["weights_after"])
    for r in case.alerts().collect():
        assert r.priority == pytest.approx(100 * sum((r.subscores[k]["value"] or 0) * w for k, w in got["weights_after"].items()), abs=0.006) and r.subscores.taint.weight == got["weights_after"]["taint"]
    again = triage.review(case, "w3", "Dismissed", "still the exchange", True)
    assert not again["weights_changed"] and again["version"] == 2 and triage.weights(case) == (2, got["weights_after"])
    other = triage.review(case, "w2", "Dismissed", "a known merchant", True)
    assert other["version"] == 3 and other["weights_before"] == got["weights_after"]
    assert audit.verify(case.table("audit"))["valid"] and case.table("audit").count() == 6


def test_reviews_outdate_no_alerts(case, spark):
    assert {r.status for r in triage.alert_view(case).collect()} == {"New"}
    before = sorted(map(str, case.alerts().collect()))
    triage.review(case, "w1", "Triaging", "looks odd to me")
    triage.review(case, "w1", "Escalated", " shared with others ")
    assert sorted(map(str, case.alerts().collect())) == before
    view = triage.alert_view(case).collect()
    assert [r.priority for r in view] == sorted((r.priority for r in view), reverse=True)
    own = {r.address: r for r in view}
    assert own["w1"].status == "Escalated" and [(x.status, x.reason) for x in own["w1"].reviews] == [("Triaging", "looks odd to me"), ("Escalated", "shared with others")] and own["w2"].reviews == []
    case.publish("seeds", {"references_seeds": spark.createDataFrame([("w1", "list")], "address string, source string")})
    assert case.alerts() is None and triage.alert_view(case) is None
    with pytest.raises(KeyError):
        triage.review(case, "w1", "Triaging", "after new seeds")


@pytest.mark.parametrize("given", [("w1", "Closed", "a long reason", False), ("w1", "Triaging", "ok", False), ("w1", "Escalated", "a long reason", True)])
def test_bad_reviews_are_refused(case, given):
    with pytest.raises(ValueError):
        triage.review(case, *given)
    assert case.table("reviews") is None


def test_evidence_is_the_union_of_rules_changes_and_taint(spark):
    from trailweave.plans import views

    rule = "array<struct<name:string,strength:double,txids:array<string>>>"
    alerts = spark.createDataFrame([("a", [("r", 0.5, ["t1", "t2"])], ["t0"]), ("b", [], ["t7", "t8"]), ("c", [], ["t9"])], f"address string, rules {rule}, txids array<string>")
    assert {r.txid for r in views.evidence_transactions(alerts).collect()} == {"t1", "t2", "t7", "t9"}
    changes = spark.createDataFrame([("b", "t3", ["t4"], ["t5", "t1"]), ("z", "t99", [], None)], "address string, txid string, before_txids array<string>, after_txids array<string>")
    tainted = spark.createDataFrame([("a", ["t6"]), ("z", ["t98"])], "address string, path array<string>")
    assert sorted(r.txid for r in views.evidence_transactions(alerts, changes, tainted).collect()) == ["t1", "t2", "t3", "t4", "t5", "t6", "t9"]
