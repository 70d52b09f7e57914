"""In the merged case everything takes two values at least."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="needs the test tables")


def test_rules_fire_and_not_everywhere(spark):
    rows = entry.queries()["merged_rules"](spark, str(DIR)).collect()
    everyone = {r.address for r in entry.queries()["merged_chain_features"](spark, str(DIR)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r.rule, set()).add(r.address)
    assert len(by) == 7 and all(0 < len(v) <= len(everyone) for v in by.values()) and sum(len(v) < len(everyone) for v in by.values()) >= 4


@pytest.mark.parametrize("name", ["merged_chain_features", "merged_timing_features", "merged_equal_outputs"])
def test_no_column_is_constant(spark, name):
    rows = entry.queries()[name](spark, str(DIR)).toPandas()
    assert {c for c in rows.columns if rows[c].nunique() < 2} <= {"fee_rate_available"}
