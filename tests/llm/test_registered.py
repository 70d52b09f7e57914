"""Registered queries of the subpackage against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from trailweave.llm.queries import ORACLES, QUERIES
from trailweave.session import ship

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_query(spark, name):
    got = QUERIES[name](ship(spark), str(DIR))
    columns = sorted(got.columns)
    assert len(columns) == len(set(columns))
    found = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    if name in ORACLES:
        c = duckdb.connect()
        for p in DIR.glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        want = c.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert found == sorted((tuple(dict(zip(names, r, strict=True))[n] for n in columns) for r in want.fetchall()), key=repr)
