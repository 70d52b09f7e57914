"""Checks of a whole case: its audit chain, the records that it proves, the tables made of them, alerts and dossiers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.plans import audit, dossier, views
from trailweave.sources.ingest import Case, record_digest


def verify_state(case: Case, flows: DataFrame | None = None, transactions: DataFrame | None = None, expected_head: str | None = None) -> dict:
    """Whether the audit chain holds and everything stored agrees with it; ``problems`` counts what doesn't by kind."""
    chain = case.table("audit")
    state = audit.verify(chain, expected_head)
    if not state["valid"]:
        return state | {"problems": {}}
    records = case.accepted()
    problems = dict(views.unproved(records, chain, record_digest()).groupBy("kind").count().collect())
    broken = views.violations(records, flows if flows is not None else case.flows(), transactions if transactions is not None else case.transactions())
    problems |= {f"{k} disagrees with its records": n for k, n in broken.groupBy("kind").count().collect()}
    if (gone := dossier.altered_sources(case.spark, case.table("sources")).count()):
        problems["source file was altered"] = gone
    alerts = case.alerts()
    if alerts is not None:
        last = chain.filter(F.get_json_object("payload", "$.event") == "scored").agg(F.max_by("payload", "seq")).first()[0]
        if json.loads(last or "{}").get("alert_digest") != views.snapshot_digest(alerts):
            problems["alert snapshot was altered"] = 1
    return state | {"valid": not problems, "problems": problems}


def write_dossier(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a dossier, and a manifest with each one's rows and digest."""
    rows = []
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
        rows.append((name, *_sealed(table.sparkSession.read.parquet(f"{path}/{name}"))))
    next(iter(tables.values())).sparkSession.createDataFrame(rows, "name string, n long, sha256 string").coalesce(1).write.json(f"{path}/manifest")


def _sealed(table: DataFrame) -> tuple[int, str]:
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    quarters = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    got = table.agg(F.count(F.lit(1)), F.sha2(F.concat_ws(":", *quarters), 256)).first()
    return got[0], got[1]


def verify_dossier(spark, path: str) -> list[str]:
    """Names of the tables of a dossier that are not as its manifest says."""
    said = {r.name: (r.n, r.sha256) for r in spark.read.json(f"{path}/manifest").collect()}  # a few tables
    return sorted(name for name, seal in said.items() if _sealed(spark.read.parquet(f"{path}/{name}")) != seal)
