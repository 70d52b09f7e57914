"""Sinks: case exports as CSV, JSON lines and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def formula_guard(c: Column) -> Column:
    """Texts that a spreadsheet would read as a formula get a leading apostrophe."""
    return F.when(c.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_alerts_csv(alerts: DataFrame, path: str) -> None:
    """Flat columns of ranked alerts; every text is guarded."""
    columns = [formula_guard(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in alerts.dtypes if not t.startswith(("array", "map", "struct"))]
    alerts.orderBy(F.desc("priority"), "address").select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_audit_log(audit: DataFrame, path: str) -> None:
    audit.orderBy("seq").write.mode("overwrite").json(path)


def write_samples(records: DataFrame, path: str, rows: int = 30) -> None:
    """The first records as JSON lines, CSV (arrays as JSON text) and XML."""
    first = records.limit(rows)
    first.write.mode("overwrite").json(f"{path}/json")
    flat = first.select(*[F.to_json(n).alias(n) if t.startswith("array") else F.col(n) for n, t in first.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")
    listed = first.select(*[F.struct(F.col(n).alias("item")).alias(n) if t.startswith("array") else F.col(n) for n, t in first.dtypes])
    listed.write.mode("overwrite").option("rowTag", "record").option("rootTag", "records").format("xml").save(f"{path}/xml")
