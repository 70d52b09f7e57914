"""What goes into a dossier: the rows of an address's entity, its evidence and the sources behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.plans import views
from trailweave.sources.readers import file_hash


def dossier_tables(address: str, members: DataFrame, alerts: DataFrame, flows: DataFrame, transactions: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """alerts, transactions, observations and edges of the entity of ``address`` (members: address, entity_id)."""
    entity = members.filter(F.col("address") == address).select("entity_id")
    own = members.join(entity, "entity_id", "left_semi").select("address")
    cluster = alerts.join(own, "address", "left_semi")
    proof = views.evidence_transactions(cluster)
    txids = flows.join(own, "address", "left_semi").select("txid").unionByName(proof.select("txid")).distinct()
    return {
        "alerts": cluster, "transactions": transactions.join(txids, "txid", "left_semi"), "observations": observations.join(txids, "txid", "left_semi").orderBy("txid", "timestamp", "id"),
        "edges": views.evidence_edges(flows, observations, proof), "members": own.withColumn("ownership_verified", F.lit(False)),
    }


def altered_sources(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Rows of ``sources`` (hash, name) whose file is gone or has another hash."""
    now = []
    for r in sources.select("name").distinct().collect():  # a case has few source files
        try:
            now.append((r.name, file_hash(spark, r.name)))
        except Exception as error:  # a missing file is what is looked for
            if "FileNotFound" not in str(error) and "PATH_NOT_FOUND" not in str(error):
                raise
    found = spark.createDataFrame(now, "name string, now string")
    return sources.join(found, "name", "left").filter(~F.col("hash").eqNullSafe(F.col("now"))).drop("now")
