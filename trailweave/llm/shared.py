"""Tables in the folder that the driver and all executors share, and small tables made from literals.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``: such a table survives the loss of any
executor, is read by columns, and goes when the application ends.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set where the session names none and driver and tasks are one machine."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="trailweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/trailweave-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, names: tuple[str, ...], work) -> DataFrame:
    """The rows that ``work`` makes of ``df``, with the columns of ``df`` as they were.

    Columns that ``work`` makes too, by one of ``names``, wait under other names meanwhile.
    """
    taken = {c: f"_tw_kept_{i}" for i, c in enumerate(df.columns) if c.lower() in names}
    out = work(df.withColumnsRenamed(taken))
    return out.select(*[F.col(f"`{taken.get(c, c)}`").alias(c) for c in df.columns])


def literal_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A table of the given rows (lists of values in the order of ``ddl``), made by SQL functions alone."""
    fields = [c.split() for c in ddl.split(",")]
    text = json.dumps([dict(zip([n for n, _ in fields], r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{','.join(f'{n}:{t}' for n, t in fields)}>>")))


def replace_columns(df: DataFrame, **columns) -> DataFrame:
    """``df`` with the columns given; a column of ``df`` that has such a name gives way."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[c.alias(n) for n, c in columns.items()])


def extended(df: DataFrame, columns: dict[str, str]) -> StructType:
    """The schema of ``df`` with further columns (names and types)."""
    out = StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out.add(name, kind)
    return out
