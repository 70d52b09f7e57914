"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def session(app: str = "trailweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on: UTC, adaptive plans and skew joins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    return builder.config(map=settings).getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set where the session names none and all run on one machine."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="trailweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, which goes when the application ends."""
    path = f"{shared_root(spark)}/trailweave-{uuid.uuid4().hex}/{label}"
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(top)
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(top)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage and outlives any executor."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(writer: DataFrameWriter) -> DataFrameWriter:
    """For big tables that lie there for a while: a third smaller than by the default, at little more time."""
    return writer.option("compression", "zstd")


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes folders of the shared one that nothing reads any more, long before the application ends."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """A query's shuffle files go when it ends; else they lie there until the driver collects its garbage, however many steps follow."""
    had = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, had)


_PARTITIONS, _GIVEN = "spark.sql.shuffle.partitions", "trailweave.shuffle.partitions"
#: The size that adaptive plans join shuffle partitions up to.
_JOINED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Bytes of a table's files for which one shuffle partition is enough.
PARTITION_BYTES = 8 << 20


def spread(spark: SparkSession, path: str) -> str:
    """``path``, after the session has as many shuffle partitions as its files call for, so that a task's memory doesn't grow with them.

    The number is only raised; adaptive plans join partitions that turn out small, up to ``PARTITION_BYTES`` unless the
    session says how far.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    had = int(spark.conf.get(_PARTITIONS))
    if (wanted := -(-size // PARTITION_BYTES)) > had:
        if spark.conf.get(_GIVEN, None) is None:
            spark.conf.set(_GIVEN, str(had))
        spark.conf.set(_PARTITIONS, str(wanted))
    if spark.conf.get(_JOINED, None) is None:
        spark.conf.set(_JOINED, str(PARTITION_BYTES))
    return path


@contextmanager
def as_given(spark: SparkSession) -> Iterator[None]:
    """The number of shuffle partitions that the session had before ``spread``: a stream has a state store for each, in every batch."""
    had = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, spark.conf.get(_GIVEN, had))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, had)


_shipped: set[str] = set()
#: Rows that a Python worker gets at once, and their setting.
BATCH_ROWS, _BATCH = 2048, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for an application, wherever the driver runs.

    Where the session leaves open how many rows go to a Python worker at once, whole texts are many bytes a row: it is
    set to ``BATCH_ROWS``.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, "-1") == "-1":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(os.path.realpath(tempfile.mkdtemp())) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
