"""A corpus pipeline: quality, language, near-duplicates, mixing and packing, each stage written and read again.

Every stage works on all rows that the stage before kept. The stages before the last return the columns of
``documents`` as they were, whatever their names: the filters drop the rows that they reject, the near-duplicate stage
keeps one document of each component, and the mix repeats each document as often as the mix takes it (a document that
it takes no copy of goes).

Defined cases, stage by stage: null and empty texts get the share of good labels as their score (quality), are
rejected (language), are copies of one another (near-duplicates), take nothing (mixing) and are their end token alone
(packing). Repeated rows are judged alike, stay once, and repeat as their copies say. Rows without a doc_id are judged
like others; of a component they stay only where no row has one. An empty table passes through as an empty table.
Further columns stay, also those that are named like an operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import langid, mixing, neardup, packing, quality
from trailweave.llm.queries import tokenizer_path
from trailweave.llm.shared import beside, written
from trailweave.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    voters = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return beside(docs, ("score", "predicted"), lambda d: quality.score(d, voters).filter("predicted = 1"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = langid.fit(docs)
    return beside(docs, ("lang_pred", "score", "lang_rejected"), lambda d: langid.identify(d, models).filter("NOT lang_rejected"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return beside(docs, ("size", "source_size", "target", "taken", "copies"), lambda d: mixing.repeated(mixing.mix(d)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _shipped(stage):
    """The stage, after the package has been sent to the executors."""
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [(name, _shipped(stage)) for name, stage in (("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage))]

#: The stages are learnt models, hashes and tokenizers, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
