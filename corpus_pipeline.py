"""From raw documents to packed training sequences, in stages that each keep their result.

Every stage but the last returns the columns of ``documents``. ``run`` applies them in order
and writes what each but the last returns as a table in the shared folder, so that a later
stage reads its documents from there as often as it likes, and a lost executor costs no
earlier stage.

Defined cases: a document with a null or empty text fails the quality rules and goes; rows
with equal ids and texts are one group of copies, of which one stays; a table without rows
gives none; columns that the stages do not read come through the filters unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import decontaminate, neardup, packing, pii, quality
from runlens.llm.common import stash
from runlens.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go."""
    return quality.keep(docs, quality.STANDARD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return neardup.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is labelled, and terms that disclose it are generalised or removed."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in windows of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing_windows),
]

#: Tokenisation and exact set similarity over whole texts cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
