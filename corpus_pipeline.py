"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before wrote and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import bbit_minhash, exact_index, mixing, packing, quality_fm
from framewise.llm.queries import remainder, vocabulary
from framewise.llm.shared import Scratch

REJECT_BELOW = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject. It learns from four fifths of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counted = remainder(5) != 0
    model = quality_fm.train(docs, labels.where(counted), usable=counted)
    return quality_fm.score(docs, model).where(F.col("quality_score") >= REJECT_BELOW).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_index.unique_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal texts: five-word shingles, similarity 0.8."""
    return bbit_minhash.survivors(docs, Scratch(spark, "near"), k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; one that is taken in two passes appears twice."""
    rows = mixing.mixed_documents(docs, mixing.mix(docs, Scratch(spark, "mixing")))
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens: one row per piece of a document, with its ids."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The classifier, the draws of the mix and the tokens are beyond SQL; tests/llm/test_pipeline.py checks run() stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
