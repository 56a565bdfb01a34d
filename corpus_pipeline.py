"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents; the last returns the pieces of the packed sequences with their token ids.
Before each stage the executors give back the heap that those before it grew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.llm import near, packing, quality, suffix, toxicity
from stratolog.llm.shared import Workspace, give_back


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    give_back(spark)
    return toxicity.toxicity_filter(docs, toxicity.model_for(spark, sf_dir, docs))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality table."""
    give_back(spark)
    return quality.quality_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    give_back(spark)
    return near.near_dedup(docs)


def cut_long_matches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of smaller doc_ids; n_chars follows the text."""
    give_back(spark)
    out = suffix.drop_matches(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    give_back(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_low_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_long_matches),
    ("packing", pack_sequences),
]

#: Learned scores and a tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents, each stage's result written and read again."""
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
