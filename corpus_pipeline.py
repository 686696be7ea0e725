"""A training corpus from raw documents: five stages, each written down and read again before the next.

Stages take (spark, docs, sf_dir) and keep the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from stratafold.llm import decontam, langid, neardup, packing, toxicity
from stratafold.llm._spark import discard, scratch, stored


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that language identification rejects go."""
    return langid.drop_unknown(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic. The network learns from the labelled among `docs`."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language", recognised), ("toxicity", civil), ("near_duplicates", distinct), ("decontamination", clean), ("packing", packed)]

#: The stages learn models, so SQL cannot express them; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch() as keep:  # what a stage has written for itself goes with it
            out = stored(stage(spark, docs, sf_dir), name)
            keep(out)
        discard(docs)
        docs = out
    return docs
