"""A corpus pipeline of the operators in ``tessera.llm``; each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, mixing, neardup, tokens
from tessera.llm.common import settle, table

#: A document whose pooled language probability is below this is rejected, as is one of unknown language.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows."""
    return langid.keep_known(docs, langid.train(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one that is read in two epochs is there twice."""
    return mixing.mix(docs, mixing.domain_of(F.col("source")), mixing.RECIPE, docs.columns).select("doc.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and what the files say of each document."""
    return tokens.token_output(docs, tokens.default_tokenizer())


STAGES = [("language id", language_id), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing to target weights", mixture), ("token-id output", token_output)]

#: Language ID and alignment cannot be put in SQL; tests/llm/test_pipeline.py holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs
