"""A training-corpus pipeline: each stage applies one operator of
``tessera.llm`` to all that the stage before it kept.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns are treated as each operator's docstring states; every stage but the
last returns all columns of its documents, and an empty table stays empty.

``run`` writes every stage as Parquet in the shared folder and reads it again,
so a lost executor costs at most the running stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, decontaminate, quality, simhash, toxicity
from tessera.llm.common import stage
from tessera.llm.queries import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token digests of what is left."""
    return byte_bpe.round_trip(docs)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("simhash_dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("byte_bpe", encode)]

#: trained models, fingerprints and tokenizers cannot be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
