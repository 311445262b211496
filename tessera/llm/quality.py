"""Operator 6, quality classifier: supervised subword embeddings (see
``subword_model``) over words, word pairs and character n-grams.

Defined results: a null or empty text gets the bias alone; a null id is never
learned from and never held out; repeated rows are scored alike; without
labels of both classes every score is the smoothed share of class 1; an empty
table gives an empty result. Columns besides the named ones are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import subword_model as S
from tessera.llm.common import in_fold, prepare, remainder, text_of
from tessera.llm.ngrams import Ngrams

THRESHOLD = 0.3
SETTINGS = S.Settings(ngrams=Ngrams(chars=(2, 3, 4), words=2, bits=18))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                settings: S.Settings = SETTINGS) -> S.SubwordModel:
    """Fit on the labelled rows whose id remainder (crc32 mod 5) is not 0."""
    return S.fit(S.labelled(docs, labels, "quality", remainder(key, 5) != 0, text, key), settings)


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                  threshold: float = THRESHOLD, settings: S.Settings = SETTINGS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    spark = prepare(docs.sparkSession)
    udf = S.scorer(fit_quality(docs, labels, text, key, settings), spark)
    return (docs.select(F.col(key).alias("doc_id"), in_fold(key, 5, 0).alias("held_out"), udf(text_of(text))["score"].alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    spark = prepare(docs.sparkSession)
    udf = S.scorer(fit_quality(docs, labels, text, key), spark)
    return docs.filter(udf(text_of(text))["score"] >= threshold)
