"""The corpus pipeline, stage by stage, against what each operator decides."""

import corpus_pipeline
from pyspark.sql import functions as F
from tessera.llm import byte_bpe, decontaminate, quality, simhash, toxicity
from tessera.llm.queries import table
from tests.conftest import SF_SMALL

SF = SF_SMALL.replace("0.001", "0.01")


def _decisions(spark, labels):
    return {
        "quality": lambda d: quality.score_quality(d, labels).filter("predicted = 1"),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels).filter("predicted = 0"),
        "simhash_dedup": lambda d: simhash.near_duplicates(d).filter("doc_id = component_id"),
        "decontamination": lambda d: decontaminate.decontaminate(d, table(spark, SF, "benchmark")).filter("not contaminated"),
    }


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, SF, "documents").withColumn("root", F.lit("clash")).withColumn("h", F.lit(1))
    decide = _decisions(spark, table(spark, SF, "labels"))
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert ids(kept) == ids(decide[name](docs))
        assert 0 < kept.count() < docs.count()
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids(last) == ids(docs)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF_SMALL, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SF_SMALL).count() == 0


def test_stages_on_odd_rows(spark):
    item = table(spark, SF, "benchmark").first().text
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "some words of text " * 5000, "en", "s", 9), (3, "x " + item + " y", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    decide = _decisions(spark, table(spark, SF, "labels"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns
        if name == "simhash_dedup":  # all empty texts are one group, of which the row of id 1 stays, once
            assert sorted(map(tuple, out.collect())) == sorted([rows[2], rows[4], rows[5]])
        else:
            assert ids(out) == ids(decide[name](docs))
    assert not any(r.doc_id == 3 for r in decontaminate.keep_clean(docs, table(spark, SF, "benchmark")).collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids(last) == ids(docs)
