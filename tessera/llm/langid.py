"""Operator 7, language identification: sparse multinomial logistic regression
on TF-IDF character n-grams, trained with follow-the-regularised-leader
(per-coordinate steps, L1 and L2 penalties), then calibrated by one
temperature.

TF is an n-gram's count in a hundred of its document's n-grams and IDF comes from the
document counts of *all* rows learned from. Gradient descent sees a bounded,
documented sample (``Settings.sample`` rows a language, in expectation). A
score is linear in the n-grams, so texts of any length are read whole.

Defined results: a null text or one without a letter gets ``und`` and score 0,
as does every text when nothing was learned; a null id is never learned from
nor held out; repeated rows are judged alike; an empty table gives an empty
result. Columns besides the named ones are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import in_fold, prepare, remainder, text_of, text_udf
from tessera.llm.ngrams import Ngrams

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    ngrams: Ngrams = field(default_factory=lambda: Ngrams(chars=(1, 2, 3), words=0, bits=16))
    sample: int = 2500
    epochs: int = 6
    batch: int = 32
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 0.01
    #: share of the sample kept back for the temperature
    calibration: float = 0.15
    seed: int = 11


@dataclass
class LanguageModel:
    ngrams: Ngrams
    languages: list[str]
    #: per bucket and language, IDF already in it
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        n, k = len(texts), len(self.languages)
        if not k:
            return [(UNKNOWN, 0.0)] * n
        logits, count = np.zeros((n, k)), np.zeros(n)
        for who, what in self.ngrams.passes(texts):
            if not len(who):
                continue
            lo = int(who.min())
            size = int(who.max()) - lo + 1
            count[lo:lo + size] += np.bincount(who - lo, minlength=size)
            for j in range(k):
                logits[lo:lo + size, j] += np.bincount(who - lo, weights=self.weight[j][what], minlength=size)
        p = _softmax((logits / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(1)
        return [(self.languages[b], float(p[i, b])) if any(map(str.isalpha, t)) else (UNKNOWN, 0.0)
                for i, (t, b) in enumerate(zip(texts, best))]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _document_counts(ngrams: Ngrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mark = np.zeros(ngrams.buckets, dtype=np.int64), np.zeros(ngrams.buckets, dtype=bool)
        for batch in batches:
            for text in batch.column(0):
                what = ngrams.of(text.as_py())
                mark[what] = True
                counts += mark
                mark[what] = False
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    return run


def _features(ngrams: Ngrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns = [], []
            for text in batch.column(0):
                i, n = np.unique(ngrams.of(text.as_py()), return_counts=True)
                ids.append(i.astype(np.int32))
                ns.append((100 * n / max(n.sum(), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.float32()))], ["y", "ids", "tf"])

    return run


def fit(rows: DataFrame, settings: Settings = Settings()) -> LanguageModel:
    """Learn from ``rows`` (``k`` id, ``x`` text, ``y`` language, none null).
    The driver holds one weight vector a language, so languages are taken to
    be a bounded set."""
    from tessera.llm.subword_model import _lists
    prepare(rows.sparkSession)
    ng = settings.ngrams
    per = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(per)
    if not languages:
        return LanguageModel(ng, [], np.zeros((0, ng.buckets), np.float32), np.zeros(0), 1.0)
    found = (rows.select("x").mapInArrow(_document_counts(ng), "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    seen = np.zeros(ng.buckets)
    seen[found["bucket"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + sum(per.values())) / (1 + seen)) + 1
    scale = 1 << 30
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, int(min(1.0, settings.sample / per[lang]) * scale))])
    drawn = rows.filter(F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(settings.seed)), F.lit(scale)) < share[F.col("y")])
    table = drawn.select("x", "y").mapInArrow(_features(ng), "y string, ids array<int>, tf array<float>").toArrow().combine_chunks()
    y = np.array([languages.index(v) for v in table["y"].to_pylist()], dtype=np.int64)
    ids = [v.astype(np.int64) for v in _lists(table["ids"])]
    tf = [v.astype(np.float64) * idf[i] for v, i in zip(_lists(table["tf"]), ids)]
    order = sorted(range(len(y)), key=lambda i: (int(y[i]), ids[i].tobytes(), tf[i].tobytes()))
    rng = np.random.default_rng(settings.seed)
    order = [order[i] for i in rng.permutation(len(order))]
    held = order[:int(len(order) * settings.calibration)]
    W, b = _ftrl([ids[i] for i in order[len(held):]], [tf[i] for i in order[len(held):]], y[order[len(held):]], len(languages), ng.buckets, settings, rng)
    logits = np.array([tf[i] @ W[:, ids[i]].T + b for i in held]).reshape(len(held), len(languages))
    return LanguageModel(ng, languages, (100 * W * idf).astype(np.float32), b, _temperature(logits, y[held]))


def _ftrl(ids, tf, y, k: int, size: int, s: Settings, rng) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-Proximal over minibatches; the column after the last bucket is the
    bias, which is not penalised."""
    z, n = np.zeros((k, size + 1)), np.zeros((k, size + 1))

    def weights(at):
        zz, root = z[:, at], np.sqrt(n[:, at])
        l1 = np.where(at == size, 0.0, s.l1)
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((s.beta + root) / s.alpha + s.l2))

    for _ in range(s.epochs):
        shuffled = rng.permutation(len(y))
        for lo in range(0, len(y), s.batch):
            rows = shuffled[lo:lo + s.batch]
            lens = np.array([len(ids[i]) + 1 for i in rows])
            flat = np.concatenate([np.append(ids[i], size) for i in rows])
            value = np.concatenate([np.append(tf[i], 1.0) for i in rows])
            doc = np.repeat(np.arange(len(rows)), lens)
            at, inverse = np.unique(flat, return_inverse=True)
            w = weights(at)
            logits = np.stack([np.bincount(doc, weights=value * w[j][inverse], minlength=len(rows)) for j in range(k)], axis=1)
            p = _softmax(logits)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = np.stack([np.bincount(inverse, weights=value * p[doc, j], minlength=len(at)) for j in range(k)])
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / s.alpha
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    w = weights(np.arange(size + 1))
    return w[:, :size], w[:, size]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss on rows kept back (golden section on
    its logarithm); 1 without rows."""
    if not len(y):
        return 1.0

    def loss(t):
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(y)), y]).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit_languages(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", settings: Settings = Settings()) -> LanguageModel:
    """Learn from text and non-null language of rows whose id remainder (crc32
    mod 4) is not 2."""
    rows = (docs.filter((remainder(key, 4) != 2) & F.col(text).isNotNull() & F.col(lang).isNotNull())
            .select(F.col(key).alias("k"), text_of(text).alias("x"), F.col(lang).cast("string").alias("y")))
    return fit(rows, settings)


def identify(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(fit_languages(docs, text, key, lang, settings))

    def make():
        model = sent.value

        def step(texts):
            return [{"lang_pred": a, "score": b} for a, b in model.predict(list(texts))]
        return step

    udf = text_udf(make, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return docs.select(F.col(key).alias("doc_id"), in_fold(key, 4, 2).alias("held_out"), udf(text_of(text)).alias("r")).select("doc_id", "held_out", "r.*")
