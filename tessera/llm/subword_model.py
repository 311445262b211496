"""Supervised subword embeddings: hashed word and character n-gram vectors are
averaged over a document and a softmax layer reads the average; vectors and
layer are learned together by numpy stochastic gradient descent.

The vocabulary is pruned by a chi-square test over the document counts of
*all* labelled training rows; gradient descent then runs over a bounded,
documented sample (``Settings.sample``). Because average and layer are linear,
a fitted model scores a document from one number per n-gram."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, small_broadcast, text_of
from tessera.llm.ngrams import Ngrams


@dataclass(frozen=True)
class Settings:
    ngrams: Ngrams = field(default_factory=Ngrams)
    #: rows of each class that gradient descent sees at most (in expectation)
    sample: int = 6000
    #: n-grams kept, by chi-square; each must occur in ``min_docs`` documents
    vocabulary: int = 8192
    min_docs: int = 5
    min_chi2: float = 25.0
    dim: int = 8
    epochs: int = 12
    batch: int = 64
    rate: float = 0.25
    decay: float = 1e-5
    seed: int = 7


@dataclass
class SubwordModel:
    """``weight`` and ``kept`` per n-gram bucket: what a kept n-gram adds to
    the log-odds of class 1, and whether it counts in the average."""

    ngrams: Ngrams
    weight: np.ndarray
    kept: np.ndarray
    bias: float

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        """Probability of class 1 of each text; a text without a kept n-gram
        gets the bias alone."""
        texts = list(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for who, what in self.ngrams.passes(texts):
            use = self.kept[what]
            who, what = who[use], what[use]
            if len(who):
                lo = int(who.min())
                add = np.bincount(who - lo, weights=self.weight[what])
                total[lo:lo + len(add)] += add
                count[lo:lo + len(add)] += np.bincount(who - lo)
        odds = total / np.maximum(count, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -40, 40)))


def _presence(ngrams: Ngrams):
    """Per partition: documents of each class that hold an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, ngrams.buckets), dtype=np.int64)
        mark = np.zeros(ngrams.buckets, dtype=bool)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                what = ngrams.of(text.as_py())
                mark[what] = True
                counts[y.as_py()] += mark
                mark[what] = False
        for y in (0, 1):
            at = np.flatnonzero(counts[y])
            for lo in range(0, len(at), 50_000):
                part = at[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), y, np.int32)), pa.array(part), pa.array(counts[y][part])], ["y", "bucket", "n"])

    return run


def _features(ngrams: Ngrams, kept: np.ndarray):
    """One row a document: its class and keys, the kept n-grams' numbers and
    counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.cumsum(kept) - 1
        for batch in batches:
            ids, ns = [], []
            for text in batch.column(0):
                what = ngrams.of(text.as_py())
                i, n = np.unique(number[what[kept[what]]], return_counts=True)
                ids.append(i.astype(np.int32))
                ns.append(n.astype(np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.float32()))], ["y", "k", "h", "ids", "ns"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(k, x, y)`` of the rows to learn from: an id that ``learn`` admits
    and a label of 0 or 1 (several labels of one id: the largest counts)."""
    marks = (labels.filter(learn & F.col(key).isNotNull() & F.col(label).isin(0, 1))
             .groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")))
    rows = docs.filter(learn & F.col(key).isNotNull()).select(F.col(key).alias("k"), text_of(text).alias("x"))
    # sent to all executors while they are few
    return rows.join(small_broadcast(marks), "k")


def fit(rows: DataFrame, settings: Settings = Settings()) -> SubwordModel:
    """Learn from ``rows`` (``k`` id, ``x`` text, ``y`` 0/1). Without rows of
    both classes the model knows only their smoothed share."""
    prepare(rows.sparkSession)
    ng = settings.ngrams
    by_class = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([by_class.get(0, 0), by_class.get(1, 0)], dtype=float)
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    kept = np.zeros(ng.buckets, dtype=bool)
    if n.min() == 0:
        return SubwordModel(ng, np.zeros(ng.buckets, np.float32), kept, prior)
    found = (rows.select("x", "y").mapInArrow(_presence(ng), "y int, bucket long, n long")
             .groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros((2, ng.buckets))
    counts[found["y"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    a, b = counts[1], counts[0]
    c, d = n[1] - a, n[0] - b
    chi2 = n.sum() * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n[0] * n[1], 1)
    chi2[(a + b < settings.min_docs) | (chi2 < settings.min_chi2)] = 0
    best = np.argsort(-chi2, kind="stable")[:settings.vocabulary]
    kept[best[chi2[best] > 0]] = True
    if not kept.any():
        return SubwordModel(ng, np.zeros(ng.buckets, np.float32), kept, prior)
    scale = 1 << 30
    share = [min(1.0, settings.sample / x) for x in n]
    drawn = rows.filter(F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(settings.seed)), F.lit(scale))
                        < F.when(F.col("y") == 1, F.lit(int(share[1] * scale))).otherwise(F.lit(int(share[0] * scale))))
    keyed = drawn.select("x", "y", F.xxhash64(F.col("k").cast("string")).alias("k"), F.xxhash64("x").alias("h"))
    table = keyed.mapInArrow(_features(ng, kept), "y int, k long, h long, ids array<int>, ns array<float>").toArrow()
    y, lens = table["y"].to_numpy().astype(np.int64), pc.list_value_length(table["ids"]).to_numpy().astype(np.int64)
    ids, ns = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[n].chunks] or [np.zeros(0)]) for n in ("ids", "ns"))
    order = np.lexsort((table["h"].to_numpy(), table["k"].to_numpy(), y))  # the same order every run
    del table
    # the sample's classes weigh as they do among all rows
    seen = np.maximum(np.bincount(y, minlength=2), 1)
    cost = (n / n.sum()) / (seen / seen.sum())
    weight, bias = _descend(Sample(ids, ns, np.concatenate(([0], np.cumsum(lens)))), y, order, cost, int(kept.sum()), settings)
    full = np.zeros(ng.buckets, np.float32)
    full[kept] = weight
    return SubwordModel(ng, full, kept, bias)


@dataclass
class Sample:
    """All documents' n-gram numbers and counts, end to end."""

    ids: np.ndarray
    ns: np.ndarray
    ends: np.ndarray

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of some documents, their share of the document, and the
        document's place in the batch; made when it is asked for."""
        at = [slice(self.ends[i], self.ends[i + 1]) for i in rows]
        lens = np.array([s.stop - s.start for s in at])
        doc = np.repeat(np.arange(len(rows)), lens)
        count = np.concatenate([self.ns[s] for s in at]).astype(np.float64)
        total = np.bincount(doc, weights=count, minlength=len(rows))
        return np.concatenate([self.ids[s] for s in at]), count / np.maximum(total, 1)[doc], doc


def _lists(column) -> list:
    out = []
    for chunk in column.chunks:
        flat, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [flat[at[i]:at[i + 1]] for i in range(len(chunk))]
    return out


def gradients(E: np.ndarray, W: np.ndarray, b: np.ndarray, flat, part, doc, y, cost):
    """Of one minibatch's weighted mean log-loss: by the softmax layer, its
    bias, and the vectors of the n-grams met (with their numbers)."""
    m, met = len(y), np.zeros(len(E), dtype=bool)
    met[flat] = True
    at = np.flatnonzero(met)
    place = np.zeros(len(E), dtype=np.int64)
    place[at] = np.arange(len(at))
    place = place[flat]
    hidden = np.stack([np.bincount(doc, weights=part * E[flat, j], minlength=m) for j in range(E.shape[1])], axis=1)
    logits = hidden @ W + b
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(m), y] -= 1
    p *= cost[y][:, None] / m
    back = p @ W.T
    dE = np.stack([np.bincount(place, weights=part * back[doc, j], minlength=len(at)) for j in range(E.shape[1])], axis=1)
    return hidden.T @ p, p.sum(0), at, dE


def _descend(sample: Sample, y, order, cost, size: int, s: Settings) -> tuple[np.ndarray, float]:
    """Minibatch gradient descent (per-parameter step sizes) on vectors ``E``
    and softmax layer ``W``; returns the log-odds weight of each n-gram and
    the bias. Minibatches are made one at a time."""
    rng = np.random.default_rng(s.seed)
    E = rng.normal(0, 0.1, (size, s.dim))
    W = rng.normal(0, 0.1, (s.dim, 2))
    b = np.zeros(2)
    gE, gW, gb = np.full(size, 1e-8), np.full(W.shape, 1e-8), np.full(2, 1e-8)
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs) + 0.02
        shuffled = order[rng.permutation(len(order))]
        for lo in range(0, len(shuffled), s.batch):
            rows = shuffled[lo:lo + s.batch]
            dW, db, at, dE = gradients(E, W, b, *sample.batch(rows), y[rows], cost)
            gW += dW ** 2
            gb += db ** 2
            W -= rate * dW / np.sqrt(gW)
            b -= rate * db / np.sqrt(gb)
            dE += s.decay * E[at]
            gE[at] += (dE ** 2).mean(1)
            E[at] -= rate * dE / np.sqrt(gE[at])[:, None]
    return E @ (W[:, 1] - W[:, 0]), float(b[1] - b[0])


def scorer(model: SubwordModel, spark):
    """An Arrow UDF ``text -> struct(score double)`` for a fitted model, which
    is sent to the executors once."""
    from tessera.llm.common import text_udf
    from pyspark.sql import types as T
    sent = spark.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def step(texts):
            return [{"score": float(x)} for x in m.scores(texts)]
        return step

    return text_udf(make, T.StructType([T.StructField("score", T.DoubleType())]))
