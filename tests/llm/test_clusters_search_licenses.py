"""Centroid clustering, ranked lexical search and license scans: against plain
versions, and on nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, lexical_search, license_scan, queries
from tests.conftest import SF_SMALL

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- centroid clustering -----------------------------------------------------

def _plain_clusters(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        parts = collections.defaultdict(list)
        for _, v in kept:
            parts[nearest(v)[1]].append(v)
        cents = [[sum(col) // len(parts[j]) for col in zip(*parts[j])] if j in parts else c for j, c in enumerate(cents)]
    got = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, j, d in got:
        inertia[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i is None, i or 0), j, d, inertia[j], sum(inertia.values()), names[j]) for i, j, d in got)


def _rows(df):
    return sorted(((r[0] is None, r[0] or 0), *tuple(r)[1:]) for r in df.collect())


def _groups(seed, n=400, size=64, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(8, size))
    return [(i, (middles[i % 8] + spread * rng.normal(size=size)).tolist()) for i in range(n)]


def test_op11_against_plain_rounds(spark):
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [float("inf")] * 64),
           (906, [0.0] * 64), (7, [0.5] * 64), (7, [0.5] * 64), (None, [0.25] * 64), (None, [-0.25] * 64), (907, [300.0] * 64)]
    rows = _groups(1) + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("a", F.lit(1)).withColumn("cluster", F.lit(9))
    got, model = centroids.cluster(df)
    assert _rows(got) == _plain_clusters(rows)
    # groups far apart: the bounds leave few vectors in doubt, and loosen by less than the drift
    late = model.figures[5:]
    assert sum(f["scanned"] for f in late) < 0.2 * sum(f["vectors"] for f in late)
    assert any(f["loosened"] < 0.9 * f["drift"] for f in model.figures)


def test_op11_one_cloud_ties_and_few_rows(spark):
    rng = np.random.default_rng(2)
    cloud = [(i, rng.normal(size=64).astype(np.float32).astype(float).tolist()) for i in range(150)]
    same = [(i, [float(i % 3)] * 64) for i in range(30)]
    for rows, refreshes in ((cloud, (3, 20)), (same, (20,)), (cloud[:3], (20,))):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        for refresh in refreshes:
            assert _rows(centroids.cluster(df, refresh=refresh)[0]) == _plain_clusters(rows)
    empty = centroids.cluster(df.limit(0))[0]
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_op11_large_integers_stay_exact(spark):
    rows = [(i, [c * 4e4 for c in v]) for i, v in _groups(5, 60)]
    assert _rows(centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0]) == _plain_clusters(rows)


def test_op11_loosening_holds_for_every_point_of_a_sphere():
    rng = np.random.default_rng(3)
    for dim in (2, 3, 16):
        old, new = rng.normal(size=(6, dim)) * 3, rng.normal(size=(6, dim)) * 3
        radius = rng.random(6) * 3
        bound = centroids.loosening(old, new, radius)
        way = np.linalg.norm(new - old, axis=1)
        assert (bound <= way * (1 + 1e-6)).all() and (bound < 0.95 * way).any()
        for a in range(6):
            step = rng.normal(size=(4000, dim))
            step *= (radius[a] * rng.random((4000, 1)) ** (1 / dim)) / np.linalg.norm(step, axis=1)[:, None]
            x = old[a] + step
            for j in range(6):
                nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert nearer.max() <= bound[a, j] + 1e-9


# --- ranked lexical search ---------------------------------------------------

def _terms(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (text or "").translate(UPPER))


def _plain_search(docs, items, top=10):
    bags = [(d, collections.Counter(_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for i, t in items:
        asked, found = collections.Counter(_terms(t)), []
        for d, b in bags:
            m = 25 + 75 * b.total() * n // length
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w, times in asked.items() if w in b)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [((i is None, i or 0), r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def _found(df):
    return sorted((((r.item_id is None, r.item_id or 0), r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd_texts(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{int(x)}" for x in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary[:int(rng.integers(5, 400))], int(rng.integers(1, 60))))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "?!"), (1003, "Tie one"), (1004, "tie ONE"), (1004, "tie one"), (None, "tie one"), (None, None), (1005, "日本語 É é w1"), (1006, "w3 " * 60_000 + "rare"),
             (1007, "mit license, MIT  License; the Apache License and the GNU General Public License."), (1008, "x" * 100_000)]
    names = "shard term n best qid block rank score h pos w hash tid at".split()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(7).alias(c) for c in names])


def test_op12_against_plain_scores(spark, odd_texts):
    items = spark.createDataFrame([(1, "w3 w5 w7 w390 w3"), (2, "tie One"), (3, None), (4, ""), (5, "zzz"), (6, "w1"), (6, "w1"), (None, "rare É 日本語"), (7, " ".join(f"w{i}" for i in range(0, 400, 7))), (8, "x" * 100_000)],
                                  "item_id long, text string").withColumn("qid", F.lit(1)).withColumn("terms", F.lit(1))
    docs, asked = ([tuple(r) for r in df.select(df.columns[0], "text").collect()] for df in (odd_texts, items))
    want = _plain_search(docs, asked)
    for shard_bytes, block in ((1 << 24, 1000), (4000, 1000), (20_000, 3)):
        assert _found(lexical_search.search(odd_texts, items, shard_bytes=shard_bytes, query_block=block)) == want
    assert lexical_search.search(odd_texts.limit(0), items).count() == 0
    assert lexical_search.search(odd_texts, items.limit(0)).count() == 0


def test_op12_rejects_before_decompressing():
    rng = np.random.default_rng(5)
    shard = lexical_search._Shard()
    for i in range(6000):
        # a common word that weighs less in later documents, and a rarer one that decides
        common = ["common"] * (int(rng.integers(3, 7)) if i < 1500 else 1)
        shard.add(i, (" ".join(common + [f"n{int(x)}" for x in rng.integers(0, 3000, 18 - len(common))]) + (" rare" if i % 97 == 0 else "")).encode())
    batches = list(shard.seal("s", 6000, 6000 * 14))
    lists = lexical_search.Lists([r for b in batches for r in b.to_pylist()])
    asked = [("common", 400), ("rare", 4000)]
    docs, scores = lexical_search.best_of(lists, asked)
    opened = sum(t == "common" for t, _ in lists.open)
    # global bounds alone let them pass: the tenth best is below what rare and the heaviest common word give together
    assert scores[-1] < 4000 * lists.at["rare"][0] + 400 * lists.at["common"][0]
    assert opened < 0.5 * len(lists.at["common"][1])
    full = np.zeros(6000, np.int64)
    for t, w in asked:
        d, g = lists.blocks(t, range(len(lists.at[t][1])))
        full[d] += w * g
    order = np.lexsort((np.arange(6000), -full))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == full[order].tolist()


def test_op12_blocks_round_trip():
    rng = np.random.default_rng(6)
    for n in (1, 2, 17, 128):
        for far, great in ((300, 200), (1 << 20, 1 << 19)):
            docs, impacts = np.sort(rng.choice(far, n, replace=False)).astype(np.int64), rng.integers(1, great, n)
            a, b = lexical_search.unpack(lexical_search.pack(docs, impacts))
            assert a.tolist() == docs.tolist() and b.tolist() == impacts.tolist()


# --- license scans -----------------------------------------------------------

def _words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate(UPPER))


def _plain_base(docs):
    out = []
    for d, t in docs:
        w, places, labels = _words(t), [], set()
        for label, phrase in license_scan.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        out.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return sorted(out, key=str)


def _base(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_op13_base_places(spark, odd_texts):
    templates = license_scan.templates_table(spark)
    more = spark.createDataFrame([(1, "MIT license mit license\nGeneral Public License, apache-license"), (2, "the mit licenses"), (3, "mit"), (3, "license"), (4, "a " * 50_000 + "mit license " * 3000)], "doc_id long, text string")
    for df in (odd_texts, more, queries.table(spark, SF_SMALL, "documents")):
        got, _ = license_scan.scan(df, templates)
        assert _base(got) == _plain_base([tuple(r) for r in df.select("doc_id", "text").collect()])
        for r in got.collect():
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (not r.base_labels or r.score == 1)
    assert license_scan.scan(odd_texts.limit(0), templates)[0].count() == 0
    assert {r.labels for r in license_scan.scan(more, templates.limit(0))[0].collect()} == {""}


def test_op13_notices_with_words_put_in_and_left_out(spark):
    notice = dict((a, t) for a, t in license_scan.NOTICES if a in ("mit", "isc"))
    w = notice["mit"].split()
    copy = " ".join(w[:20] + ["INSERTED", "words"] + w[20:40] + w[42:])
    rows = [(1, "intro " * 40 + copy + " tail" * 30), (2, " ".join(w[:15])), (3, " ".join(reversed(w))), (4, notice["isc"] + " x " + notice["isc"]), (5, "permission is hereby granted free of charge")]
    got, spans = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.templates_table(spark))
    labels = {r.doc_id: (r.labels, r.base_labels) for r in got.collect()}
    assert labels == {1: ("mit", ""), 2: ("", ""), 3: ("", ""), 4: ("isc", ""), 5: ("", "")}
    found = [r for r in spans.collect() if r.verified]
    one = [r for r in found if r.doc_id == 1]
    n = len(_words(notice["mit"]))
    assert len(one) == 1 and one[0].start == 40 and one[0].end == 40 + n and 0.8 < one[0].share < 1  # two words more, two less
    assert sorted(r.start for r in found if r.doc_id == 4) == [0, len(_words(notice["isc"])) + 1]


def test_op13_runs_no_python(spark):
    docs = queries.table(spark, SF_SMALL, "documents")
    grams = license_scan.template_grams(license_scan.templates_table(spark))
    found = license_scan.votes(docs, grams, 300, [2, 3, 4])
    for df in (found, license_scan.spans_of(found, grams, 300), queries.QUERIES["op13_license_scan"](spark, SF_SMALL)):
        assert not re.search("Python|Pandas|InArrow|Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())
