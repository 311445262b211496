"""The operators as Spark jobs: against brute force on the smallest tables,
and on nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import collections
import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, common, decontaminate, embedding_dups, langid, quality, queries, simhash, token_counts, toxicity, url_filter, warc
from tessera.llm.components import connected_components
from tests.conftest import SF_SMALL

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "string, root string, node long, fp long, h long, pos int, term long, word string, k string, x string, y int, n long, u long, v long, `__h` long"


def groups(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    long_text = "the quick brown fox jumps over the lazy dog again " * 4000
    near = " ".join(f"word{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (5, long_text), (6, long_text), (None, "one two three four five"), (None, None),
            (7, near), (8, near + " tail"), (9, "İstanbul ẞ 日本語 \x00 end"), (9, "another text of the same id"), (10, "a|b|c !!! 123")]
    df = spark.createDataFrame([(a, b, "x", "root", 1, 2, 3, 4, 5, "w", "k", "x", 1, 1, 1, 1, 9) for a, b in rows],
                               "doc_id long, text string, lang " + CLASH)
    return df.select("*", F.lit("s").alias("source"))


@pytest.fixture(scope="module")
def odd_labels(spark):
    return spark.createDataFrame([(1, 0, 1), (4, 1, 0), (4, 1, 0), (5, 1, None), (None, 1, 1), (7, None, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(301, 302), (302, 303), (303, 301), (400, 400), (None, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(1, 41)} | {200 + i: 100 for i in range(50)} | {302: 301, 303: 301}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_op1_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x = np.concatenate((x, x[:1] + 0.1 * rng.normal(size=(80, 16)), x[5:50] * 2.5, x[60:90] + 0.1 * rng.normal(size=(30, 16)), x[7:8], x[7:8]))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 15 + [float("inf")]), (904, []), (905, [1.0] * 15 + [None]), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("v", F.lit("clash")).withColumn("cid", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dups.near_duplicates(df, shards=2, blocks=2).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (u @ u.T) >= 0.9
    np.fill_diagonal(linked, False)
    root = groups(len(x), np.argwhere(linked).tolist())
    want = {i: (int(linked[i].sum()), root[i], root[i] == i) for i in range(len(x))}
    want |= {i: (0, i, True) for i in range(900, 906)} | {906: (1, 906, True), 907: (1, 906, False)}
    assert got == want
    assert embedding_dups.near_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r)[1:] for r in embedding_dups.near_duplicates(nulls).collect()) == [(0, None, True), (1, None, True), (1, None, True)]


@pytest.mark.parametrize("share", [0, 0.01, 0.05, 0.5])
def test_op1_goes_through_the_graph_however_rare_copies_are(spark, share):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    copies = rng.choice(6000, int(6000 * share), replace=False)
    aside = rng.normal(size=(len(copies), 64))
    aside -= (aside * x[copies]).sum(1, keepdims=True) * x[copies]
    aside /= np.maximum(np.linalg.norm(aside, axis=1)[:, None], 1e-300)
    cos = rng.uniform(0.905, 0.999, (len(copies), 1))
    x = np.concatenate((x, cos * x[copies] + np.sqrt(1 - cos ** 2) * aside))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    figures = {}
    got = {r.vec_id: r.n_links for r in embedding_dups.near_duplicates(df, shards=3, blocks=3, figures=figures).collect()}
    true = (x @ x.T >= 0.9).sum(1) - 1
    assert all(got[i] <= true[i] for i in got)
    assert sum(got.values()) >= 0.99 * true.sum()
    assert figures["shards"] == 3 and figures["recall"] >= 0.99 and figures["asked"] == 3 * len(x)
    assert figures["dense"] <= 0.01 * figures["asked"] and figures["lost"] <= 0.01 * len(x)


def test_op1_counts_a_link_at_both_ends(spark, monkeypatch):
    """Beams that never reach some points: those find their neighbours, and
    the neighbours count them too, over several tiles."""
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(150, 16)), rng.normal(size=(60, 16))))
    whole = embedding_dups._links

    def blind(graph, exact, asked, lost, least, width):
        for r, i, dense in whole(graph, exact, asked, lost, least, len(exact)):
            yield r[i % 5 > 0], i[i % 5 > 0], dense

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, x[3].tolist())], "vec_id long, embedding array<double>")
    x = np.concatenate((x, x[3:4]))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    with monkeypatch.context() as m:
        m.setattr(embedding_dups, "_links", blind)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dups.near_duplicates(df, shards=2, blocks=2, tile=40).collect()}
    assert [got[i][0] for i in (*range(210), 500)] == want.tolist()
    assert {got[i][1] for i in range(150)} == {0}


def test_op1_query_blocks_grow_with_the_input(spark, monkeypatch):
    ask = embedding_dups._ask

    def bounded(*args):
        run = ask(*args)

        def checked(members, queries):
            assert len(queries) < 100, "a cell got too many queries"
            return run(members, queries)

        return checked

    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(8).normal(size=(400, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_dups, "_ask", bounded)
    assert embedding_dups.near_duplicates(df, shards=2, blocks=2, block_values=400).count() == 400


def _slow_simhash(rows):
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    root = groups(len(fps), pairs)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root[i]] = min((x for x in (low.get(root[i]), d) if x is not None), default=None)
    return sorted(((d is None, d or 0, f"{fps[i]:016x}", low[root[i]] is None, low[root[i]] or 0) for i, (d, _) in enumerate(rows)))


def test_op2_against_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)  # hot buckets are split even here
    for df in (odd_docs, queries.table(spark, SF_SMALL, "documents")):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id is None, r.component_id or 0) for r in simhash.near_duplicates(df).collect())
        assert got == _slow_simhash([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_op2_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PACK", 64)
    monkeypatch.setattr(simhash, "TILE", 50)
    rng = np.random.default_rng(3)
    core = int(rng.integers(0, 2**62))
    near = {core ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (400, 2))}
    far = {int(v) for v in rng.integers(0, 2**62, 300)}
    fps = sorted(near | far)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.near_links(df)).collect()}
    root = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    assert got == {fps[i]: fps[r] for i, r in enumerate(root) if r != i}


def test_op2_keeps_one_of_each_group(spark, odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    fps = [simhash.fingerprint(r.text or "") for r in odd_docs.collect()]
    assert len(rows) == len(set(groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])))
    assert (4, "one") in rows and rows.count((4, "one")) == 1
    assert simhash.keep_one(odd_docs.limit(0)).count() == 0


def test_op3_against_the_library(spark, odd_docs):
    import public_tokenizers
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})

    def want(t):
        ids = library.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    for df in (odd_docs, queries.table(spark, SF_SMALL, "documents")):
        got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(df).collect())
        assert got == sorted((r.doc_id or -1, *want(r.text)) for r in df.collect())
    both = byte_bpe.decode_ids(byte_bpe.encode_texts(odd_docs))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both.collect())
    assert byte_bpe.round_trip(odd_docs.limit(0)).count() == 0


def test_op4_against_the_library(spark, odd_docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for df in (odd_docs, queries.table(spark, SF_SMALL, "documents")):
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df).collect())
        want = [(r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
        assert got == sorted((*w, w[2] > 2048) for w in want)
    assert token_counts.count_tokens(odd_docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, duck, name):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
    from compare import digest
    df = queries.QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(queries.ORACLE[name])
    rows, names = cur.fetchall(), [d[0] for d in cur.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(names, rows)


def test_op5_records_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<html lang=en><head><title>T\nt</title></head><body><p>One &amp; two</p><script>x</script><a href='/y'>é</a></body></html>"),
                                   (2, None, None), (None, "http://b.org/", ""), (1, "http://a.org/x", None)], "page_id long, url string, html string").withColumn("record", F.lit(1))
    made = warc.derivatives(warc.responses(pages))
    rows = made.collect()
    assert len(rows) == 8
    text = next(r for r in rows if r.warc_type == "conversion" and r.block)
    assert text.block == "One & two\né"
    fields = next(r for r in rows if r.warc_type == "metadata" and "title: T t" in r.block)
    assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in fields.block and "outlink: /y\r\n" in fields.block
    import base64
    for r in rows:
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        head, _, block = r.record.partition("\r\n\r\n")
        named = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert named["WARC-Refers-To"] == r.refers_to and int(named["Content-Length"]) == len(block.encode()) and block == r.block
        assert ("WARC-Target-URI" in named) == (r.target_uri is not None)
    warc.write_records(made, str(tmp_path / "w"))
    import gzip
    found = []
    for f in sorted((tmp_path / "w").glob("*.gz")):
        data = gzip.open(f).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            found.append((head + b"\r\n\r\n" + rest[:size]).decode())
            assert rest[size:size + 4] == b"\r\n\r\n"
            data = rest[size + 4:]
    assert sorted(found) == sorted(r.record for r in rows)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_op5_references_long_texts_and_ids(spark):
    rows = [(1, "http://a.org", "<title>A &amp; B&nbsp;&#233;</title><p>&lt;p&gt; &#xE9;&eacute;&mdash;&copy 2020 &unknown; &amp;lt; &#8217;</p><a href='/x?a=1&amp;b=2&copy=3'>l</a><a href=\"/x?a=1&b=2&copy=3\">m</a>"),
            (1, "http://a.org", "<p>other</p>"), (2, "http://b.org", "<p>" + "word &amp; " * 200_000 + "</p>"), (3, "http://c.org", "& &; &# &#x;")]
    made = {(r.page_id, r.warc_type, r.block) for r in warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    texts = {(i, b) for i, t, b in made if t == "conversion"}
    assert (1, "A & B é\n<p> éé—© 2020 &unknown; &lt; ’\nlm") in texts and (1, "other") in texts and (3, "& &; &# &#x;") in texts
    assert (2, ("word & " * 200_000).strip()) in texts
    fields = next(b for i, t, b in made if t == "metadata" and "title" in b)
    assert "title: A & B é\r\n" in fields and fields.count("outlink: ") == 1 and "outlink: /x?a=1&b=2&copy=3\r\n" in fields
    ids = [r.record_id for r in warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(set(ids)) == 4
    import html.entities
    left = re.compile("&(?:" + "|".join(n[:-1] for n in html.entities.html5 if n.endswith(";")) + ");")
    pages = queries.table(spark, SF_SMALL.replace("0.001", "0.01"), "pages")
    double = re.compile("&amp;[A-Za-z#]")
    for r in warc.derivatives(warc.responses(pages)).filter("warc_type = 'conversion'").join(pages, "page_id").select("block", "html").collect():
        assert double.search(r.html) or not left.search(r.block)


def _crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name, fn, fold, threshold", [("quality", quality.score_quality, (5, 0), 0.3), ("toxic", toxicity.score_toxicity, (3, 1), 0.7)])
def test_op6_and_op10_on_held_out_rows(spark, name, fn, fold, threshold):
    docs, labels = (queries.table(spark, SF_SMALL.replace("0.001", "0.01"), t) for t in ("documents", "labels"))
    out = fn(docs, labels).collect()
    assert len(out) == docs.count()
    marks = {r.doc_id: r[name] for r in labels.collect()}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == (_crc(r.doc_id, fold[0]) == fold[1])
    held = [(r.predicted, marks[r.doc_id]) for r in out if r.held_out and r.doc_id in marks]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_op6_and_op10_odd_rows(spark, odd_docs, odd_labels):
    for fn, keep in ((quality.score_quality, quality.keep_good), (toxicity.score_toxicity, toxicity.drop_toxic)):
        for labels in (odd_labels, odd_labels.limit(0)):
            rows = fn(odd_docs, labels).collect()
            assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
            assert keep(odd_docs, labels).columns == odd_docs.columns
        assert fn(odd_docs.limit(0), odd_labels).count() == 0 and keep(odd_docs.limit(0), odd_labels).count() == 0


def test_op6_and_op10_keep_the_ngrams_that_a_linear_scan_keeps(spark):
    from tessera.llm import subword_model as S
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" nasty" if i % 3 == 0 and i % 7 else ""), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x string, y int")
    settings = S.Settings(ngrams=S.Ngrams(chars=(3,), words=1, bits=14), vocabulary=60, min_docs=5, min_chi2=2.0, epochs=1)
    kept = set(np.flatnonzero(S.fit(df, settings).kept).tolist())
    seen = collections.defaultdict(lambda: [0, 0])
    for _, x, y in rows:
        for b in set(settings.ngrams.of(x).tolist()):
            seen[b][y] += 1
    n = [sum(y == c for _, _, y in rows) for c in (0, 1)]
    score = {}
    for b, (zero, one) in seen.items():
        c, d = n[1] - one, n[0] - zero
        chi2 = sum(n) * (one * d - zero * c) ** 2 / max((one + zero) * (c + d) * n[0] * n[1], 1)
        if one + zero >= 5 and chi2 >= 2.0:
            score[b] = chi2
    assert kept == {b for b, _ in sorted(score.items(), key=lambda t: (-t[1], t[0]))[:60]}


def test_op10_unseen_misspellings_share_vectors(spark):
    rng = np.random.default_rng(8)
    calm = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "tu", "re") for b in ("ran", "sel", "ton") for c in ("da", "ko", "mer")]
    harsh = ["grumblefrotz", "snarkwobble", "blithergoon"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = list(rng.choice(calm, 15)) + (list(rng.choice(harsh, 2)) if toxic else [])
        rows.append((i, " ".join(rng.permutation(w))))
        labels.append((i, int(toxic)))
    bad = ["grumblefrotzz", "grumbelfrotz", "snarkwoble", "blithergooon", "snark-wobble"]
    held = [i for i in range(900, 1200) if _crc(i, 3) == 1][:2 * len(bad)]
    tests = [" ".join([*rng.choice(calm, 15), w, w]) for w in bad] + [" ".join(rng.choice(calm, 17)) for _ in bad]
    docs = spark.createDataFrame(rows + list(zip(held, tests)), "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks).collect()}
    assert [got[i].predicted for i in held] == [1] * len(bad) + [0] * len(bad)


def test_op7_on_held_out_rows(spark):
    docs = queries.table(spark, SF_SMALL.replace("0.001", "0.01"), "documents")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (_crc(r.doc_id, 4) == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_op7_odd_rows(spark, odd_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred == "x" and 0 <= r.score <= 1
    unknown = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify(unknown).collect()} == {("und", 0.0)}
    assert langid.identify(odd_docs.limit(0)).count() == 0


def test_op8_rules_and_aliases(spark):
    link = "<link href='{}' rel=\"canonical\">"
    pages = [(1, "http://A.Example.org/es/1#x", None), (2, "https://example.org/fr", link.format("http://a.example.org/es/1")),  # allow by org/
             (3, "http://x.net/a", link.format("/b")), (4, "http://x.net/b", "<META http-equiv='refresh' content='0; URL=https://y.com/de/7'>"), (5, "http://y.com/de/7", ""),
             (6, "http://x.net/c", link.format("http://z.com/fr/1")), (7, "http://w.net/d", None), (8, None, "x"), (9, "no scheme", None), (10, "http://example.org/en/10?q=/es/", None),
             (11, "http://notexample.org", None), (None, "http://x.net/a", None), (12, "http://com/fr/", None), (13, "http://x.net/sub/p", link.format("q")), (14, "http://x.net/sub/q", link.format("//x.net/b"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("root", F.lit(0)).withColumn("action", F.lit(0))
    rules = url_filter.rules_table(spark, url_filter.RULES)
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {
        (1, "a.example.org", "/es/1"): ("example.org/es/", "block"), (2, "example.org", "/fr"): ("org/", "allow"),
        (3, "x.net", "/a"): (None, "block"), (4, "x.net", "/b"): (None, "block"), (5, "y.com", "/de/7"): ("com/de/", "block"),
        (6, "x.net", "/c"): (None, "allow"), (7, "w.net", "/d"): (None, "allow"), (8, "", ""): (None, "allow"), (9, "", ""): (None, "allow"),
        (10, "example.org", "/en/10"): ("example.org/en/1", "block"), (11, "notexample.org", ""): (None, "allow"), (None, "x.net", "/a"): (None, "block"),
        (12, "com", "/fr/"): ("com/fr/", "allow"), (13, "x.net", "/sub/p"): (None, "block"), (14, "x.net", "/sub/q"): (None, "block")}
    # an explicit allow among the aliases takes precedence
    more = spark.createDataFrame([("http://x.net/a", "http://z.com/fr/2")], "source string, target string")
    verdicts = {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules, more).collect()}
    assert verdicts[3] == verdicts[4] == "allow" and verdicts[5] == "block"
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, url_filter.rules_table(spark, [])).collect()} == {"allow"}


def _slow_hits(docs, items):
    find = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+").findall
    windows = collections.defaultdict(set)
    for i, t in items:
        w = find((t or "").translate(UPPER))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s:s + 10])].add(i)
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, ids = find((t or "").translate(UPPER)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    ids |= windows[tuple(w[s:s + n])]
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((d or -1, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_op9_against_brute_force(spark, odd_docs):
    odd_items = spark.createDataFrame([(1, "The QUICK brown fox jumps over the lazy dog again the quick"), (1, "one"), (2, "word7 word8 word9"), (3, None), (4, ""), (5, "!!"), (6, "lazy dog"),
                                       (None, "another text"), (10, "İstanbul"), (11, "the the"), (12, "word390 word391 word392 word393 word394 word395 word396 word397 word398 word399 tail")],
                                      "item_id long, text string").withColumn("window", F.lit(1)).withColumn("wid", F.lit(1))
    tables = queries.table(spark, SF_SMALL, "documents"), queries.table(spark, SF_SMALL, "benchmark")
    for docs, items in ((odd_docs, odd_items), tables):
        got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, items).collect())
        assert got == _slow_hits([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    kept = decontaminate.keep_clean(odd_docs, odd_items)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(not x[5] for x in _slow_hits([tuple(r) for r in odd_docs.select("doc_id", "text").collect()], [tuple(r) for r in odd_items.select("item_id", "text").collect()]))
    assert decontaminate.decontaminate(odd_docs.limit(0), odd_items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(odd_docs, odd_items.limit(0)).collect())


def test_op9_long_windows_and_clashing_names(spark):
    long = " ".join(f"t{i}" for i in range(1200))
    docs = spark.createDataFrame([(1, "x " + long + " y", 5, "a"), (2, long.replace("t1100 ", ""), 6, "b"), (3, None, 7, "c")], "doc_id long, text string, hit_id long, hit_h string")
    items = spark.createDataFrame([(9, long)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, items, size=1200).collect()}
    assert got == {1: (1200, 1), 2: (0, 0), 3: (0, 0)}
    kept = decontaminate.keep_clean(docs, items, size=1200)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.filter("doc_id > 1").collect()))


def test_op2_keeps_columns_of_any_name(spark):
    names = "text_h long, chosen_id string, chosen_h string, chosen_n string, root string, `a.b` int"
    rows = [(1, "one two three four five", 7, "p", "q", "r", "s", 1), (2, "one two three four five", 8, "p", "q", "r", "s", 2), (2, "one two three four five", 8, "p", "q", "r", "s", 2), (3, "six", 9, "p", "q", "r", "s", 3)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, " + names)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[3]]


def test_op9_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha extra beta gamma delta"), (3, "alpha x y z w beta gamma delta"), (4, "delta gamma beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.decontaminate(docs, items, slack=1).collect()}
    assert got == {1: (4, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


def test_native_operators_run_no_python(spark):
    for name in ("op8_url_filter", "op9_decontamination"):
        plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|InArrow|Cartesian|NestedLoop", plan)
