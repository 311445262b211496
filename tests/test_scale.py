"""What a query writes and shuffles on the way stays in proportion to its input."""

from pyspark.sql import functions as F


def staged(monkeypatch, module):
    """Rows a table that ``module`` stages from here on."""
    from tessera import session
    seen = []

    def stage(df, name):
        out = session.stage_table(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(module, "stage_table", stage)
    return seen


def test_neighbours_write_no_row_a_question(spark, monkeypatch):
    import numpy as np
    from tessera.operators import vectors
    x = np.random.default_rng(5).normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen, figures = staged(monkeypatch, vectors), {}
    got = {(r.id, r["rank"]): r.neighbour for r in vectors.knn(df, 3, tile=15, figures=figures).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    want = np.argsort(-cos, axis=1)[:, :3]
    assert got == {(i, k + 1): int(want[i, k]) for i in range(400) for k in range(3)}
    # nearly every query asks nearly every tile: that alone is more than is written
    assert figures["asked"] > 10 * 400 and sum(n for _, n in seen) <= 3 * 400


def test_keywords_stage_no_row_a_document_and_term(spark, monkeypatch):
    """300 texts of 6 words: their terms are few, the rows staged are too."""
    from tessera.operators import topics as T
    seen = staged(monkeypatch, T)
    corpus = spark.createDataFrame([(i, f"alfa beta gama alfa beta {'um' if i % 2 else 'rho'}") for i in range(300)], "id long, text string")
    assign = corpus.select("id", F.concat(F.lit("t"), F.col("id") % 2).alias("topic"))
    got = {(r.topic, r.term): r["rank"] for r in T.topic_keywords(corpus, assign).collect()}
    assert {t for _, t in got} == {"alfa", "beta", "gama", "rho", "alfa beta", "beta gama", "gama alfa", "beta rho"}
    assert seen and sum(n for _, n in seen) < 2 * 300


def test_keywords_of_repeated_and_missing_ids(spark):
    """Rows of one id are one document, rows without an id are too; a document
    without a topic counts for the frequency, one of two topics only once."""
    import math
    from tessera.operators.topics import topic_keywords
    rows = [(1, "aa bb"), (1, "aa cc"), (2, "aa dd"), (None, "aa ee"), (None, "ee ee"), (3, "ee ff"), (4, "ff ff gg"), (5, "")]
    corpus = spark.createDataFrame(rows, "id long, text string")
    topics = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (4, "x"), (4, "z"), (9, "w")], "id long, topic string")
    got = {(r.topic, r.term): r.score for r in topic_keywords(corpus, topics, min_df=2).collect()}
    # documents: aa in 1, 2 and the one without an id; ee in that and 3; ff in 3 and 4
    tf = {("x", "aa"): 4, ("y", "aa"): 1, ("x", "ff"): 2, ("z", "ff"): 2}
    per_topic = {t: sum(n for (u, _), n in tf.items() if u == t) for t, _ in tf}
    per_term = {w: sum(n for (_, u), n in tf.items() if u == w) for _, w in tf}
    mean = sum(per_topic.values()) / len(per_topic)
    assert got == {(t, w): round(math.sqrt(n / per_topic[t]) * math.log(1 + mean / per_term[w]), 6) for (t, w), n in tf.items()}


def test_company_nodes_group_no_edges(spark, inputs):
    """The ends of edges are taken from the rows: only roots are shuffled."""
    from tessera.operators import graph as G
    plan = G.company_nodes(inputs.companies, inputs.partners)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cnpj_basico" in plan
    assert "hashpartitioning(pessoa_id" not in plan and "hashpartitioning(cnpj_socio_basico" not in plan


def reads(df, table):
    return any(f"/{table}.parquet" in f for f in df.inputFiles())


def fresh(spark, month):
    """Inputs of a month of their own: nothing of theirs is stored yet."""
    from tests.conftest import SF_SMALL
    from tessera.plans.context import Inputs
    return Inputs(spark, SF_SMALL, month)


def test_graph_tables_share_one_reading_of_the_partners(spark, monkeypatch):
    from tessera.operators.graph_store import GraphStore
    seen = []
    monkeypatch.setattr(GraphStore, "ready", lambda self: False)
    monkeypatch.setattr(GraphStore, "write", lambda self, *tables: seen.extend(tables))
    fresh(spark, "2031-01").graph
    assert len(seen) == 3 and not any(reads(df, "lineitem") for df in seen)


def test_records_are_enriched_from_rows_made_once(spark, monkeypatch):
    from tessera.operators import funding as FU
    from tessera.operators import registry as R
    seen, enrich, view = [], FU.enrich_records, R.search_view_active
    monkeypatch.setattr(FU, "enrich_records", lambda records, *views: seen.append(records) or enrich(records, *views))
    monkeypatch.setattr(R, "search_view_active", lambda c, establishments, *rest: seen.append(establishments) or view(c, establishments, *rest))
    assert fresh(spark, "2031-02").records.count() > 0
    assert len(seen) == 2 and not any(reads(df, t) for df in seen for t in ("lineitem", "orders"))


def test_summaries_count_distinct_over_sums(spark):
    """Equal ids, sources and keys are summed before the sets and distinct
    counts; missing ids and values count as they did."""
    from decimal import Decimal as D
    from tessera.operators import funding as FU
    rows = [("SP", "1", "a", D("1.50"), D("1.00"))] * 200 + [("SP", "1", "b", D("2.00"), None), ("", None, "a", None, D("3.00")), (None, "", "a", D("4.00"), D("0.00")), ("SP", "2", "a", D("5.00"), D("5.00"))]
    df = spark.createDataFrame(rows, "uf string, cnpj_14 string, source string, total_aprovado_finep decimal(15,2), total_liberado decimal(15,2)")
    out = FU.funding_by_state(df)
    got = {r.uf: tuple(r)[1:] for r in out.collect()}
    assert got == {"SP": (2, 202, D("307.00"), D("205.00"), ["a", "b"]), "NA": (0, 2, D("4.00"), D("3.00"), ["a"])}
    assert dict(out.dtypes)["total_aprovado_finep"] == "decimal(20,2)" and dict(out.dtypes)["total_projetos"] == "bigint"
    plan = out._jdf.queryExecution().sparkPlan().toString()
    first = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
    assert " HashAggregate(" in first and "collect_set" not in first


def test_towns_are_resolved_once_a_company(spark, monkeypatch):
    from tessera.operators import funding as FU
    seen, resolve = [], FU.resolve_geo
    monkeypatch.setattr(FU, "resolve_geo", lambda rows, geo: seen.append(rows.count()) or resolve(rows, geo))
    df = spark.sql("SELECT 'SP' AS uf, 'São  Paulo' AS municipio_nome, cast(id % 3 AS string) AS cnpj_14, 'a' AS source, 1.00bd AS total_aprovado_finep, 2.00bd AS total_liberado FROM range(300)")
    geo = spark.sql("SELECT 'SP' AS uf, 'Sao Paulo' AS nome, '35' AS codigo, 1.0d AS latitude, 2.0d AS longitude")
    (r,) = FU.funding_by_municipality(df, geo).collect()
    assert (r.municipio_nome, r.municipality_ibge_code, r.total_empresas, r.total_projetos, int(r.total_aprovado_finep), int(r.total_liberado)) == ("Sao Paulo", "35", 3, 300, 300, 600)
    assert seen == [3]


def test_check_digits_evaluate_their_base_once(spark):
    from tessera.functions.columns import check_digits
    df = spark.createDataFrame([("112223330001",), ("000000000001",), ("11444777x001",), ("1",), (None,)], "b string").select(check_digits(F.concat("b", F.lit(""))).alias("dv"))
    assert [r.dv for r in df.collect()] == ["81", "91", None, None, None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(b") == 1 and plan.count("substring(") <= 24


def test_person_is_picked_from_people_made_once(spark, monkeypatch):
    from tessera.operators import graph as G
    from tessera.plans import q_graph
    seen, pick = [], G.pick_person
    monkeypatch.setattr(G, "pick_person", lambda people, mask: seen.append(people) or pick(people, mask))
    assert q_graph._picked(fresh(spark, "2031-03")).count() == 1
    assert len(seen) == 1 and not reads(seen[0], "lineitem")


def test_searches_share_nodes_and_edges(spark, monkeypatch):
    from tessera.operators import graph as G
    from tessera.plans import catalog
    catalog.load_all()
    seen, search = [], G.graph_search
    monkeypatch.setattr(G, "graph_search", lambda *a: seen.append(a[:3]) or search(*a))
    assert catalog.QUERIES["graph_search_digits14"](fresh(spark, "2031-04")).count() == 1
    assert len(seen) == 2 and not any(reads(df, t) for tables in seen for df in tables for t in ("lineitem", "customer"))


def test_vectors_stage_one_row_a_document(spark, monkeypatch):
    """Rows of one id are one document in ``df`` and the vector, and come out
    as often as they went in; a row without an id counts but has no vector."""
    import hashlib
    import math
    from tessera.operators import vectors
    rows = [(1, "alfa beta alfa"), (1, "beta gama"), (2, "gama"), (3, ""), (4, None), (None, "alfa rho")]
    seen = staged(monkeypatch, vectors)
    got = vectors.doc_vectors(spark.createDataFrame(rows, "id long, text string")).collect()
    assert sum(n for _, n in seen) == 5
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % vectors.BUCKETS
    tf = {1: {"alfa": 2, "beta": 2, "alfa beta": 1, "beta alfa": 1, "gama": 1, "beta gama": 1}, 2: {"gama": 1}, None: {"alfa": 1, "rho": 1, "alfa rho": 1}}
    idf = {t: math.log(7 / (1 + sum(t in d for d in tf.values()))) + 1 for d in tf.values() for t in d}
    assert sorted((r.id or 0) for r in got) == [0, 1, 1, 2, 3, 4]
    for r in got:
        w = {bucket(t): n * idf[t] for t, n in tf.get(r.id, {}).items()} if r.id else {}
        norm = math.sqrt(sum(x * x for x in w.values()))
        assert r.n_terms == (sum(tf.get(r.id, {}).values()) if r.id else 0) and r.indices == sorted(w) and abs(r.norm - norm) < 1e-9
        assert all(abs(v - w[b] / norm) < 1e-9 for b, v in zip(r.indices, r["values"]))


def test_runs_of_one_corpus_cut_its_texts_once(spark, tmp_path):
    from tessera.operators.topics import TopicRuns
    cut = spark.sparkContext.accumulator(0)

    def seen(text):
        cut.add(1)
        return text

    texts = spark.createDataFrame([(i, f"alfa beta gama word{i % 3}") for i in range(60)], "id long, text string")
    corpus = texts.select("id", F.udf(seen, "string")("text").alias("text"))
    assign = texts.select("id", F.concat(F.lit("t"), F.col("id") % 2).alias("topic"))
    runs = TopicRuns(spark, str(tmp_path / "runs"))
    runs.replace("a", corpus, assign)
    runs.replace("b", corpus, assign.filter("id < 30"))
    runs.replace("a", corpus, assign.filter("id % 7 > 0"))
    assert cut.value < 2 * 60
    got = {(r.run_id, r.topic): (r.n_docs, r.label) for r in runs.read("topics").collect()}
    assert {k: n for k, (n, _) in got.items()} == {("a", "t0"): 25, ("a", "t1"): 26, ("b", "t0"): 15, ("b", "t1"): 15}
    # another corpus, or another frequency, is another count
    runs.replace("b", texts.select("id", F.lit("rho rho sigma").alias("text")), assign)
    runs.replace("c", corpus, assign, min_df=61)
    got = {(r.run_id, r.topic): r.label for r in runs.read("topics").collect()}
    assert got["b", "t0"] == "rho rho, rho sigma, sigma" and got["c", "t0"] == ""


def test_terms_are_counted_alike_in_chunks_of_any_size(spark, monkeypatch):
    """Ids that repeat or are missing, texts without a word, longer than a
    chunk or missing, rare words, topics that are missing, double or of no text."""
    import random
    from collections import Counter

    from tessera.operators import term_counts as C
    from tessera.operators.topics import count_corpus
    rnd = random.Random(3)
    some = [f"w{i}" for i in range(8)] + ["de", "x"]
    rows = [(i, " ".join(rnd.choice([*some, f"rare{i}"]) for _ in range(rnd.choice([0, 1, 2, 5, 40])))) for i in [*range(40), 3, 3, 9]]
    rows += [(None, "w1 w2 w3"), (None, "w1 w2"), (50, None), (51, "...")]
    given = [(i, rnd.choice(["p", "q", None])) for i in range(45)] + [(3, "p"), (4, "q"), (4, "q"), (4, "p"), (None, "p"), (99, "z")]
    words = lambda text: [w for w in (text or "").split() if len(w) > 1 and w not in ("de", "...")]
    terms = lambda text: (w := words(text)) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    df = Counter(t for _, t in {(i, t) for i, text in rows for t in terms(text)})
    want = Counter((topic, t) for i, text in rows for j, topic in given if i == j and i is not None for t in terms(text) if df[t] >= 3)
    corpus, topics = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(given, "id long, topic string")
    for most in ((7, 1 << 20), (1 << 21, 2), (1 << 21, 1 << 20)):
        monkeypatch.setattr(C, "CHUNK_WORDS", most[0])
        monkeypatch.setattr(C, "CHUNK_TEXTS", most[1])
        counted = count_corpus(corpus, 3)
        got = {(r.topic, r.term): r.tf for r in counted.spelled(counted.by_topic(topics)).collect()}
        assert got == dict(want)
        # a text of n words has 2 n - 1 terms
        held = counted.texts.groupBy("chunk").agg(F.sum(F.aggregate("n", F.lit(0), lambda a, b: a + b)).alias("n"), F.count("pos").alias("texts")).collect()
        assert all(r.texts <= most[1] and (r.n < 2 * most[0] or r.texts == 1) for r in held)
