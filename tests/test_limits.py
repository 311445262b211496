"""Nothing is cut, clamped or dropped on the way: encodings, keys, networks,
pages, searches, sinks and replayed stream batches."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import graph as G
from tessera.operators import patents as PT
from tessera.operators import registry as R
from tessera.operators.common import page
from tessera.sources import readers as RD
from tessera.sources import sinks as S
from tessera.streaming.streams import read_upserted, stream_keyed_latest


def test_late_accent_in_one_latin_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(("Codigo,Nome\n" + "\n".join(f"{i},liso" for i in range(200)) + "\n999,São\n").encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(("﻿codigo,nome\n1001,Ação\n1002,\"linha um\nlinha dois\"\n").encode("utf-8"))
    rows = {r.codigo: r.nome for r in RD.read_patent_csv(spark, str(tmp_path)).collect()}
    assert len(rows) == 203 and rows["999"] == "São"
    assert RD.read_patent_csv(spark, str(tmp_path)).count() == 203


def test_quoted_line_break_is_one_record(spark, tmp_path):
    (tmp_path / "c.csv").write_text('codigo,resumo\n1,"um\ndois"\n2,tres\n', encoding="utf-8")
    assert {r.codigo: r.resumo for r in RD.read_patent_csv(spark, str(tmp_path / "c.csv")).collect()} == {"1": "um\ndois", "2": "tres"}


def _edges(spark, pairs):
    return spark.createDataFrame([("SOCIO_DE", a, b, "2024-01") for a, b in pairs], "type string, src string, dst string, reference_month string")


def test_hub_is_returned_whole_and_depth_is_honoured(spark):
    hub = _edges(spark, [(f"P:{i}", "C:hub") for i in range(250)])
    seeds = spark.createDataFrame([("hub",)], "cnpj_basico string")
    net = G.company_network(seeds, hub, 1)
    assert net.count() == 250 and net.filter("truncated").count() == 0
    cut = G.company_network(seeds, hub, 1, limit=200)
    assert cut.count() == 200 and cut.filter("truncated").count() == 200
    chain = _edges(spark, [(f"C:{i}", f"C:{i + 1}") for i in range(12)])
    start = spark.createDataFrame([("0",)], "cnpj_basico string")
    assert G.company_network(start, chain, 4).count() == 7  # 2 * 4 - 1 hops
    with pytest.raises(ValueError):
        G.company_network(start, chain, 0)


def test_page_size_is_an_error_not_a_cut(spark):
    df = spark.range(300)
    assert page(df, [F.col("id")], 2, 100).first()["id"] == 100
    for bad in ((1, 101), (1, 0), (0, 10)):
        with pytest.raises(ValueError):
            page(df, [F.col("id")], *bad)


def _raw(spark, rows, names):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["_row", *names])
    return df


def test_patent_keys_keep_every_row(spark):
    patents = spark.createDataFrame([(1,), (2,)], "codigo_interno long")
    people = _raw(spark, [("1", "A", "", "", "01/02/2020"), ("1", "B", "", "", ""), ("9", "C", "", "", "")],
                  ["codigo_interno", "procurador", "cgccpfprocurador", "tipopessoaprocurador", "data_inicio_procurador"])
    assert sorted(r.procurador for r in PT.clean_attorneys(people, patents).collect()) == ["A", "B"]
    claims = _raw(spark, [("1", "US", "7", "01/02/2020"), ("1", "EP", "7", ""), ("1", "US", "7", "")], ["codigo_interno", "pais_prioridade", "numero_prioridade", "data_prioridade"])
    assert sorted(r.pais_prioridade for r in PT.clean_priorities(claims, patents).collect()) == ["EP", "US"]
    links = _raw(spark, [("1", "2", "A", ""), ("1", "2", "I", "03/04/2021"), ("1", "2", "A", "")], ["codigo_interno", "codigo_interno_vinculado", "tipo_vinculo", "data_vinculo"])
    assert sorted(r.tipo_vinculo for r in PT.clean_links(links, patents).collect()) == ["A", "I"]


def test_listings_come_in_their_order(spark):
    rows = spark.createDataFrame([(2, 1, "x"), (1, 2, "x"), (1, 1, "x")], "codigo_interno long, ordem int, autor string")
    assert [(r.codigo_interno, r.ordem) for r in PT.list_patent_part(rows, "inventores", q="x").collect()] == [(1, 1), (1, 2), (2, 1)]


def test_graph_search_reads_text_without_accents_and_whole_digits(spark):
    nodes = spark.createDataFrame([("12345678", "SAO PAULO LTDA"), ("00000001", "OUTRA")], "cnpj_basico string, razao_social string")
    people = spark.createDataFrame([("k", "JOAO")], "pessoa_id string, nome string")
    edges = _edges(spark, [("P:k", "C:12345678")])
    found = [(r.node, r["rank"], r.degree) for r in G.graph_search(nodes, people, edges, " são ").collect()]
    assert found == [("C:12345678", 2, 1)]
    assert [r.node for r in G.graph_search(nodes, people, edges, "12345678").collect()] == ["C:12345678"]
    assert G.graph_search(nodes, people, edges, "12345678000199").count() == 0
    assert G.graph_search(nodes, people, edges, "  ").count() == 0


def test_unified_search_takes_the_root_of_another_branch(spark):
    row = {c: None for c in R.SEARCH_COLUMNS} | {"cnpj_14": "12345678000195", "cnpj_basico": "12345678", "razao_social": "ACO", "nome_fantasia": None}
    types = ", ".join(f"{c} string" for c in R.SEARCH_COLUMNS)
    one = spark.createDataFrame([tuple(row[c] for c in R.SEARCH_COLUMNS)], types)
    none = one.limit(0)
    for q in ("12345678000999", "123456789", "12345678", "1234", "aço", ""):
        assert R.unified_search(one, none, q).count() == 1, q
    assert R.unified_search(one, none, "999").count() == 0
    assert R.unified_search(one, one, "aço").first()["match_source"] == "active"


def test_read_errors_rise_and_never_overwrite(spark, tmp_path):
    path = str(tmp_path / "lookup")
    df = spark.createDataFrame([(1,)], "a int")
    assert S.load_lookup_once(df, path) and not S.load_lookup_once(df, path)
    for f in (tmp_path / "lookup").glob("part-*"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):
        S.load_lookup_once(df, path)
    assert next((tmp_path / "lookup").glob("part-*")).read_bytes() == b"broken"
    assert not S.month_loaded(spark, str(tmp_path / "none"), "2024-01")


def test_keyed_table_survives_a_dying_writer_and_replays(spark, tmp_path, monkeypatch):
    from tessera.sources import keyed
    monkeypatch.setattr(keyed, "SLICES", 3)
    src, table = tmp_path / "src", str(tmp_path / "t")
    schema = spark.createDataFrame([], "k string, v long").schema
    order = [F.col("v").desc()]
    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    def held():
        got = read_upserted(spark, table, schema, ["k"], order)
        return got and {r.k: r.v for r in got.collect()}
    def run(checkpoint="c1"):
        stream_keyed_latest(spark, str(src), schema, ["k"], order, table, str(tmp_path / checkpoint), buckets=8)
        return held()
    assert held() is None
    land([(f"k{i}", 1) for i in range(20)])
    first = {f"k{i}": 1 for i in range(20)}
    assert run() == first
    # the writer dies with its slice half written: what was stored is there, the replay brings the batch
    land([("k3", 5), ("new", 2)])
    put = keyed.KeyedTable.put
    def dies(self, df, name):
        put(self, df, name)
        gone = next((tmp_path / "t" / "slices" / name).glob("bucket=*/*.parquet"))
        gone.unlink()
        (tmp_path / "t" / "slices" / name / "_SUCCESS").unlink()
        raise RuntimeError("killed")
    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "put", dies)
        with pytest.raises(Exception):
            run()
    assert held() == first
    now = first | {"k3": 5, "new": 2}
    assert run() == now
    assert run("c2") == now  # all batches again, by another stream
    land([("k3", 4)])  # a late row loses
    assert run() == now
    for v in range(6, 12):
        land([("k3", v), (f"n{v}", v)])
        now |= {"k3": v, f"n{v}": v}
        assert run() == now
    bases = sorted(p.name for p in (tmp_path / "t" / "base").iterdir())
    assert bases and len(list((tmp_path / "t" / "slices").iterdir())) <= 8
    # a compaction that dies between its two tables does not count
    reader = read_upserted(spark, table, schema, ["k"], order)
    KT = keyed.KeyedTable(spark, table, schema, ["k"], order, 8)
    KT.put(spark.createDataFrame([("k0", 99)], schema), "x-1")
    KT.compact()
    newest = sorted((tmp_path / "t" / "base").iterdir())[-1]
    (newest / "slices" / "_SUCCESS").unlink()
    assert {r.k: r.v for r in reader.collect()} == now
    assert held() == now | {"k0": 99}


def test_a_reader_finishes_with_the_old_version_of_a_stored_table(spark, tmp_path):
    from tessera.sources.stored import StoredTable, input_version
    t = StoredTable(spark, str(tmp_path / "view"))
    assert t.read(lambda: spark.range(10)).count() == 10
    opened = t.read(lambda: None)
    t.refresh(spark.range(100, 105))
    assert sorted(r.id for r in opened.collect()) == list(range(10))
    assert sorted(r.id for r in t.read(lambda: None).collect()) == list(range(100, 105))
    unfinished = t.next_path()
    spark.range(3).write.parquet(unfinished)
    (tmp_path / "view" / unfinished.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert t.read(lambda: None).count() == 5
    t.refresh(spark.range(1))
    assert len(t.versions()) == 2 and t.read(lambda: None).count() == 1
    before = input_version(spark, [str(tmp_path / "view")])
    t.refresh(spark.range(2))
    assert input_version(spark, [str(tmp_path / "view")]) != before


def test_last_sheet_row_wins_among_equal_keys(spark):
    from tessera.operators import funding as FU
    from tessera.operators.registry import SEARCH_COLUMNS
    views = spark.createDataFrame([], ", ".join(f"{c} string" for c in sorted(set(SEARCH_COLUMNS) | set(FU.LOOKUP_COLS))))
    disb = spark.createDataFrame([("c", None, 1), ("d", "2", 1)], "contrato string, ref string, parcela int")
    projects = spark.createDataFrame([("c", None, "z", "old", None, 5), ("c", None, "a", "new", None, 9)],
                                     "contrato string, ref string, id string, titulo string, cnpj_proponente_norm string, row_no long")
    got = {r.contrato: r.titulo for r in FU.disbursement_project(disb, projects, views, views).collect()}
    assert got == {"c": "new", "d": None}


def test_cells_of_a_hole_and_of_a_crowded_town(spark):
    from tessera.operators import geo as GEO
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    parts = [[ring(0.0, 0.0, 5.0, 5.0), ring(1.3, 1.3, 3.7, 3.7)], [ring(6.1, 0.0, 7.2, 0.9)]]
    polys = spark.createDataFrame([("a", parts)], "codigo string, parts array<array<array<struct<x: double, y: double>>>>")
    cells = GEO.polygon_cells(polys).collect()
    assert any(c.inner and c.level == 1 for c in cells) and not any(c.inner and c.edges for c in cells)
    assert not any(c.level == 0 and (c.cx, c.cy) == (2, 2) for c in cells)  # all hole
    assert max(len(c.edges) for c in cells if not c.inner) <= 6
    import random
    random.seed(1)
    pts = [(i, random.choice([0.0, 1.3, 2.0, 3.7, 5.0, 6.1, random.uniform(-1, 8)]), random.choice([0.0, 0.9, 1.3, 3.7, 5.0, random.uniform(-1, 6)])) for i in range(3000)]
    pts += [(10_000 + i, 0.5 + i * 1e-5, 0.5) for i in range(2000)] + [(1, None, 1.0)]
    df = spark.createDataFrame(pts, "pid long, x double, y double")
    def inside(x, y):
        one = 0 <= x <= 5 and 0 <= y <= 5 and not (1.3 < x < 3.7 and 1.3 < y < 3.7)
        return one or (6.1 <= x <= 7.2 and 0 <= y <= 0.9)
    want = sorted(p for p, x, y in pts if x is not None and inside(x, y))
    for hot in (50_000, 100):
        assert sorted(r.pid for r in GEO.covers(df, polys, hot=hot).collect()) == want
    # a cell of 2,000 points is dealt to 20 keys
    plan = GEO.covers(df, polys, hot=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "deal" in plan


def test_feature_collection_is_one_document(spark, tmp_path):
    import json
    from tessera.operators import geo_features as GF
    ring = [(0.123456789, 1.0), (2.0, 1.0), (2.0, 3.0), (0.123456789, 1.0)]
    geo = spark.createDataFrame([(f"{i:07d}", f'Town "{i % 7}" é', "SP" if i % 2 else "RJ", 1.0, 2.0, [ring]) for i in range(200)],
                                "codigo string, nome string, uf string, latitude double, longitude double, rings array<array<struct<x: double, y: double>>>")
    summary = spark.createDataFrame([("0000003", "x", "SP", 5.0, None, 2, 3, 10.5, 1.0, ["b"]), ("0000003", "y", "SP", 6.0, 7.0, 1, 1, 4.0, 0.0, ["a"]), (None, "z", "SP", 0.0, 0.0, 1, 1, 99.0, 0.0, [])],
                                    "municipality_ibge_code string, municipio_nome string, uf string, latitude double, longitude double, total_empresas long, total_projetos long, "
                                    "total_aprovado_finep double, total_liberado double, fontes array<string>")
    for features, n in ((GF.municipality_features(summary, geo), 200), (GF.municipality_features(summary, geo, " sp "), 100), (GF.municipality_features(summary, geo.limit(0)), 0)):
        path = GF.write_feature_collection(features, str(tmp_path / f"f{n}"))
        text = "".join(p.read_text() for p in sorted((tmp_path / f"f{n}").glob("part-*")))
        doc = json.loads(text)
        assert len(doc["features"]) == n == doc["metadata"]["feature_count"]
        names = [f["properties"]["municipio_nome"] for f in doc["features"]]
        assert names == sorted(names)
        if n:
            f = next(f for f in doc["features"] if f["id"] == "0000003")
            assert f["properties"]["total_aprovado_finep"] == 4.0 and f["properties"]["latitude"] == 6.0 and f["geometry"]["coordinates"][0][0] == [0.12346, 1.0]
            assert doc["metadata"]["municipalities_with_value"] == 1


def test_stored_graph_reads_the_buckets_of_its_nodes(spark, tmp_path):
    from tessera.operators.graph_store import GraphStore
    pairs = [(f"P:{i}", f"C:{i % 40:08d}") for i in range(400)]
    edges = _edges(spark, pairs)
    companies = spark.createDataFrame([(f"{i:08d}", f"E{i}") for i in range(40)], "cnpj_basico string, razao_social string")
    people = spark.createDataFrame([(str(i), f"N{i}") for i in range(400)], "pessoa_id string, nome string")
    store = GraphStore(spark, str(tmp_path / "g"))
    assert not store.ready()
    store.write(edges, companies, people)
    seeds = spark.createDataFrame([("00000003",)], "cnpj_basico string")
    got = G.company_network(seeds, store, 2)
    want = G.company_network(seeds, edges, 2)
    assert sorted(map(tuple, got.select("src", "dst").collect())) == sorted(map(tuple, want.select("src", "dst").collect()))
    spark.createDataFrame([("C:00000003",)], "node string").write.parquet(str(tmp_path / "few"))
    few = store.neighbours(spark.read.parquet(str(tmp_path / "few")))
    assert "dynamicpruning" in few._jdf.queryExecution().executedPlan().toString().lower()
    assert few.count() == 10
    assert {r.node: r.degree for r in store.nodes().collect()}["C:00000003"] == 10
    with pytest.raises(ValueError):
        G.graph_columns(companies, "empresa")


def test_a_chain_takes_a_link_once(spark):
    from tessera.plans.q_graph import _link_chain

    class Inputs:
        patents = spark.createDataFrame([(1,), (2,)], "codigo_interno long")

        def patent_part(self, name):
            return spark.createDataFrame([(1, 2, "A"), (2, 1, "A")], "codigo_interno long, codigo_interno_vinculado long, tipo_vinculo string")

    assert sorted(r.path for r in _link_chain(Inputs()).collect()) == [[1, 2], [1, 2, 1], [2, 1], [2, 1, 2]]


@pytest.mark.parametrize("raw, want", [(None, None), ("", None), ("0", None), ("00000000", None), ("20240229", "2024-02-29"), ("20230229", None), ("2024022", None), (" 20240101 ", "2024-01-01"), ("2024-1-1", None)])
def test_dates_of_eight_digits(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "c string").select(C.clean_date("c").cast("string").alias("v")).first()["v"]
    assert got == want


@pytest.mark.parametrize("v, money, compact", [(None, "R$ 0", "R$ 0"), (0.5, "R$ 1", "R$ 0,5"), (-1234.5, "-R$ 1.235", "-R$ 1,2 mil"), (1500000, "R$ 1.500.000", "R$ 1,5 mi"),
                                               (2e9, "R$ 2.000.000.000", "R$ 2 bi"), (999, "R$ 999", "R$ 999")])
def test_money_as_it_is_shown(spark, v, money, compact):
    got = spark.createDataFrame([(None if v is None else float(v),)], "v double").select(C.money_text("v").alias("m"), C.compact_money("v").alias("c")).first()
    assert (got.m.replace("\u00a0", " "), got.c.replace("\u00a0", " ")) == (money, compact)


def test_neighbours_equal_brute_force_and_blocks_are_pruned(spark):
    import numpy as np
    from tessera.operators.vectors import knn
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 24))
    x = np.concatenate([m + 0.1 * rng.normal(size=(60, 24)) for m in middles] + [middles[:1].repeat(4, 0), np.zeros((1, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None), (9998, [float("nan")] * 24)], "vec_id long, embedding array<double>")
    figures = {}
    got = {}
    for r in knn(df, 5, tile=25, figures=figures).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbour, r.cosine)
    u = x[:-1] / np.linalg.norm(x[:-1], axis=1)[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    assert sorted(got) == list(range(len(u)))
    for i in got:
        want = np.sort(cos[i])[::-1][:5]
        assert [got[i][k][1] for k in range(1, 6)] == [round(float(c), 6) for c in want]
        assert len({n for n, _ in got[i].values()}) == 5
    assert figures["asked"] < 0.5 * figures["possible"]
    assert knn(df.limit(1)).count() == 0
    assert [(r.id, r.neighbour) for r in knn(df.filter("vec_id < 2")).orderBy("id").collect()] == [(0, 1), (1, 0)]


def test_a_run_is_replaced_as_a_whole(spark, tmp_path):
    from tessera.operators.topics import TopicRuns
    corpus = spark.createDataFrame([(i, f"apple pear {'plum' if i % 2 else 'fig'} word{i % 3}") for i in range(30)], "id long, text string")
    assign = corpus.select("id", F.concat(F.lit("t"), (F.col("id") % 2)).alias("topic"))
    runs = TopicRuns(spark, str(tmp_path / "runs"))
    runs.replace("a", corpus, assign, min_df=2)
    runs.replace("b", corpus, assign.filter("id < 10"), min_df=2)
    # a rerun that dies after its first table changes nothing
    class Broken(TopicRuns):
        def _run(self, run_id):
            run = super()._run(run_id)
            run.tidy = lambda: None
            return run
    broken = Broken(spark, str(tmp_path / "runs"))
    path = broken._run("a").next_path()
    assign.limit(1).write.parquet(f"{path}/topics")
    assert runs.read("assignments").groupBy("run_id").count().orderBy("run_id").collect() == [("a", 30), ("b", 10)]
    runs.replace("a", corpus, assign.filter("topic = 't1'"), min_df=2)
    assert {(r.run_id, r.topic) for r in runs.read("topics").collect()} == {("a", "t1"), ("b", "t0"), ("b", "t1")}
    assert runs.read("assignments").filter("run_id = 'a'").count() == 15
