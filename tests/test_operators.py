"""Operator semantics on small hand-made inputs and properties."""

from pyspark.sql import functions as F

from tessera.operators import funding as FU
from tessera.operators import geo as GEO
from tessera.operators import graph as G
from tessera.sources import sinks as S


def test_gini_golden(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("b", 10.0),
            ("c", 1.0), ("c", 2.0), ("c", 3.0), ("c", 4.0), ("e", 0.0), ("e", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["gini"] for r in FU.gini(df, "v", ["g"]).collect()}
    assert got == {"a": 0.0, "b": 0.666667, "c": 0.25, "e": 0.0}
    empty = spark.createDataFrame([], "v double")
    assert FU.gini(empty, "v").first()["gini"] == 0.0


def _sample_edges(spark):
    # the reference's sample graph: company 12345678 with partners Ana,
    # Roberto and a holding; Carlos owns the holding, Ana also owns Energia
    rows = [("P:ana", "C:12345678"), ("P:roberto", "C:12345678"), ("C:holding", "C:12345678"),
            ("P:carlos", "C:holding"), ("P:ana", "C:energia")]
    return spark.createDataFrame([(s, d, "2026-02", "SOCIO_DE") for s, d in rows],
                                 "src string, dst string, reference_month string, type string")


def test_company_network_sample(spark):
    edges = _sample_edges(spark)
    seeds = spark.createDataFrame([("12345678",)], "cnpj_basico string")
    d1 = G.company_network(seeds, edges, 1)
    assert d1.count() == 3
    d2 = G.company_network(seeds, edges, 2)
    assert d2.count() == 5
    assert d2.filter("truncated").count() == 0


def test_person_network_sample(spark):
    edges = _sample_edges(spark)
    seeds = spark.createDataFrame([("ana",)], "pessoa_id string")
    assert G.person_network(seeds, edges, 1).count() == 2


def test_network_limit_is_exact(spark):
    rows = [(f"P:{i:04d}", "C:hub", "m", "SOCIO_DE") for i in range(250)]
    edges = spark.createDataFrame(rows, "src string, dst string, reference_month string, type string")
    seeds = spark.createDataFrame([("hub",)], "cnpj_basico string")
    net = G.company_network(seeds, edges, 1, limit=200)
    assert net.count() == 200
    assert net.filter("truncated").count() == 200
    assert net.agg(F.max("src")).first()[0] == "P:0199"


def test_covers_boundary_and_holes(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    concave = [(10.0, 0.0), (14.0, 0.0), (14.0, 4.0), (12.0, 1.0), (10.0, 4.0), (10.0, 0.0)]
    polys = spark.createDataFrame(
        [("sq", [[{"x": x, "y": y} for x, y in ring], [{"x": x, "y": y} for x, y in hole]]),
         ("cc", [[{"x": x, "y": y} for x, y in concave]])],
        "codigo string, rings array<array<struct<x: double, y: double>>>")
    pts = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 4.0, 2.0), (4, 12.0, 3.0), (5, 11.0, 1.0),
                                 (6, 20.0, 20.0)], "pid int, x double, y double")
    got = {(r["pid"], r["codigo"]) for r in GEO.covers(pts, polys).collect()}
    assert got == {(1, "sq"), (3, "sq"), (5, "cc")}


def test_upsert_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = S.upsert(t, s, ["k"])
    twice = S.upsert(once, s, ["k"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r["k"]: r["v"] for r in once.collect()} == {1: "a", 2: "B", 3: "C"}


def test_first_by_stable_under_repartition(spark):
    from tessera.operators.common import first_by
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "k int, o int")
    a = first_by(df, ["k"], [F.col("o")]).collect()
    b = first_by(df.repartition(13), ["k"], [F.col("o")]).collect()
    assert sorted(a) == sorted(b)


def test_org_payload_documents_and_actors(spark, tmp_path):
    """A pretty-printed platform payload, and many documents read in pieces."""
    import json

    from pyspark.sql import functions as F
    from tessera.operators.orgs import organization_rows
    from tessera.sources.org_payload import COLLECTIONS, read_org_payload, write_org_payload
    actor = {"id": 7, "name": None, "cnpj": "50.953.719/0001-15", "active": True, "founding_date": "2023-10-23T19:41:30.000000Z", "extra": {"kept": [1, 2.50]},
             "address": {"latitude": -29.7, "city": {"id": 4316907, "name": " Santa Maria ", "state": {"id": 43, "uf": "RS"}}}, "expertise_areas": [" a ", None, ""]}
    (tmp_path / "one" / "manifest_id=20240101").mkdir(parents=True)
    doc = {"incubators": [actor, {"id": None}], "unknown": [{"id": 1}], "operationParks": [], "planningParks": None}
    (tmp_path / "one" / "manifest_id=20240101" / "p.json").write_text(json.dumps(doc, indent=1))
    got = organization_rows(read_org_payload(spark, f"{tmp_path}/one", multi_line=True))
    assert len(got.columns) == 52
    first, second = sorted(got.collect(), key=lambda r: r.source_record_id is None)
    assert (first.manifest_id, first.name, first.entity_kind, first.cnpj, first.city_ibge_code, first.city_name, first.state_abbrev, str(first.latitude)) == (
        "20240101", "source-record-7", "incubator", "50953719000115", "4316907", "Santa Maria", "RS", "-29.7000000")
    assert first.active is True and str(first.founding_date) == "2023-10-23" and first.expertise_area_codes == ["a"] and json.loads(first.raw_payload) == actor
    assert second.expertise_area_codes == [] and second.affiliated_societies_cities == "[]" and second.city_name is None
    many = spark.range(3000).select(F.lit("r1").alias("manifest_id"), F.element_at(F.array(*[F.lit(c) for c in COLLECTIONS]), (F.col("id") % 9 + 1).cast("int")).alias("collection"),
                                    F.to_json(F.struct("id", F.lit('a "b" [c] é').alias("name"))).alias("raw"))
    write_org_payload(many, f"{tmp_path}/many", per_document=100)
    assert spark.read.text(f"{tmp_path}/many").count() == 30
    back = read_org_payload(spark, f"{tmp_path}/many")
    assert sorted(map(tuple, back.select("manifest_id", "collection", "raw").collect())) == sorted(map(tuple, many.collect()))
    (tmp_path / "bad" / "manifest_id=1").mkdir(parents=True)
    (tmp_path / "bad" / "manifest_id=1" / "p.json").write_text("<html>")
    import pytest
    with pytest.raises(Exception, match="MALFORMED"):
        read_org_payload(spark, f"{tmp_path}/bad").collect()
