"""Geography and innovation-organization queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import geo as GEO
from tessera.operators import orgs as OR
from tessera.operators.common import page, with_total
from tessera.plans import oracle_orgs as OO  # noqa: F401  (prelude tables)
from tessera.plans.catalog import register
from tessera.plans.oracle_base import CTES
from tessera.sources.proxies import city_points
from tessera.sources.proxies_orgs import raw_orgs


def _orgs(I):
    return OR.flatten_orgs(raw_orgs(I.spark, I.sf_dir))


def _latest(I):
    return OR.latest_orgs(_orgs(I))


def _validation(I):
    return OR.validation_rows(_latest(I), I.geo_muni)


_ORG_COLS = ["id", "manifest_id", "collection", "record_id", "nome", "sigla", "razao_social", "tipo", "categoria", "cnpj", "cidade", "estado", "uf", "latitude",
             "longitude", "collected_at", "areas", "payload"]

register("org_snapshots", "SELECT * FROM orgs")(lambda I: _orgs(I).select(*_ORG_COLS))
register("latest_orgs", "SELECT * FROM orgs_latest")(lambda I: _latest(I).select(*_ORG_COLS))
register("redact_secrets", """
SELECT id, regexp_replace(payload, 'AIza[0-9A-Za-z\\-_]{35}', '[REDACTED]', 'g') AS payload FROM raw_orgs
""")(lambda I: raw_orgs(I.spark, I.sf_dir).select("id", OR.redact_secrets(F.col("payload")).alias("payload")))
register("clean_array", """
SELECT id, list_filter(list_transform(areas, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS areas FROM raw_orgs
""")(lambda I: raw_orgs(I.spark, I.sf_dir).select("id", OR.clean_array(F.col("areas")).alias("areas")))

register("search_orgs", """
SELECT collection, record_id FROM orgs_latest
WHERE (contains(lower(nome), 'org 1') OR contains(lower(coalesce(razao_social, '')), 'org 1') OR contains(lower(coalesce(sigla, '')), 'org 1'))
  AND collection = 'empresas' AND uf = 'SP'
""")(lambda I: OR.search_orgs(_latest(I), q="org 1", collection="empresas", uf="sp").select(
    "collection", "record_id"))
register("search_orgs_fields", """
SELECT collection, record_id FROM orgs_latest WHERE contains(lower(coalesce(razao_social, '')), 'instituto 1') AND tipo = 'company'
  AND contains(lower(categoria), 'categoria') AND contains(lower(cidade), 'a') AND contains(lower(estado), 'estado de')
""")(lambda I: OR.search_orgs(_latest(I), q="INSTITUTO 1", kind=" Company ", category="categoria", city="a", state="ESTADO DE").select(
    "collection", "record_id"))
register("scope_orgs", """
SELECT collection, record_id FROM orgs_latest WHERE contains(lower(concat_ws('|', nome, cidade, categoria, collection)), 'guaíba') AND tipo = 'company'
UNION ALL SELECT collection, record_id FROM orgs_latest WHERE contains(lower(collection), 'parque') AND uf = 'SP'
""")(lambda I: OR.scope_orgs(_latest(I), q="guaíba", kind="company").select("collection", "record_id").unionByName(
    OR.scope_orgs(_latest(I), q="PARQUE", uf="sp").select("collection", "record_id")))
register("raw_payload", """
SELECT id, payload FROM orgs WHERE contains(payload, '[REDACTED]') OR id % 50 <> 0
""")(lambda I: _orgs(I).select("id", "payload"))

register("assign_polygon", "SELECT collection, record_id, poly_codigo, poly_nome, poly_uf FROM orgs_poly")(
    lambda I: _validation(I).filter(F.col("poly_codigo").isNotNull()).select(
        "collection", "record_id", "poly_codigo", "poly_nome", "poly_uf"))
register("bbox_candidates", """
SELECT o.collection || '/' || o.record_id AS pid, g.codigo FROM orgs_latest o JOIN geo_muni g
  ON o.longitude BETWEEN g.x0 AND g.x0 + 2 AND o.latitude BETWEEN g.y0 AND g.y0 + 4
""")(lambda I: GEO.bbox_candidates(
    _latest(I).filter(F.col("latitude").isNotNull()).select(
        F.concat_ws("/", "collection", "record_id").alias("pid"), F.col("longitude").alias("x"),
        F.col("latitude").alias("y")), I.geo_muni).select("pid", "codigo"))
register("issue_predicate", "SELECT collection, record_id, is_issue FROM orgs_validation")(
    lambda I: _validation(I).select("collection", "record_id", "is_issue"))
register("fn_validation_status", "SELECT collection, record_id, status, is_issue FROM orgs_validation")(
    lambda I: _validation(I).select("collection", "record_id", "status", "is_issue"))
register("validation_summary", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE is_issue) AS issues, COUNT(*) FILTER (WHERE status = 'ok') AS ok
FROM orgs_validation
""")(lambda I: OR.validation_summary(_validation(I)))
register("divergence_pct", """
SELECT count(*) AS total, count(*) FILTER (is_issue) AS issues, 100.0 * count(*) FILTER (is_issue) / count(*) AS divergence_pct FROM orgs_validation
UNION ALL SELECT 0, 0, 0.0
""")(lambda I: OR.divergence_pct(OR.validation_summary(_validation(I))).unionByName(OR.divergence_pct(OR.validation_summary(_validation(I).limit(0)))))
register("top_declared", """
SELECT cidade, COUNT(*) AS total FROM orgs_validation WHERE cidade IS NOT NULL GROUP BY cidade
ORDER BY total DESC, cidade LIMIT 10
""")(lambda I: OR.top_cities(_validation(I), "cidade"))
register("top_polygon", """
SELECT poly_nome AS cidade, COUNT(*) AS total FROM orgs_validation WHERE poly_nome IS NOT NULL GROUP BY poly_nome
ORDER BY total DESC, cidade LIMIT 10
""")(lambda I: OR.top_cities(_validation(I), "poly_nome"))
register("severity_order", """
SELECT collection, record_id, status FROM orgs_validation
ORDER BY CASE status WHEN 'coordinates_missing' THEN 0 WHEN 'polygon_not_found' THEN 1 WHEN 'state_mismatch' THEN 2
  WHEN 'municipality_mismatch' THEN 3 ELSE 4 END, nome NULLS LAST, record_id, collection
""")(lambda I: OR.severity_order(_validation(I)).select("collection", "record_id", "status"))
register("page_with_total", """
SELECT collection, record_id, total FROM (
  SELECT collection, record_id, nome, COUNT(*) OVER () AS total FROM orgs_validation WHERE is_issue) t
ORDER BY nome, collection, record_id LIMIT 20 OFFSET 20
""")(lambda I: page(with_total(_validation(I).filter("is_issue")),
                    [F.col("nome"), F.col("collection"), F.col("record_id")], 2, 20)
     .select("collection", "record_id", "total"))
register("collection_counts", """
SELECT COALESCE(collection, 'total') AS collection, COUNT(*) AS n FROM orgs GROUP BY ROLLUP (collection)
""")(lambda I: _orgs(I).rollup("collection").agg(F.count(F.lit(1)).alias("n"))
     .select(F.coalesce("collection", F.lit("total")).alias("collection"), "n"))

register("seed_matches", "SELECT * FROM org_seeds")(lambda I: OR.seed_matches(_latest(I)))
register("match_orgs", """
SELECT s.collection, s.record_id, s.cnpj_14,
  CASE WHEN s.status = 'invalid' THEN 'invalid' WHEN e.cnpj_basico IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status,
  CASE WHEN s.status = 'pending' AND e.cnpj_basico IS NOT NULL THEN 'exact_cnpj' END AS method,
  CASE WHEN s.status = 'pending' AND e.cnpj_basico IS NOT NULL THEN 1.0 END AS confidence
FROM org_seeds s LEFT JOIN estab e ON e.cnpj_basico = s.cnpj_basico AND e.cnpj_ordem = s.cnpj_ordem AND e.cnpj_dv = s.cnpj_dv
""")(lambda I: OR.match_orgs(OR.seed_matches(_latest(I)), I.establishments, I.companies).drop("evidence"))

register("evidence", """
SELECT s.record_id, s.collection, c.razao_social, e.situacao_cadastral FROM org_seeds s
JOIN estab e ON e.cnpj_basico = s.cnpj_basico AND e.cnpj_ordem = s.cnpj_ordem AND e.cnpj_dv = s.cnpj_dv
LEFT JOIN empresa c ON c.cnpj_basico = s.cnpj_basico WHERE s.status = 'pending'
""")(lambda I: OR.match_orgs(OR.seed_matches(_latest(I)), I.establishments, I.companies)
     .filter(F.col("evidence").isNotNull()).select(
         "record_id", "collection",
         F.get_json_object("evidence", "$.razao_social").alias("razao_social"),
         F.get_json_object("evidence", "$.situacao_cadastral").alias("situacao_cadastral")))

# geography --------------------------------------------------------------------------

register("polygon_centroid", """
SELECT codigo, round(x0 + 1, 6) AS longitude, round(y0 + 2, 6) AS latitude FROM geo_muni
""")(lambda I: GEO.polygon_centroid(I.geo_muni))
register("polygon_area", """
SELECT codigo, round(radians(2.0) * 6371.0088 * 6371.0088 * (sin(radians(y0 + 4)) - sin(radians(y0))), 3) AS area_km2
FROM geo_muni
""")(lambda I: GEO.polygon_area(I.geo_muni))
register("geojson_rounding", """
SELECT codigo, 'Polygon' AS type, round(x0, 5) AS x0, round(y0, 5) AS y0, round(x0 + 2, 5) AS x1, round(y0 + 4, 5) AS y1, 5 AS points FROM geo_muni
""")(lambda I: GEO.to_geojson(I.geo_muni).select(
    "codigo", F.get_json_object("geometry", "$.type").alias("type"), F.get_json_object("geometry", "$.coordinates[0][0][0]").cast("double").alias("x0"),
    F.get_json_object("geometry", "$.coordinates[0][0][1]").cast("double").alias("y0"), F.get_json_object("geometry", "$.coordinates[0][2][0]").cast("double").alias("x1"),
    F.get_json_object("geometry", "$.coordinates[0][2][1]").cast("double").alias("y1"),
    F.size(F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>")[0]).alias("points")))

# multi-polygons ---------------------------------------------------------------------

CTES["geo_multi"] = """
SELECT codigo, codigo_uf, uf, nome, x0, y0, substr(codigo, 3)::INT - 1 AS k, (substr(codigo, 3)::INT - 1) % 2 = 0 AS two FROM geo_muni
"""


def _multi(I):
    from tessera.sources.proxies import geo_frame
    return GEO.geography_rows(geo_frame(I.spark, I.sf_dir), "municipality", 2020, True, "geobr").withColumnRenamed("municipality_ibge_code", "codigo")


def _upserted(I):
    """A first load of some towns under other names, then of most of them."""
    from tessera.sources.proxies import geo_frame
    frame = geo_frame(I.spark, I.sf_dir)
    first = GEO.upsert_geography(None, frame.filter("k < 20").withColumn("name_muni", F.upper("name_muni")), "municipality", 2010)
    second = GEO.upsert_geography(first, frame.filter("k % 5 > 0").drop("k"), "municipality", 2020)
    return second.select("municipality_ibge_code", "state_ibge_code", "state_abbrev", "municipality_name", "geobr_year", "geometry_srid", "latitude", "longitude",
                         "area_km2", F.size("parts").alias("parts"), F.size(F.col("parts")[0]).alias("rings"))


_AREA = "round(6371.0088 * 6371.0088 * ({}), 3)".format(
    "CASE WHEN two THEN radians(1.5) * (sin(radians(y0 + 4)) - sin(radians(y0))) - radians(0.5) * (sin(radians(y0 + 2)) - sin(radians(y0 + 1))) "
    "+ radians(0.375) * (sin(radians(y0 + 1)) - sin(radians(y0))) ELSE radians(2.0) * (sin(radians(y0 + 4)) - sin(radians(y0))) END")
register("upsert_geography", f"""
SELECT codigo AS municipality_ibge_code, codigo_uf AS state_ibge_code, uf AS state_abbrev, CASE WHEN k % 5 > 0 THEN nome ELSE upper(nome) END AS municipality_name,
  CASE WHEN k % 5 > 0 THEN 2020 ELSE 2010 END AS geobr_year, 4674 AS geometry_srid, CASE WHEN two THEN y0 + 3 ELSE y0 + 2 END AS latitude,
  CASE WHEN two THEN x0 + 0.75 ELSE x0 + 1 END AS longitude, {_AREA} AS area_km2, CASE WHEN two THEN 2 ELSE 1 END AS parts, CASE WHEN two THEN 2 ELSE 1 END AS rings
FROM geo_multi WHERE k < 20 OR k % 5 > 0
""")(_upserted)
# area-weighted: 1.5 x 4 less a hole of 0.5 x 1 and 0.375 x 1 beside it
register("multi_polygon_centroid", """
SELECT codigo, round(CASE WHEN two THEN (6.0 * (x0 + 0.75) - 0.5 * (x0 + 0.75) + 0.375 * (x0 + 1.8125)) / 5.875 ELSE x0 + 1 END, 6) AS longitude,
  round(CASE WHEN two THEN (6.0 * (y0 + 2) - 0.5 * (y0 + 1.5) + 0.375 * (y0 + 0.5)) / 5.875 ELSE y0 + 2 END, 6) AS latitude FROM geo_multi
""")(lambda I: GEO.polygon_centroid(_multi(I).select("codigo", "parts")))
register("multi_polygon_geojson", """
SELECT codigo, 'MultiPolygon' AS type, CASE WHEN two THEN 2 ELSE 1 END AS parts, CASE WHEN two THEN x0 + 1.625 END AS x_second, CASE WHEN two THEN y0 + 2 END AS y_hole FROM geo_multi
""")(lambda I: GEO.to_geojson(_multi(I)).select(
    "codigo", F.get_json_object("geometry", "$.type").alias("type"),
    F.size(F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<array<double>>>>")).alias("parts"),
    F.get_json_object("geometry", "$.coordinates[1][0][0][0]").cast("double").alias("x_second"),
    F.get_json_object("geometry", "$.coordinates[0][1][2][1]").cast("double").alias("y_hole")))

_POINTS = f"""
SELECT event_id AS pid, (k * 2 - 70)::DOUBLE + value % 2.0 AS x, (n_regionkey * 4 - 30)::DOUBLE + (value * 7) % 4.0 AS y, {OO._uf('n_regionkey')} AS uf
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 7 ELSE user_id % 25 END AS k FROM events) e JOIN nation n ON n.n_nationkey = e.k
"""
register("multi_polygon_covers", f"""
WITH p AS ({_POINTS}) SELECT p.pid, g.codigo FROM p JOIN geo_multi g ON (NOT two AND x BETWEEN x0 AND x0 + 2 AND y BETWEEN y0 AND y0 + 4)
  OR (two AND x BETWEEN x0 AND x0 + 1.5 AND y BETWEEN y0 AND y0 + 4 AND NOT (x > x0 + 0.5 AND x < x0 + 1 AND y > y0 + 1 AND y < y0 + 2))
  OR (two AND x BETWEEN x0 + 1.625 AND x0 + 2 AND y BETWEEN y0 AND y0 + 1)
""")(lambda I: GEO.covers(city_points(I.spark, I.sf_dir), _multi(I)))
register("assign_polygon_city", f"""
WITH p AS ({_POINTS}),
hit AS (SELECT p.pid, g.codigo, row_number() OVER (PARTITION BY p.pid ORDER BY CASE WHEN g.uf = p.uf THEN 0 ELSE 1 END, g.codigo) AS rn
  FROM p JOIN geo_muni g ON x BETWEEN x0 AND x0 + 2 AND y BETWEEN y0 AND y0 + 4)
SELECT p.pid, h.codigo FROM p LEFT JOIN hit h ON h.pid = p.pid AND rn = 1
""")(lambda I: GEO.assign_polygon(city_points(I.spark, I.sf_dir), I.geo_muni).select("pid", "codigo"))

# map output -------------------------------------------------------------------------


def _feature_rows(I):
    """The written collection, read back: a row a feature, the metadata beside."""
    from tessera.operators import geo_features as GF
    from tessera.operators.common import attach_scalars
    from tessera.plans.q_io import scratch
    path = GF.write_feature_collection(GF.municipality_features(I.by_municipality, I.geo_muni), scratch(I.spark, "features"))
    lines = I.spark.read.text(path)
    head = F.col("value").startswith('{"type":"FeatureCollection"')
    meta = lines.filter(head).select(F.from_json(F.concat("value", F.lit("]}")), "metadata struct<feature_count: long, municipalities_with_value: long, "
                                                 "max_total_aprovado_finep: double, simplify_tolerance: double>").alias("m")).select("m.metadata.*")
    feature = F.from_json(F.ltrim(F.col("value"), F.lit(",")), "id string, properties struct<municipio_nome: string, uf: string, latitude: double, longitude: double, "
                          "total_empresas: long, total_projetos: long, total_aprovado_finep: double, total_liberado: double, fontes: array<string>>, "
                          "geometry struct<type: string, coordinates: array<array<array<double>>>>")
    rows = lines.filter(~head & (F.col("value") != "]}")).select(feature.alias("f")).select(
        F.col("f.id").alias("municipality_ibge_code"), "f.properties.*", F.size(F.col("f.geometry.coordinates")[0]).alias("points"))
    return attach_scalars(rows, meta)


register("municipality_features", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY municipality_ibge_code ORDER BY total_aprovado_finep, total_projetos, municipio_nome DESC) AS rn FROM f_by_muni
           WHERE municipality_ibge_code IS NOT NULL),
f AS (SELECT g.codigo AS municipality_ibge_code, g.nome AS municipio_nome, g.uf, coalesce(s.latitude, g.latitude) AS latitude, coalesce(s.longitude, g.longitude) AS longitude,
    coalesce(total_empresas, 0) AS total_empresas, coalesce(total_projetos, 0) AS total_projetos, coalesce(total_aprovado_finep, 0)::DOUBLE AS total_aprovado_finep,
    coalesce(total_liberado, 0)::DOUBLE AS total_liberado, coalesce(fontes, []) AS fontes, 5 AS points
  FROM geo_muni g LEFT JOIN s ON s.municipality_ibge_code = g.codigo AND rn = 1)
SELECT *, count(*) OVER () AS feature_count, count(*) FILTER (total_aprovado_finep > 0) OVER () AS municipalities_with_value,
  max(total_aprovado_finep) OVER () AS max_total_aprovado_finep, 0.0::DOUBLE AS simplify_tolerance FROM f
""")(_feature_rows)
register("infer_state", "SELECT * FROM infer_state")(lambda I: GEO.infer_state(I.establishments))
register("build_crosswalk", "SELECT * FROM crosswalk")(
    lambda I: GEO.build_crosswalk(I.municipios, GEO.infer_state(I.establishments), I.geo_muni))
# towns that the national table lacks, has twice, or that no state can be inferred for
register("crosswalk_issues", f"""
WITH n AS (SELECT codigo, uf, nome FROM geo_muni WHERE substr(codigo, 3)::INT % 5 > 0
           UNION ALL SELECT codigo || 'x', uf, nome FROM geo_muni WHERE substr(codigo, 3)::INT % 5 = 1),
i AS (SELECT codigo_municipio, CASE WHEN codigo_municipio::INT % 5 <> 3 THEN uf_inferida END AS uf_inferida, n_ufs FROM infer_state),
j AS (SELECT r.codigo AS codigo_municipio, r.nome AS nome_rf, i.uf_inferida, count(n.codigo) AS n_cand FROM lk_municipio r LEFT JOIN i ON i.codigo_municipio = r.codigo
  LEFT JOIN n ON {OO.name_key_sql('n.nome')} = {OO.name_key_sql('r.nome')} AND n.uf = i.uf_inferida GROUP BY ALL)
SELECT codigo_municipio, nome_rf, uf_inferida, NULL::VARCHAR AS codigo_ibge, n_cand,
  CASE WHEN uf_inferida IS NULL THEN 'no_state' WHEN n_cand = 0 THEN 'not_found' ELSE 'ambiguous' END AS status FROM j WHERE uf_inferida IS NULL OR n_cand <> 1
""")(lambda I: _crosswalk_issues(I))


def _crosswalk_issues(I):
    num = F.substring("codigo", 3, 5).cast("int")
    national = I.geo_muni.filter(num % 5 > 0)
    national = national.unionByName(I.geo_muni.filter(num % 5 == 1).withColumn("codigo", F.concat("codigo", F.lit("x"))))
    inferred = GEO.infer_state(I.establishments).withColumn("uf_inferida", F.when(F.col("codigo_municipio").cast("int") % 5 != 3, F.col("uf_inferida")))
    return GEO.build_crosswalk(I.municipios, inferred, national).filter(F.col("status") != "mapped")



register("municipality_geo", """
SELECT c.*, g.nome AS nome_ibge, g.uf, g.latitude, g.longitude FROM crosswalk c
LEFT JOIN geo_muni g ON g.codigo = c.codigo_ibge
""")(lambda I: GEO.municipality_geo(
    GEO.build_crosswalk(I.municipios, GEO.infer_state(I.establishments), I.geo_muni), I.geo_muni))
register("geo_gate", """
SELECT (SELECT count(*) FROM region) AS states, (SELECT count(*) FROM geo_muni) AS municipalities, (SELECT count(*) FROM crosswalk WHERE status = 'mapped') AS mapped,
  (SELECT count(*) FROM crosswalk WHERE status <> 'mapped') AS issues, false AS passed
""")(lambda I: GEO.geo_gate(
    I.geo_state, I.geo_muni, GEO.build_crosswalk(I.municipios, GEO.infer_state(I.establishments), I.geo_muni)))

register("fn_parse_ts", """
SELECT id, CAST(strftime(collected_at, '%Y-%m-%dT%H:%M:%S') AS VARCHAR) AS raw,
       CAST(strptime(strftime(collected_at, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS v
FROM raw_orgs
""")(lambda I: raw_orgs(I.spark, I.sf_dir).select(
    "id", F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("raw"),
    C.parse_ts(F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("v")))
register("fn_to_decimal", """
SELECT id, TRY_CAST(CAST(latitude AS VARCHAR) AS DECIMAL(10,6)) AS v FROM raw_orgs
""")(lambda I: raw_orgs(I.spark, I.sf_dir).select("id", C.to_decimal(F.col("latitude").cast("string"), 10, 6)
                                                  .alias("v")))
register("fn_geo_code", """
SELECT codigo, CASE WHEN length(regexp_replace(codigo, '[^0-9]', '', 'g')) > 0
  THEN LPAD(regexp_replace(codigo, '[^0-9]', '', 'g'), 7, '0') END AS v FROM geo_muni
""")(lambda I: I.geo_muni.select("codigo", C.geo_code(F.col("codigo"), 7).alias("v")))
