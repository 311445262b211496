"""DuckDB statement of the organization proxies, validation and geography."""

from __future__ import annotations

from tessera.plans.oracle_base import CTES, MATERIALIZE, dv_sql, nb
from tessera.plans.oracle_funding import city_key_sql
from tessera.sources.proxies import REGION_UF
from tessera.sources.proxies_orgs import COLLECTIONS

_COLL = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in COLLECTIONS.items()) + " END"


def _uf(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {k} THEN '{v}'" for k, v in REGION_UF.items()) + " END"


_IC = "(upper(left(n_name, 1)) || lower(substr(n_name, 2)))"
_CITY = (f"CASE WHEN n_nationkey % 3 = 0 THEN 'São ' || {_IC} WHEN n_nationkey % 3 = 1 THEN 'Guaíba ' || {_IC} "
         f"ELSE {_IC} END")
_FMT = ("substr(_full, 1, 2) || '.' || substr(_full, 3, 3) || '.' || substr(_full, 6, 3) || '/' "
        "|| substr(_full, 9, 4) || '-' || substr(_full, 13, 2)")

CTES["raw_orgs"] = f"""
SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS manifest_id, {_COLL} AS collection,
  CAST(user_id AS VARCHAR) AS record_id, 'Org ' || CAST(user_id AS VARCHAR) AS nome,
  'ORG' || CAST(user_id % 100 AS VARCHAR) AS sigla,
  CASE WHEN user_id % 4 = 0 THEN '' ELSE 'Instituto ' || (user_id % 50) || ' S.A.' END AS razao_social,
  CASE WHEN user_id % 3 = 0 THEN ' Organization ' ELSE 'COMPANY' END AS tipo,
  'Categoria ' || upper(event_type[1]) || lower(event_type[2:]) AS categoria, 'Estado de ' || {_IC} AS estado,
  CASE WHEN user_id % 7 = 0 THEN '' ELSE {_FMT} END AS cnpj,
  ' ' || CASE WHEN user_id % 5 = 0 THEN translate({_CITY}, 'ãíÃÍ', 'aiAI') ELSE {_CITY} END || ' ' AS cidade,
  CASE WHEN user_id % 11 = 0 THEN {_uf('(n_regionkey + 1) % 5')} ELSE {_uf('n_regionkey')} END AS uf,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE round(CAST(n_regionkey * 4 - 30 AS DOUBLE) + (value % 4.0), 6) END AS latitude,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE round(CAST((CASE WHEN user_id % 6 = 0 THEN (user_id + 1) % 25 ELSE user_id % 25 END) * 2 - 70 AS DOUBLE)
       + (value % 2.0), 6) END AS longitude,
  ts AS collected_at, CASE WHEN event_id % 50 = 0 THEN props || ' key=AIza' || lpad(event_id::VARCHAR, 35, 'x') || '&z' ELSE props END AS payload, [' tech ', '', event_type] AS areas
FROM (SELECT e.*, n.*, _b || {dv_sql('_b')} AS _full FROM
      (SELECT *, LPAD(CAST(user_id % 1500 AS VARCHAR), 8, '0') || '0001' AS _b FROM events) e
      JOIN nation n ON n.n_nationkey = e.user_id % 25) t
"""


_norm = nb


CTES["orgs"] = f"""
SELECT id, manifest_id, collection, record_id, COALESCE({_norm('nome')}, {_norm('sigla')}) AS nome,
       {_norm('sigla')} AS sigla, {_norm('razao_social')} AS razao_social, lower({_norm('tipo')}) AS tipo, {_norm('categoria')} AS categoria,
       {_norm('cnpj')} AS cnpj, {_norm('cidade')} AS cidade, {_norm('estado')} AS estado, {_norm('uf')} AS uf,
       latitude, longitude, collected_at,
       list_filter(list_transform(areas, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS areas,
       regexp_replace(payload, 'AIza[0-9A-Za-z\\-_]{{35}}', '[REDACTED]', 'g') AS payload
FROM raw_orgs
"""

CTES["org_named"] = """
SELECT * REPLACE (CASE collection WHEN 'incubadoras' THEN 'incubators' WHEN 'aceleradoras' THEN 'accelerators'
    WHEN 'parques' THEN ['operationParks', 'implantationParks', 'planningParks'][rid % 3 + 1]
    WHEN 'empresas' THEN ['incubatedCompanies', 'graduatedCompanies'][rid % 2 + 1]
    ELSE ['residentCompanies', 'acceleratedCompanies', 'others'][rid % 3 + 1] END AS collection),
  ['App\\Models\\Incubator', 'App\\Models\\Accelerator', 'App\\Models\\Park', NULL][rid % 4 + 1] AS linkable_type,
  CASE WHEN rid % 4 < 3 THEN (rid + 1) % 150 END AS linkable_id
FROM (SELECT *, record_id::INTEGER AS rid FROM raw_orgs)
"""

CTES["orgs_latest"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY collection, record_id
  ORDER BY collected_at DESC, id DESC) AS rn FROM orgs) t WHERE rn = 1
"""

CTES["orgs_poly"] = """
SELECT collection, record_id, codigo AS poly_codigo, nome AS poly_nome, uf AS poly_uf FROM (
  SELECT o.collection, o.record_id, g.codigo, g.nome, g.uf,
         row_number() OVER (PARTITION BY o.collection, o.record_id
                            ORDER BY CASE WHEN g.uf = o.uf THEN 0 ELSE 1 END, g.codigo) AS rn
  FROM orgs_latest o JOIN geo_muni g
    ON o.longitude BETWEEN g.x0 AND g.x0 + 2 AND o.latitude BETWEEN g.y0 AND g.y0 + 4
  WHERE o.latitude IS NOT NULL AND o.longitude IS NOT NULL) t WHERE rn = 1
"""

CTES["orgs_validation"] = f"""
SELECT o.*, p.poly_codigo, p.poly_nome, p.poly_uf,
  (o.latitude IS NULL OR o.longitude IS NULL OR p.poly_codigo IS NULL
   OR COALESCE(o.uf, '') <> COALESCE(p.poly_uf, '')
   OR lower(trim(COALESCE(o.cidade, ''))) <> lower(trim(COALESCE(p.poly_nome, '')))) AS is_issue,
  CASE WHEN o.latitude IS NULL OR o.longitude IS NULL THEN 'coordinates_missing'
       WHEN p.poly_codigo IS NULL THEN 'polygon_not_found'
       WHEN COALESCE(o.uf, '') <> COALESCE(p.poly_uf, '') THEN 'state_mismatch'
       WHEN {city_key_sql("COALESCE(o.cidade, '')")} <> {city_key_sql("COALESCE(p.poly_nome, '')")} THEN 'municipality_mismatch'
       ELSE 'ok' END AS status
FROM orgs_latest o LEFT JOIN orgs_poly p ON p.collection = o.collection AND p.record_id = o.record_id
"""

CTES["org_seeds"] = """
SELECT collection, record_id,
  CASE WHEN length(d) = 14 THEN d END AS cnpj_14, CASE WHEN length(d) = 14 THEN left(d, 8) END AS cnpj_basico,
  CASE WHEN length(d) = 14 THEN substr(d, 9, 4) END AS cnpj_ordem, CASE WHEN length(d) = 14 THEN substr(d, 13, 2) END AS cnpj_dv,
  CASE WHEN length(d) = 14 THEN 'pending' ELSE 'invalid' END AS status
FROM (SELECT *, regexp_replace(COALESCE(cnpj, ''), '[^0-9]', '', 'g') AS d FROM orgs_latest) t
"""

CTES["infer_state"] = """
SELECT codigo_municipio, CASE WHEN COUNT(DISTINCT uf) = 1 THEN max(uf) END AS uf_inferida, COUNT(DISTINCT uf) AS n_ufs
FROM estab WHERE codigo_municipio IS NOT NULL AND uf IS NOT NULL GROUP BY codigo_municipio
"""


def name_key_sql(c: str) -> str:
    return (f"trim(regexp_replace(trim(regexp_replace(strip_accents(upper({c})), '[^A-Z0-9]+', ' ', 'g')), "
            f"'\\s+', ' ', 'g'))")


CTES["crosswalk"] = f"""
SELECT codigo_municipio, nome_rf, uf_inferida, CASE WHEN status = 'mapped' THEN codigo_ibge END AS codigo_ibge,
       n_cand, status FROM (
  SELECT r.codigo AS codigo_municipio, r.nome AS nome_rf, i.uf_inferida, n.codigo AS codigo_ibge,
         COUNT(n.codigo) OVER (PARTITION BY r.codigo) AS n_cand,
         CASE WHEN i.uf_inferida IS NULL THEN 'no_state'
              WHEN COUNT(n.codigo) OVER (PARTITION BY r.codigo) = 0 THEN 'not_found'
              WHEN COUNT(n.codigo) OVER (PARTITION BY r.codigo) = 1 THEN 'mapped' ELSE 'ambiguous' END AS status,
         row_number() OVER (PARTITION BY r.codigo ORDER BY n.codigo ASC NULLS LAST) AS rn
  FROM lk_municipio r LEFT JOIN infer_state i ON i.codigo_municipio = r.codigo
  LEFT JOIN geo_muni n ON {name_key_sql('n.nome')} = {name_key_sql('r.nome')} AND n.uf = i.uf_inferida) t
WHERE rn = 1
"""

MATERIALIZE.update({"raw_orgs", "orgs", "orgs_latest", "orgs_validation"})
