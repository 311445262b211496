"""DuckDB statement of the funding and geography proxies and tables."""

from __future__ import annotations

from tessera.plans.oracle_base import CTES, UF_CASE, dv_sql
from tessera.sources.proxies import FUNDING_SPLIT, UF_CODE

_FULL = "_full"
_FMT = (f"substr({_FULL}, 1, 2) || '.' || substr({_FULL}, 3, 3) || '.' || substr({_FULL}, 6, 3) || '/' "
        f"|| substr({_FULL}, 9, 4) || '-' || substr({_FULL}, 13, 2)")
_MUNI = ("CASE WHEN n.n_nationkey % 3 = 0 THEN 'São ' || n.n_name WHEN n.n_nationkey % 3 = 1 "
         "THEN 'Guaíba ' || n.n_name ELSE n.n_name END")

CTES["fbase"] = f"""
SELECT l.*, o.o_custkey, c.c_name, n.n_nationkey, n.n_regionkey,
  CASE WHEN l.l_orderkey % 97 = 0 THEN NULL WHEN l.l_linestatus = 'O' THEN 'Subvenção' ELSE 'Reembolsável' END AS f_instrument,
  CAST(l.l_orderkey AS VARCHAR) AS f_contract,
  CAST(l.l_linenumber AS VARCHAR) AS f_ref,
  strftime(l.l_shipdate, '%Y-%m-%d') AS f_signed,
  'Projeto ' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS f_title,
  CASE WHEN l.l_partkey % 50 = 0 THEN '' ELSE {_FMT} END AS f_cnpj,
  CASE WHEN l.l_partkey % 7 = 0 THEN NULL ELSE ' ' || ({_MUNI}) || '  ' END AS f_city,
  CASE WHEN l.l_partkey % 11 = 0 THEN NULL ELSE {UF_CASE.replace('n_regionkey', 'n.n_regionkey')} END AS f_uf,
  CAST(l.l_extendedprice AS DECIMAL(15,2)) AS f_approved,
  CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(15,2))), 2) AS DECIMAL(15,2)) AS f_paid,
  CASE WHEN l.l_returnflag = 'R' THEN 'Concluído' ELSE 'Em execução' END AS f_status,
  CASE WHEN l.l_partkey % 3 = 0 THEN 'Sim' WHEN l.l_partkey % 3 = 1 THEN 'Não' ELSE '' END AS f_flag
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN (SELECT c_custkey, c_name, c_nationkey, _b || {dv_sql('_b')} AS _full
      FROM (SELECT *, LPAD(CAST(c_custkey AS VARCHAR), 8, '0') || '0001' AS _b FROM customer) cb) c
  ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""


def _clean(c: str) -> str:
    return f"CASE WHEN LENGTH(TRIM(REPLACE(CAST({c} AS VARCHAR), '\"', ''))) > 0 THEN TRIM(REPLACE(CAST({c} AS VARCHAR), '\"', '')) END"


def _norm_city(c: str) -> str:
    return f"NULLIF(TRIM(regexp_replace({c}, '[\\s\\p{{Zs}}]+', ' ', 'g')), '')"


_NORM = "regexp_replace(f_cnpj, '[^0-9]', '', 'g')"

CTES["f_direct"] = f"""
SELECT f_instrument AS instrumento, f_ref AS ref, f_contract AS contrato,
       CAST(f_signed AS DATE) AS data_assinatura, f_title AS titulo, c_name AS proponente,
       {_clean('f_cnpj')} AS cnpj_proponente, {_clean('f_city')} AS municipio, f_uf AS uf,
       f_approved AS valor_finep, f_paid AS valor_pago, f_status AS status,
       regexp_replace({_clean('f_cnpj')}, '[^0-9]', '', 'g') AS cnpj_proponente_norm,
       'direct-' || f_contract || '-' || f_ref AS id
FROM fbase WHERE {FUNDING_SPLIT['direct']} AND f_instrument IS NOT NULL
"""

CTES["f_credit"] = f"""
SELECT CAST(f_signed AS DATE) AS data_assinatura, f_contract AS contrato, c_name AS proponente,
       {_clean('f_cnpj')} AS cnpj_proponente, f_uf AS uf, f_approved AS valor_financiado,
       f_paid AS valor_liberado,
       regexp_replace({_clean('f_cnpj')}, '[^0-9]', '', 'g') AS cnpj_proponente_norm,
       'credit-' || f_contract AS id
FROM fbase WHERE {FUNDING_SPLIT['credit']}
"""

_YN = ("CASE WHEN upper(strip_accents(f_flag)) = 'SIM' THEN TRUE "
       "WHEN upper(strip_accents(f_flag)) = 'NAO' THEN FALSE END")

CTES["f_equity"] = f"""
SELECT f_ref AS ref, f_contract AS contrato, {_clean('f_cnpj')} AS cnpj_proponente, c_name AS proponente,
       CAST(f_signed AS DATE) AS data_assinatura, f_approved AS valor_total_contratado,
       f_paid AS valor_total_liberado, {_YN} AS opcao_exercida, {_YN} AS desinvestido,
       CAST(0.1 AS DECIMAL(10,4)) AS tir, CAST(1.5 AS DECIMAL(10,4)) AS moic,
       regexp_replace({_clean('f_cnpj')}, '[^0-9]', '', 'g') AS cnpj_proponente_norm,
       'equity-' || f_contract || '-' || f_ref AS id
FROM fbase WHERE {FUNDING_SPLIT['equity']}
"""

CTES["f_audiovisual"] = f"""
SELECT f_instrument AS instrumento, f_ref AS ref, f_contract AS contrato,
       CAST(f_signed AS DATE) AS data_assinatura, f_title AS titulo, c_name AS proponente,
       {_clean('f_cnpj')} AS cnpj_proponente, {_clean('f_city')} AS municipio, f_uf AS uf,
       f_approved AS valor_finep, f_paid AS valor_pago, f_status AS status,
       regexp_replace({_clean('f_cnpj')}, '[^0-9]', '', 'g') AS cnpj_proponente_norm,
       'audiovisual-' || f_contract || '-' || f_ref AS id
FROM fbase WHERE {FUNDING_SPLIT['audiovisual']} AND (f_instrument IS NOT NULL OR f_contract IS NOT NULL)
"""

CTES["f_records0"] = f"""
SELECT 'operacao_direta' AS source, id AS source_id, cnpj_proponente_norm AS cnpj_14,
       {_norm_city('municipio')} AS municipio_nome, uf, COALESCE(valor_finep, 0) AS total_aprovado_finep,
       COALESCE(valor_pago, 0) AS total_liberado, instrumento FROM f_direct
UNION ALL
SELECT 'credito_descentralizado', id, cnpj_proponente_norm, NULL, uf, COALESCE(valor_financiado, 0),
       COALESCE(valor_liberado, 0), 'Credito Descentralizado' FROM f_credit
UNION ALL
SELECT 'investimento', id, cnpj_proponente_norm, NULL, NULL, COALESCE(valor_total_contratado, 0),
       COALESCE(valor_total_liberado, 0), 'Investimento' FROM f_equity
UNION ALL
SELECT 'ancine', id, cnpj_proponente_norm, {_norm_city('municipio')}, uf, COALESCE(valor_finep, 0),
       COALESCE(valor_pago, 0), COALESCE(instrumento, 'Ancine') FROM f_audiovisual
"""

_LK = ("cnpj_14, razao_social, nome_fantasia, situacao_cadastral, municipio_nome, uf, cnae_fiscal_principal, "
       "cnae_descricao, porte_empresa, natureza_juridica, natureza_juridica_descricao, capital_social, "
       "data_inicio_atividade, reference_month")

CTES["f_company"] = f"""
SELECT * EXCLUDE (tier, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY cnpj_14 ORDER BY tier) AS rn FROM (
    SELECT {_LK}, 'active' AS match_source, 0 AS tier FROM mv_active
    UNION ALL SELECT {_LK}, 'inactive', 1 FROM mv_inactive
  ) u WHERE cnpj_14 IN (SELECT cnpj_14 FROM f_records0 WHERE length(cnpj_14) = 14)
) t WHERE rn = 1
"""

CTES["f_records"] = f"""
SELECT r.source, r.source_id, r.cnpj_14,
       CASE WHEN COALESCE(r.municipio_nome, '') = '' THEN {_norm_city('c.municipio_nome')} ELSE r.municipio_nome END AS municipio_nome,
       CASE WHEN COALESCE(r.uf, '') = '' THEN c.uf ELSE r.uf END AS uf,
       r.total_aprovado_finep, r.total_liberado, r.instrumento,
       c.razao_social AS company_razao_social, c.nome_fantasia AS company_nome_fantasia,
       c.situacao_cadastral AS company_situacao_cadastral, c.municipio_nome AS company_municipio_nome,
       c.uf AS company_uf, c.cnae_fiscal_principal AS company_cnae_fiscal_principal,
       c.cnae_descricao AS company_cnae_descricao, c.porte_empresa AS company_porte_empresa,
       c.natureza_juridica AS company_natureza_juridica,
       c.natureza_juridica_descricao AS company_natureza_juridica_descricao,
       c.capital_social AS company_capital_social, c.data_inicio_atividade AS company_data_inicio_atividade,
       c.reference_month AS company_reference_month, c.match_source AS company_match_source
FROM f_records0 r LEFT JOIN f_company c ON r.cnpj_14 = c.cnpj_14
"""

_UFC = "CASE " + " ".join(f"WHEN uf = '{k}' THEN '{v}'" for k, v in UF_CODE.items()) + " END"
_MUNI_GEO = ("CASE WHEN n_nationkey % 3 = 0 THEN 'São ' || (upper(left(n_name, 1)) || lower(substr(n_name, 2))) "
             "WHEN n_nationkey % 3 = 1 THEN 'Guaíba ' || (upper(left(n_name, 1)) || lower(substr(n_name, 2))) "
             "ELSE upper(left(n_name, 1)) || lower(substr(n_name, 2)) END")

CTES["geo_muni"] = f"""
SELECT {_UFC} || LPAD(CAST(n_nationkey + 1 AS VARCHAR), 5, '0') AS codigo, uf, {_UFC} AS codigo_uf,
       nome, x0, y0, y0 + 2 AS latitude, x0 + 1 AS longitude
FROM (SELECT n_nationkey, n_name, {UF_CASE} AS uf, CAST(n_nationkey * 2 - 70 AS DOUBLE) AS x0,
             CAST(n_regionkey * 4 - 30 AS DOUBLE) AS y0, {_MUNI_GEO} AS nome FROM nation) t
"""


def city_key_sql(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(upper({c})), '\\s+', ' ', 'g'))"


CTES["f_geo_key"] = f"""
SELECT * FROM (SELECT uf AS g_uf, {city_key_sql('nome')} AS g_key, codigo AS geo_codigo, nome AS geo_nome,
       latitude AS geo_latitude, longitude AS geo_longitude,
       row_number() OVER (PARTITION BY uf, {city_key_sql('nome')} ORDER BY codigo) AS rn FROM geo_muni) t
WHERE rn = 1
"""

CTES["f_by_muni"] = f"""
SELECT COALESCE(min_by(geo_nome, geo_codigo), min(municipio_nome)) AS municipio_nome, uf,
       min(geo_codigo) AS municipality_ibge_code,
       min_by(geo_latitude, geo_codigo) AS latitude, min_by(geo_longitude, geo_codigo) AS longitude,
       COUNT(DISTINCT NULLIF(cnpj_14, '')) AS total_empresas, COUNT(*) AS total_projetos,
       CAST(SUM(total_aprovado_finep) AS DECIMAL(20,2)) AS total_aprovado_finep,
       CAST(SUM(total_liberado) AS DECIMAL(20,2)) AS total_liberado,
       list_sort(list_distinct(list(source))) AS fontes
FROM (SELECT r.*, g.* FROM f_records r LEFT JOIN f_geo_key g
      ON r.uf = g.g_uf AND {city_key_sql('r.municipio_nome')} = g.g_key
      WHERE COALESCE(r.municipio_nome, '') <> '') t
GROUP BY uf, upper(municipio_nome)
"""


def gini_sql(src: str, value: str, by: str | None) -> str:
    part = f"PARTITION BY {by}" if by else ""
    grp = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""
SELECT {sel}CAST(CASE WHEN COUNT(*) = 0 OR SUM(x) = 0 OR SUM(x) IS NULL THEN 0.0 ELSE
  ROUND(CAST(2 * SUM(i * x) - (COUNT(*) + 1) * SUM(x) AS DOUBLE) / CAST(COUNT(*) * SUM(x) AS DOUBLE), 6) END AS DOUBLE) AS gini
FROM (SELECT {sel}{value} AS x, row_number() OVER ({part} ORDER BY {value}) AS i
      FROM {src} WHERE {value} IS NOT NULL AND {value} >= 0) t {grp}
"""
