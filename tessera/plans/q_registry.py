"""Registry queries: cleaning, views, profile joins, search, column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import registry as R
from tessera.plans.catalog import register
from tessera.plans.oracle_base import MONTH, q
from tessera.sources import proxies as P

# ---------------------------------------------------------------- flagship

register("active_by_state", """
SELECT uf, COUNT(*) AS companies, SUM(capital_social) AS capital
FROM mv_active GROUP BY uf
""")(lambda I: I.stored_view("active").groupBy("uf").agg(
    F.count(F.lit(1)).alias("companies"), F.sum("capital_social").alias("capital")))

# ---------------------------------------------------------------- PRJ-1..5

register("clean_companies", "SELECT * FROM empresa")(lambda I: I.companies)
register("clean_establishments", "SELECT * FROM estab")(lambda I: I.establishments)
register("clean_partners", "SELECT * FROM socio")(lambda I: I.partners)
register("clean_tax_regime", "SELECT * FROM simples")(lambda I: I.tax)

CLEAN_LOOKUP_SQL = """
SELECT 'cnaes' AS kind, cnae_fiscal AS codigo, descricao AS label FROM lk_cnae
UNION ALL SELECT 'motivos', codigo, descricao FROM lk_motivo
UNION ALL SELECT 'municipios', codigo, nome FROM lk_municipio
UNION ALL SELECT 'naturezas', CAST(codigo AS VARCHAR), descricao FROM lk_natureza
UNION ALL SELECT 'paises', codigo, nome FROM lk_pais
UNION ALL SELECT 'qualificacoes', codigo, descricao FROM lk_qualificacao
"""


def _clean_lookup(I):
    out = None
    for kind in P.LOOKUP_KINDS:
        df = I.lookup(kind)
        k, lab = df.columns
        part = df.select(F.lit(kind).alias("kind"), F.col(k).cast("string").alias("codigo"),
                         F.col(lab).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


register("clean_lookup", CLEAN_LOOKUP_SQL)(_clean_lookup)

# ---------------------------------------------------------------- JOIN-1..5

register("search_view_active", "SELECT * FROM mv_active")(lambda I: I.active_view)
register("search_view_inactive", "SELECT * FROM mv_inactive")(lambda I: I.inactive_view)


def _refreshed(I):
    I.stored_view("active")
    I.refresh_views()
    return I.stored_view("active").unionByName(I.stored_view("inactive"))


register("build_search_views", "SELECT * FROM mv_active UNION ALL BY NAME SELECT * FROM mv_inactive")(_refreshed)

register("establishment_full", """
WITH owner AS (SELECT cnpj_basico AS root, razao_social, capital_social, porte_empresa FROM empresa)
SELECT * EXCLUDE (root), concat(cnpj_basico, cnpj_ordem, cnpj_dv) AS cnpj_completo FROM owner RIGHT JOIN estab ON root = cnpj_basico
""")(lambda I: R.establishment_full(I.establishments, I.companies))

register("establishment_stats", """
SELECT cnpj_basico, COUNT(*) AS total_estabelecimentos,
       COUNT(*) FILTER (WHERE situacao_cadastral = '02') AS estabelecimentos_ativos
FROM estab GROUP BY cnpj_basico
""")(lambda I: R.establishment_stats(I.establishments))

register("company_header", """
SELECT e.cnpj_basico, e.razao_social, e.natureza_juridica, n.descricao AS natureza_juridica_descricao,
       e.qualificacao_responsavel, qq.descricao AS qualificacao_responsavel_descricao,
       e.capital_social, e.porte_empresa, e.ente_federativo_responsavel,
       COALESCE(s.t, 0) AS total_estabelecimentos, COALESCE(s.a, 0) AS estabelecimentos_ativos
FROM empresa e
LEFT JOIN lk_natureza n ON n.codigo = e.natureza_juridica
LEFT JOIN lk_qualificacao qq ON qq.codigo = e.qualificacao_responsavel
LEFT JOIN (SELECT cnpj_basico, COUNT(*) AS t, COUNT(*) FILTER (WHERE situacao_cadastral = '02') AS a
           FROM estab GROUP BY cnpj_basico) s ON s.cnpj_basico = e.cnpj_basico
""")(lambda I: R.company_header(I.companies, I.establishments, I.naturezas, I.qualificacoes))

register("establishment_detail", """
SELECT e.cnpj_basico, e.cnpj_ordem, e.cnpj_dv,
       CASE WHEN length(e.cnpj_basico || e.cnpj_ordem || e.cnpj_dv) = 14
            AND regexp_full_match(e.cnpj_basico || e.cnpj_ordem || e.cnpj_dv, '[0-9]{14}') THEN
         substr(e.cnpj_basico, 1, 2) || '.' || substr(e.cnpj_basico, 3, 3) || '.' || substr(e.cnpj_basico, 6, 3)
         || '/' || e.cnpj_ordem || '-' || e.cnpj_dv END AS cnpj_formatado,
       e.identificador_matriz_filial, e.nome_fantasia, e.situacao_cadastral,
       e.motivo_situacao_cadastral, mo.descricao AS motivo_descricao, e.codigo_pais, p.nome AS pais_nome,
       e.cnae_fiscal_principal, c.descricao AS cnae_descricao, e.codigo_municipio, m.nome AS municipio_nome,
       e.uf,
       CASE WHEN e.ddd_1 IS NOT NULL AND e.ddd_1 <> '' AND e.telefone_1 IS NOT NULL THEN
         '(' || e.ddd_1 || ') ' || CASE
           WHEN length(CAST(e.telefone_1 AS VARCHAR)) = 9 THEN substr(CAST(e.telefone_1 AS VARCHAR), 1, 5) || '-' || substr(CAST(e.telefone_1 AS VARCHAR), 6, 4)
           WHEN length(CAST(e.telefone_1 AS VARCHAR)) = 8 THEN substr(CAST(e.telefone_1 AS VARCHAR), 1, 4) || '-' || substr(CAST(e.telefone_1 AS VARCHAR), 5, 4)
           ELSE CAST(e.telefone_1 AS VARCHAR) END END AS telefone_1_formatado
FROM estab e
LEFT JOIN lk_cnae c ON c.cnae_fiscal = e.cnae_fiscal_principal
LEFT JOIN lk_motivo mo ON mo.codigo = e.motivo_situacao_cadastral
LEFT JOIN lk_pais p ON p.codigo = e.codigo_pais
LEFT JOIN lk_municipio m ON m.codigo = e.codigo_municipio
""")(lambda I: R.establishment_detail(I.establishments, I.cnaes, I.motivos, I.paises, I.municipios))

register("company_profile", """
SELECT e.cnpj_basico, e.razao_social, e.capital_social, e.porte_empresa,
       coalesce(s.chunk, 0) AS chunk, s.n AS n_estabelecimentos, s.first_ordem
FROM empresa e LEFT JOIN (SELECT cnpj_basico, cnpj_ordem[1]::INT AS chunk, COUNT(*) AS n, MIN(cnpj_ordem) AS first_ordem
                          FROM estab GROUP BY ALL) s ON s.cnpj_basico = e.cnpj_basico
""")(lambda I: R.company_profile(I.companies, I.establishments).select(
    "cnpj_basico", "chunk", "razao_social", "capital_social", "porte_empresa",
    F.when(F.col("estabelecimentos").isNotNull(), F.size("estabelecimentos")).cast("bigint")
    .alias("n_estabelecimentos"),
    F.col("estabelecimentos")[0]["cnpj_ordem"].alias("first_ordem")))

register("with_full_id", """
SELECT cnpj_basico, cnpj_ordem, cnpj_dv, cnpj_basico || cnpj_ordem || cnpj_dv AS cnpj_14,
       CASE WHEN regexp_full_match(cnpj_basico || cnpj_ordem || cnpj_dv, '[0-9]{14}') THEN
         substr(cnpj_basico, 1, 2) || '.' || substr(cnpj_basico, 3, 3) || '.' || substr(cnpj_basico, 6, 3)
         || '/' || cnpj_ordem || '-' || cnpj_dv END AS cnpj_formatado
FROM estab
""")(lambda I: R.with_full_id(I.establishments.select("cnpj_basico", "cnpj_ordem", "cnpj_dv")))

register("decode_labels", """
SELECT cnpj_basico, cnpj_ordem, porte_empresa, identificador_matriz_filial, situacao_cadastral,
  CASE porte_empresa WHEN '00' THEN 'Não informado' WHEN '01' THEN 'Micro empresa'
       WHEN '03' THEN 'Empresa de pequeno porte' WHEN '05' THEN 'Demais' END AS porte_empresa_descricao,
  CASE identificador_matriz_filial WHEN 1 THEN 'Matriz' WHEN 2 THEN 'Filial' END AS matriz_filial_descricao,
  CASE situacao_cadastral WHEN '01' THEN 'Nula' WHEN '02' THEN 'Ativa' WHEN '03' THEN 'Suspensa'
       WHEN '04' THEN 'Inapta' WHEN '08' THEN 'Baixada' END AS situacao_cadastral_descricao
FROM estab JOIN empresa USING (cnpj_basico)
""")(lambda I: R.decode_labels(I.establishments.join(I.companies.select("cnpj_basico", "porte_empresa"),
                                                     "cnpj_basico").select(
    "cnpj_basico", "cnpj_ordem", "porte_empresa", "identificador_matriz_filial", "situacao_cadastral")))

# ---------------------------------------------------------------- search / people

register("search_companies", """
SELECT * FROM mv_active
WHERE (razao_social ILIKE '%CUSTOMER#0000001%' OR COALESCE(nome_fantasia, '') ILIKE '%CUSTOMER#0000001%')
  AND uf = 'SP'
""")(lambda I: R.search_companies(I.stored_view("active"), q="Customer#0000001", uf="sp"))

register("search_companies_id", """
SELECT * FROM mv_active WHERE cnpj_basico LIKE '0000001%'
""")(lambda I: R.search_companies(I.stored_view("active"), q="0000001"))

register("person_company_counts", """
WITH held AS (SELECT DISTINCT nome_socio_razao_social AS nome, cpf_cnpj_socio, faixa_etaria, cnpj_basico
              FROM socio WHERE identificador_socio BETWEEN 2 AND 3)
SELECT * EXCLUDE (cnpj_basico), count(cnpj_basico) AS total_empresas FROM held GROUP BY ALL
""")(lambda I: R.person_company_counts(I.partners))

register("search_people", """
WITH held AS (SELECT DISTINCT nome_socio_razao_social AS nome, cpf_cnpj_socio, faixa_etaria, cnpj_basico
              FROM socio WHERE identificador_socio BETWEEN 2 AND 3 AND contains(upper(nome_socio_razao_social), 'SOCIO 1'))
SELECT * EXCLUDE (cnpj_basico), count(cnpj_basico) AS total_empresas FROM held GROUP BY ALL
""")(lambda I: R.person_company_counts(I.partners, q="sócio 1"))

register("person_detail", """
SELECT nome, cpf_cnpj_socio, faixa_etaria, cnpj_basico, razao_social, qualificacao_socio,
       qualificacao_socio_descricao, data_entrada_sociedade, situacao_cadastral, uf, municipio_nome,
       reference_month
FROM (
  SELECT s.nome_socio_razao_social AS nome, s.cpf_cnpj_socio, s.faixa_etaria, e.cnpj_basico, e.razao_social,
         s.qualificacao_socio, qq.descricao AS qualificacao_socio_descricao, s.data_entrada_sociedade,
         hq.situacao_cadastral, hq.uf, m.nome AS municipio_nome, s.reference_month,
         row_number() OVER (PARTITION BY s.nome_socio_razao_social, s.cpf_cnpj_socio, e.cnpj_basico
                            ORDER BY s.reference_month DESC, s.data_entrada_sociedade ASC NULLS LAST,
                                     s.qualificacao_socio ASC NULLS LAST, hq.uf ASC NULLS LAST,
                                     hq.situacao_cadastral ASC NULLS LAST) AS rn
  FROM socio s
  JOIN empresa e ON e.cnpj_basico = s.cnpj_basico
  LEFT JOIN lk_qualificacao qq ON qq.codigo = s.qualificacao_socio
  LEFT JOIN estab hq ON hq.cnpj_basico = e.cnpj_basico AND hq.identificador_matriz_filial = 1
  LEFT JOIN lk_municipio m ON m.codigo = hq.codigo_municipio
  WHERE s.identificador_socio IN (2, 3)
) t WHERE rn = 1
""")(lambda I: R.person_detail(I.partners, I.companies, I.establishments, I.qualificacoes, I.municipios))

register("stub_companies", f"""
SELECT DISTINCT c.cnpj_basico, 'EMPRESA NAO ENCONTRADA NA BASE' AS razao_social, '{MONTH}' AS reference_month
FROM (SELECT cnpj_basico FROM estab UNION SELECT cnpj_basico FROM socio) c
WHERE c.cnpj_basico NOT IN (SELECT cnpj_basico FROM empresa)
""")(lambda I: R.stub_companies(
    I.establishments.select("cnpj_basico").unionByName(I.partners.select("cnpj_basico")),
    I.companies, I.month))

_HIT = ", ".join(R.SEARCH_COLUMNS)


def _hits_sql(where: str) -> str:
    """Hits of both views; an id in both is taken from the active one."""
    return f"""
WITH hits AS (SELECT {_HIT}, 'active' AS match_source FROM mv_active WHERE {where}
              UNION ALL BY NAME SELECT {_HIT}, 'inactive' AS match_source FROM mv_inactive WHERE {where})
SELECT DISTINCT ON (cnpj_14) {_HIT}, match_source FROM hits ORDER BY cnpj_14, match_source LIMIT 20
"""


_NAMED = "contains(upper(razao_social), '{0}') OR contains(upper(coalesce(nome_fantasia, '')), '{0}')"
for _key, _q, _where in [
        ("unified_search", "customer#000000", "starts_with(cnpj_14, '000000') OR starts_with(cnpj_basico, '000000') OR " + _NAMED.format("CUSTOMER#000000")),
        ("unified_search_accents", "lója 1-úrgent", "starts_with(cnpj_14, '1') OR starts_with(cnpj_basico, '1') OR " + _NAMED.format("LOJA 1-URGENT")),
        ("unified_search_digits14", "00000026000999", "cnpj_14 = '00000026000999' OR cnpj_basico = '00000026' OR " + _NAMED.format("00000026000999")),
        ("unified_search_digits9", "000000260", "starts_with(cnpj_14, '000000260') OR cnpj_basico = '00000026' OR " + _NAMED.format("000000260")),
        ("unified_search_digits8", "00000026", "starts_with(cnpj_14, '00000026') OR cnpj_basico = '00000026' OR " + _NAMED.format("00000026")),
        ("unified_search_empty", " ", "true")]:
    register(_key, _hits_sql(_where))((lambda q: lambda I: R.unified_search(I.stored_view("active"), I.stored_view("inactive"), q, 20))(_q))

# ---------------------------------------------------------------- column functions


def _fn(key: str, source: str, raw_col: str, expr, sql_expr: str):
    """Register a column-function check: raw value and result, all rows."""
    src = {"company": P.raw_company, "estab": P.raw_estab, "partner": P.raw_partner,
           "tax": P.raw_tax}[source]
    table = {"company": "raw_company", "estab": "raw_estab", "partner": "raw_partner",
             "tax": "raw_tax"}[source]
    register(key, f"SELECT {raw_col} AS raw, {sql_expr} AS v FROM {table}")(
        lambda I: src(I.spark, I.sf_dir).select(F.col(raw_col).alias("raw"), expr().alias("v")))


_fn("fn_clean_string", "company", "c1", lambda: C.clean_string("c1"),
    f"CASE WHEN LENGTH({q('c1')}) > 0 THEN {q('c1')} END")
_fn("fn_clean_string_upper", "company", "c1", lambda: C.clean_string_upper("c1"),
    f"UPPER(CASE WHEN LENGTH({q('c1')}) > 0 THEN {q('c1')} END)")
_fn("fn_clean_string_default", "estab", "c4", lambda: C.clean_string_default("c4", "SEM NOME"),
    f"COALESCE(CASE WHEN LENGTH({q('c4')}) > 0 THEN {q('c4')} END, 'SEM NOME')")
_fn("fn_clean_size", "company", "c5", lambda: C.clean_size("c5"),
    f"CASE WHEN LPAD({q('c5')}, 2, '0') IN ('00','01','03','05') THEN LPAD({q('c5')}, 2, '0') ELSE '00' END")
_fn("fn_clean_status", "estab", "c5", lambda: C.clean_status("c5"), f"NULLIF(LPAD({q('c5')}, 2, '0'), '00')")
_fn("fn_clean_money", "company", "c4", lambda: C.clean_money("c4"),
    f"COALESCE(TRY_CAST(REPLACE(REPLACE({q('c4')}, '.', ''), ',', '.') AS DECIMAL(15,2)), 0.0)")
_fn("fn_clean_decimal", "company", "c4", lambda: C.clean_decimal("c4", 0.0),
    f"COALESCE(TRY_CAST(REPLACE({q('c4')}, ',', '.') AS DECIMAL(15,2)), 0.0)")
_fn("fn_clean_int", "estab", "c22", lambda: C.try_int("c22"), f"TRY_CAST({q('c22')} AS INTEGER)")
_fn("fn_clean_int_default", "company", "c2", lambda: C.clean_int_default("c2", -1),
    f"COALESCE(TRY_CAST({q('c2')} AS INTEGER), -1)")
_fn("fn_clean_date", "estab", "c6", lambda: C.clean_date("c6"),
    "CASE WHEN c6 = '0' OR TRIM(c6) = '' THEN NULL WHEN LENGTH(TRIM(c6)) = 8 THEN "
    "TRY_CAST(TRY_STRPTIME(TRIM(c6), '%Y%m%d') AS DATE) END")
_fn("fn_clean_date_iso", "estab", "c6", lambda: C.clean_date_iso("c6"),
    "strftime(CASE WHEN c6 = '0' OR TRIM(c6) = '' THEN NULL WHEN LENGTH(TRIM(c6)) = 8 THEN "
    "TRY_CAST(TRY_STRPTIME(TRIM(c6), '%Y%m%d') AS DATE) END, '%Y-%m-%d')")
_fn("fn_id14", "partner", "c3", lambda: C.id14("c3"),
    "CASE WHEN LENGTH(regexp_replace(c3, '[^0-9]', '', 'g')) = 14 THEN regexp_replace(c3, '[^0-9]', '', 'g') END")
_fn("fn_id_root", "partner", "c3", lambda: C.id_root("c3"),
    "CASE WHEN LENGTH(regexp_replace(c3, '[^0-9]', '', 'g')) > 0 THEN "
    "LPAD(regexp_replace(c3, '[^0-9]', '', 'g'), 8, '0') END")
_fn("fn_digits", "estab", "c18", lambda: C.digits("c18", 8),
    "CASE WHEN LENGTH(regexp_replace(c18, '[^0-9]', '', 'g')) BETWEEN 1 AND 8 THEN "
    "LPAD(regexp_replace(c18, '[^0-9]', '', 'g'), 8, '0') END")
_fn("fn_to_bool", "tax", "c4", lambda: C.to_bool("c4"),
    "CASE WHEN lower(c4) IN ('1','true','t','yes','y','sim','s') THEN TRUE "
    "WHEN lower(c4) IN ('0','false','f','no','n','nao','não') THEN FALSE END")

_FULL = "(LPAD(TRIM(REPLACE(c0, '\"', '')), 8, '0') || LPAD(c1, 4, '0') || LPAD(c2, 2, '0'))"


def _full_id_spark():
    return F.concat(C.padded("c0", 8), C.padded("c1", 4), C.padded("c2", 2))


register("fn_format_id", f"""
SELECT {_FULL} AS raw,
  substr({_FULL}, 1, 2) || '.' || substr({_FULL}, 3, 3) || '.' || substr({_FULL}, 6, 3) || '/' ||
  substr({_FULL}, 9, 4) || '-' || substr({_FULL}, 13, 2) AS v
FROM raw_estab
""")(lambda I: P.raw_estab(I.spark, I.sf_dir).select(
    _full_id_spark().alias("raw"), C.format_id(_full_id_spark()).alias("v")))


def _valid_sql(x: str) -> str:
    from tessera.plans.oracle_base import dv_sql
    return (f"(LENGTH({x}) = 14 AND NOT regexp_full_match({x}, '(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)') "
            f"AND substr({x}, 13, 2) = {dv_sql(f'substr({x}, 1, 12)')})")


register("fn_valid_id", f"""
SELECT {_FULL} AS raw, COALESCE({_valid_sql(_FULL)}, FALSE) AS v FROM raw_estab
""")(lambda I: P.raw_estab(I.spark, I.sf_dir).select(
    _full_id_spark().alias("raw"), C.valid_id(_full_id_spark()).alias("v")))

register("fn_mask_person_id", """
SELECT c_custkey, '***' || substr(LPAD(CAST(c_custkey * 7777 AS VARCHAR), 11, '0'), 4, 6) || '**' AS v
FROM customer
""")(lambda I: I.table("customer").select(
    "c_custkey", C.mask_person_id(F.lpad((F.col("c_custkey") * 7777).cast("string"), 11, "0")).alias("v")))

register("fn_format_phone", """
SELECT c21, c22, CASE WHEN TRY_CAST(c22 AS INTEGER) IS NOT NULL AND c21 <> '' THEN
  '(' || c21 || ') ' || CASE WHEN length(c22) = 9 THEN substr(c22, 1, 5) || '-' || substr(c22, 6, 4)
                             WHEN length(c22) = 8 THEN substr(c22, 1, 4) || '-' || substr(c22, 5, 4)
                             ELSE c22 END END AS v
FROM raw_estab
""")(lambda I: P.raw_estab(I.spark, I.sf_dir).select(
    "c21", "c22", C.format_phone("c21", F.col("c22").try_cast("int")).alias("v")))

register("fn_name_key", """
SELECT c1 AS raw, trim(regexp_replace(trim(regexp_replace(strip_accents(upper(c1)), '[^A-Z0-9]+', ' ', 'g')),
       '\\s+', ' ', 'g')) AS v FROM raw_lk_municipios
UNION ALL
SELECT c1, trim(regexp_replace(trim(regexp_replace(strip_accents(upper(c1)), '[^A-Z0-9]+', ' ', 'g')),
       '\\s+', ' ', 'g')) FROM raw_lk_cnaes
""")(lambda I: P.raw_lookup(I.spark, I.sf_dir, "municipios").select(
    F.col("c1").alias("raw"), C.name_key("c1").alias("v")).unionByName(
    P.raw_lookup(I.spark, I.sf_dir, "cnaes").select(F.col("c1").alias("raw"), C.name_key("c1").alias("v"))))

register("fn_city_key", """
SELECT c1 AS raw, trim(regexp_replace(strip_accents(upper(c1)), '\\s+', ' ', 'g')) AS v FROM raw_lk_municipios
""")(lambda I: P.raw_lookup(I.spark, I.sf_dir, "municipios").select(
    F.col("c1").alias("raw"), C.city_key("c1").alias("v")))

register("fn_norm_text", """
SELECT c1 AS raw, trim(regexp_replace(lower(strip_accents(c1)), '\\s+', ' ', 'g')) AS v FROM raw_lk_cnaes
""")(lambda I: P.raw_lookup(I.spark, I.sf_dir, "cnaes").select(
    F.col("c1").alias("raw"), C.norm_text("c1").alias("v")))

register("fn_person_key", """
SELECT nome_socio_razao_social, cpf_cnpj_socio, identificador_socio,
  CASE WHEN nome_socio_razao_social IS NULL OR trim(nome_socio_razao_social) = '' THEN NULL
       WHEN cpf_cnpj_socio IS NOT NULL AND trim(cpf_cnpj_socio) <> '' THEN md5(cpf_cnpj_socio || '|' || nome_socio_razao_social)
       ELSE md5(nome_socio_razao_social || '|' || CAST(identificador_socio AS VARCHAR)) END AS v
FROM socio
""")(lambda I: I.partners.select(
    "nome_socio_razao_social", "cpf_cnpj_socio", "identificador_socio",
    C.person_key("cpf_cnpj_socio", "nome_socio_razao_social", "identificador_socio").alias("v")))

register("fn_depositor_key", """
SELECT nome_socio_razao_social, cpf_cnpj_socio,
       sha256(upper(trim(nome_socio_razao_social)) || '|' || COALESCE(cpf_cnpj_socio, '')) AS v
FROM socio WHERE nome_socio_razao_social IS NOT NULL
""")(lambda I: I.partners.filter(F.col("nome_socio_razao_social").isNotNull()).select(
    "nome_socio_razao_social", "cpf_cnpj_socio",
    C.depositor_key("nome_socio_razao_social", "cpf_cnpj_socio").alias("v")))

register("fn_norm_city", """
SELECT c1 AS raw, trim(regexp_replace(c1, '[\\s\\p{Zs}]+', ' ', 'g')) AS v FROM raw_company
""")(lambda I: P.raw_company(I.spark, I.sf_dir).select(F.col("c1").alias("raw"), C.norm_city("c1").alias("v")))
