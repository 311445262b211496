"""DuckDB statement of the graph tables and network expansion."""

from __future__ import annotations

from tessera.plans.oracle_base import CTES, MATERIALIZE

CTES["g_prows"] = """
SELECT *, CASE WHEN nome_socio_razao_social IS NULL OR trim(nome_socio_razao_social) = '' THEN NULL
  WHEN cpf_cnpj_socio IS NOT NULL AND trim(cpf_cnpj_socio) <> '' THEN md5(cpf_cnpj_socio || '|' || nome_socio_razao_social)
  ELSE md5(nome_socio_razao_social || '|' || CAST(identificador_socio AS VARCHAR)) END AS pessoa_id
FROM socio WHERE identificador_socio IN (2, 3)
"""

CTES["g_person_nodes"] = """
SELECT pessoa_id, v.nome, v.cpf_cnpj_socio, v.identificador_socio, v.faixa_etaria FROM (
  SELECT pessoa_id, arg_max({'nome': nome_socio_razao_social, 'cpf_cnpj_socio': cpf_cnpj_socio,
                             'identificador_socio': identificador_socio, 'faixa_etaria': faixa_etaria},
                            {'m': reference_month, 'd': data_entrada_sociedade, 'c': cnpj_basico, 'q': qualificacao_socio}) AS v
  FROM g_prows WHERE pessoa_id IS NOT NULL GROUP BY pessoa_id) t
"""

CTES["g_person_edges"] = """
SELECT pessoa_id, cnpj_basico, reference_month, v.q AS qualificacao_socio, v.d AS data_entrada_sociedade,
       duplicate_count FROM (
  SELECT pessoa_id, cnpj_basico, reference_month,
         arg_max({'q': qualificacao_socio, 'd': data_entrada_sociedade},
                 {'d': data_entrada_sociedade, 'q': qualificacao_socio}) AS v, COUNT(*) AS duplicate_count
  FROM g_prows WHERE pessoa_id IS NOT NULL GROUP BY pessoa_id, cnpj_basico, reference_month) t
"""

CTES["g_company_edges"] = """
SELECT cnpj_socio_basico, cnpj_basico, reference_month, v.r AS razao_social_socio, v.q AS qualificacao_socio,
       v.d AS data_entrada_sociedade, duplicate_count FROM (
  SELECT trim(left(cpf_cnpj_socio, 8)) AS cnpj_socio_basico, cnpj_basico, reference_month,
         arg_max({'r': nome_socio_razao_social, 'q': qualificacao_socio, 'd': data_entrada_sociedade},
                 {'d': data_entrada_sociedade, 'q': qualificacao_socio}) AS v, COUNT(*) AS duplicate_count
  FROM socio WHERE identificador_socio = 1 AND length(cpf_cnpj_socio) >= 14 GROUP BY 1, 2, 3) t
"""

CTES["g_company_nodes"] = """
SELECT cnpj_basico, razao_social, porte_empresa, natureza_juridica, FALSE AS is_stub FROM empresa
UNION ALL
SELECT r.cnpj_basico, 'EMPRESA NAO ENCONTRADA NA BASE', NULL, NULL, TRUE FROM (
  SELECT cnpj_socio_basico AS cnpj_basico FROM g_company_edges UNION SELECT cnpj_basico FROM g_company_edges
  UNION SELECT cnpj_basico FROM g_person_edges) r
WHERE r.cnpj_basico NOT IN (SELECT cnpj_basico FROM empresa)
"""

CTES["g_edges"] = """
SELECT 'SOCIO_DE' AS type, 'P:' || pessoa_id AS src, 'C:' || cnpj_basico AS dst, reference_month FROM g_person_edges
UNION ALL
SELECT 'SOCIO_DE', 'C:' || cnpj_socio_basico, 'C:' || cnpj_basico, reference_month FROM g_company_edges
"""

CTES["g_adj"] = "SELECT DISTINCT src AS node, dst AS nbr FROM g_edges UNION SELECT dst, src FROM g_edges"

CTES["g_seed_companies"] = """
SELECT 'C:' || cnpj_basico AS seed FROM mv_active ORDER BY capital_social DESC, cnpj_basico LIMIT 5
"""

CTES["g_all_companies"] = "SELECT 'C:' || cnpj_basico AS seed FROM g_company_nodes"

CTES["g_seed_persons"] = """
SELECT 'P:' || pessoa_id AS seed FROM g_person_nodes WHERE nome ILIKE '%SOCIO 11%'
"""

MATERIALIZE.update({"g_prows", "g_person_edges", "g_company_edges", "g_edges", "g_adj", "g_company_nodes",
                    "g_person_nodes"})


def reach_sql(seeds: str, hops: int) -> str:
    """(seed, node) within ``hops`` hops, unrolled."""
    sql = f"SELECT seed, seed AS node FROM {seeds}"
    for _ in range(hops):
        sql = f"SELECT seed, node FROM ({sql}) UNION SELECT r.seed, a.nbr FROM ({sql}) r JOIN g_adj a ON a.node = r.node"
    return sql


def network_sql(seeds: str, hops: int, limit: int | None = None) -> str:
    near = reach_sql(seeds, hops - 1)
    if limit is None:
        return f"""
WITH near AS MATERIALIZED ({near})
SELECT DISTINCT n.seed, e.type, e.src, e.dst, e.reference_month, false AS truncated
FROM near n JOIN g_edges e ON n.node = e.src OR n.node = e.dst
"""
    return f"""
WITH near AS MATERIALIZED ({near}),
inc AS (SELECT n.seed, e.type, e.src, e.dst, e.reference_month FROM near n JOIN g_edges e ON e.src = n.node
        UNION
        SELECT n.seed, e.type, e.src, e.dst, e.reference_month FROM near n JOIN g_edges e ON e.dst = n.node),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY type, src, dst, reference_month) AS rk,
                  COUNT(*) OVER (PARTITION BY seed) AS n FROM inc)
SELECT seed, type, src, dst, reference_month, n > {limit} AS truncated FROM ranked WHERE rk <= {limit}
"""
