"""DuckDB statement of the proxy inputs and cleaned tables.

Each oracle query is ``WITH <prelude> SELECT ...`` over the driver's
pre-registered views. The prelude restates the proxy inputs and the
cleaning rules in plain SQL, independently of the Spark code, so a query
that matches proves the Spark plan, not a shared helper.
"""

from __future__ import annotations

from tessera.sources.proxies import REGION_UF


def q(c: str) -> str:
    """The text of a field: no double quotes, no blanks (of any Unicode kind)
    at either end."""
    return f"regexp_replace(translate({c}::VARCHAR, chr(34), ''), '^\\p{{Zs}}+|\\p{{Zs}}+$', '', 'g')"


def nb(c: str) -> str:
    """Blank is unknown."""
    return f"nullif({q(c)}, '')"


def nbu(c: str) -> str:
    return f"upper({nb(c)})"


def pad(c: str, w: int) -> str:
    """A code of ``w`` characters: zeros in front, the first ``w`` of a longer one."""
    return f"left(repeat('0', greatest(0, {w} - length({q(c)}))::BIGINT) || {q(c)}, {w})"


def padn(c: str, w: int) -> str:
    """The same, where all zeros stand for no code."""
    return f"CASE WHEN ltrim({pad(c, w)}, '0') <> '' OR length({pad(c, w)}) <> {w} THEN {pad(c, w)} END"


def tint(c: str) -> str:
    """Whole numbers only."""
    return f"CASE WHEN regexp_full_match({q(c)}, '[+-]?[0-9]+') THEN TRY_CAST({q(c)} AS INTEGER) END"


def dt(c: str) -> str:
    """Eight digits that name a day of the calendar."""
    t = f"trim({c}::VARCHAR)"
    return f"CASE WHEN regexp_full_match({t}, '[0-9]{{8}}') THEN TRY_CAST(concat_ws('-', {t}[1:4], {t}[5:6], {t}[7:8]) AS DATE) END"


dt2 = dt


def dv_sql(base: str) -> str:
    """Two mod-11 check digits of a 12-char digit string, as SQL (the second
    digit reuses the first: sum over the 12 base digits + 2 * d1)."""
    w1 = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    w2 = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3]
    dig = [f"CAST(SUBSTR({base}, {i + 1}, 1) AS INTEGER)" for i in range(12)]
    s1 = " + ".join(f"{w} * {d}" for w, d in zip(w1, dig))
    d1 = f"(CASE WHEN ({s1}) % 11 < 2 THEN 0 ELSE 11 - ({s1}) % 11 END)"
    s2 = " + ".join(f"{w} * {d}" for w, d in zip(w2, dig)) + f" + 2 * {d1}"
    d2 = f"(CASE WHEN ({s2}) % 11 < 2 THEN 0 ELSE 11 - ({s2}) % 11 END)"
    return f"(CAST({d1} AS VARCHAR) || CAST({d2} AS VARCHAR))"


UF_CASE = "CASE " + " ".join(f"WHEN n_regionkey = {k} THEN '{v}'" for k, v in REGION_UF.items()) + " END"

MONTH = "2024-01"

CTES: dict[str, str] = {}

CTES["raw_company"] = """
SELECT
  ' "' || CASE WHEN c_custkey % 17 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE LPAD(CAST(c_custkey AS VARCHAR), 8, '0') END || '" ' AS c0,
  ' ' || c_name || CASE WHEN c_custkey % 7 = 0 THEN chr(160) ELSE '' END || ' ' AS c1,
  CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS c2,
  CAST((c_custkey % 4) * 5 AS VARCHAR) AS c3,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE translate(format('{:,.2f}', c_acctbal), ',.', '.,') END AS c4,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '1' WHEN 'MACHINERY' THEN '3' WHEN 'FURNITURE' THEN '05'
       WHEN 'BUILDING' THEN '' ELSE '99' END AS c5,
  CASE WHEN c_custkey % 3 = 0 THEN 'UNIAO' ELSE '' END AS c6
FROM customer
"""

_BASE = "(LPAD(CAST(o_custkey AS VARCHAR), 8, '0') || LPAD(CAST(rn AS VARCHAR), 4, '0'))"
_DV = dv_sql(_BASE)

CTES["raw_estab"] = f"""
SELECT
  '"' || LPAD(CAST(o_custkey AS VARCHAR), 8, '0') || '"' AS c0,
  CAST(rn AS VARCHAR) AS c1,
  CASE WHEN o_orderkey % 19 = 0 THEN LPAD(CAST((CAST({_DV} AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0') ELSE {_DV} END AS c2,
  CASE WHEN rn = 1 THEN '1' ELSE '2' END AS c3,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' loja ' || lower(o_orderpriority) END AS c4,
  CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderstatus = 'O' THEN '2' WHEN o_orderstatus = 'P' THEN '3' ELSE '8' END AS c5,
  CASE WHEN o_orderkey % 29 = 0 THEN '0' WHEN o_orderkey % 31 = 0 THEN '20190229' ELSE strftime(o_orderdate, '%Y%m%d') END AS c6,
  CAST(o_orderkey % 3 AS VARCHAR) AS c7,
  '' AS c8,
  CASE WHEN o_orderkey % 10 = 0 THEN CAST(c_nationkey + 10 AS VARCHAR) ELSE '' END AS c9,
  strftime(o_orderdate, '%Y%m%d') AS c10,
  CAST(o_custkey % 150 AS VARCHAR) AS c11,
  '' AS c12,
  'rua' AS c13,
  'rua ' || CAST(o_orderkey % 97 AS VARCHAR) AS c14,
  CAST(o_orderkey % 1000 AS VARCHAR) AS c15,
  '' AS c16,
  'bairro ' || CAST(o_custkey % 7 AS VARCHAR) AS c17,
  CAST(o_orderkey * 7 AS VARCHAR) AS c18,
  {UF_CASE} AS c19,
  CAST(c_nationkey + 1 AS VARCHAR) AS c20,
  CAST(11 + o_custkey % 80 AS VARCHAR) AS c21,
  CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE CAST(30000000 + o_orderkey AS VARCHAR) END AS c22,
  '' AS c23, '' AS c24, '' AS c25, '' AS c26,
  'Contato' || CAST(o_orderkey AS VARCHAR) || '@Example.COM' AS c27,
  '' AS c28,
  '0' AS c29
FROM (
  SELECT o.*, c.c_nationkey, n.n_regionkey,
         row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS rn
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
) t
"""

CTES["raw_partner"] = """
SELECT
  LPAD(CAST(o_custkey AS VARCHAR), 8, '0') AS c0,
  CAST(kind AS VARCHAR) AS c1,
  CASE kind WHEN 1 THEN 'EMPRESA ' || CAST(l_partkey AS VARCHAR)
            WHEN 2 THEN 'Socio ' || CAST(l_suppkey AS VARCHAR)
            ELSE 'FOREIGN ' || CAST(l_suppkey AS VARCHAR) END AS c2,
  CASE kind WHEN 1 THEN LPAD(CAST(l_partkey AS VARCHAR), 8, '0') || '000100'
            WHEN 2 THEN '***' || LPAD(CAST((l_suppkey * 7919) % 1000000 AS VARCHAR), 6, '0') || '**'
            ELSE '' END AS c3,
  CAST(l_linenumber * 5 AS VARCHAR) AS c4,
  strftime(l_shipdate, '%Y%m%d') AS c5,
  CASE WHEN kind = 3 THEN '105' ELSE '' END AS c6,
  '' AS c7, '' AS c8, '0' AS c9,
  CASE WHEN kind = 2 THEN CAST(l_suppkey % 9 + 1 AS VARCHAR) ELSE '0' END AS c10
FROM (
  SELECT l.*, o.o_custkey,
         CASE WHEN l.l_suppkey % 10 = 0 THEN 1 WHEN l.l_suppkey % 10 = 5 THEN 3 ELSE 2 END AS kind
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
) t
"""

CTES["raw_tax"] = """
SELECT
  LPAD(CAST(c_custkey AS VARCHAR), 8, '0') AS c0,
  CASE WHEN c_custkey % 2 = 0 THEN 'S' ELSE 'N' END AS c1,
  strftime(DATE '2000-01-01' + CAST(c_custkey AS INTEGER), '%Y%m%d') AS c2,
  CASE WHEN c_custkey % 2 = 0 THEN '00000000' ELSE strftime(DATE '2010-01-01' + CAST(c_custkey AS INTEGER), '%Y%m%d') END AS c3,
  CASE WHEN c_custkey % 3 = 0 THEN 's' ELSE 'n' END AS c4,
  CASE WHEN c_custkey % 3 = 0 THEN strftime(DATE '2000-01-01' + CAST(c_custkey AS INTEGER), '%Y%m%d') ELSE '0' END AS c5,
  '' AS c6
FROM customer
"""

_MUNI = ("CASE WHEN n_nationkey % 3 = 0 THEN 'São ' || n_name WHEN n_nationkey % 3 = 1 "
         "THEN 'Guaíba ' || n_name ELSE n_name END")

CTES["raw_lk_cnaes"] = ("SELECT LPAD(CAST(p_partkey AS VARCHAR), 7, '0') AS c0, "
                        "'Atividade ' || p_name || ' ção' AS c1 FROM part")
CTES["raw_lk_motivos"] = "SELECT CAST(r_regionkey AS VARCHAR) AS c0, 'Motivo ' || r_name AS c1 FROM region"
CTES["raw_lk_municipios"] = f"SELECT CAST(n_nationkey + 1 AS VARCHAR) AS c0, UPPER({_MUNI}) AS c1 FROM nation"
CTES["raw_lk_naturezas"] = "SELECT CAST(n_nationkey AS VARCHAR) AS c0, 'Natureza ' || n_name AS c1 FROM nation"
CTES["raw_lk_paises"] = "SELECT CAST(n_nationkey + 10 AS VARCHAR) AS c0, 'País ' || n_name AS c1 FROM nation"
CTES["raw_lk_qualificacoes"] = ("SELECT CAST(n_nationkey * 2 AS VARCHAR) AS c0, "
                                "'Qualificação ' || n_name AS c1 FROM nation")

CTES["empresa"] = f"""
SELECT
  {pad('c0', 8)} AS cnpj_basico,
  UPPER({q('c1')}) AS razao_social,
  NULLIF({tint('c2')}, 0) AS natureza_juridica,
  {padn('c3', 2)} AS qualificacao_responsavel,
  COALESCE(TRY_CAST(REPLACE(REPLACE({q('c4')}, '.', ''), ',', '.') AS DECIMAL(15,2)), 0.0) AS capital_social,
  CASE WHEN {pad('c5', 2)} IN ('00', '01', '03', '05') THEN {pad('c5', 2)} ELSE '00' END AS porte_empresa,
  {nb('c6')} AS ente_federativo_responsavel,
  '{MONTH}' AS reference_month
FROM raw_company WHERE LENGTH({q('c0')}) = 8
"""

CTES["estab"] = f"""
SELECT
  {pad('c0', 8)} AS cnpj_basico, {pad('c1', 4)} AS cnpj_ordem, {pad('c2', 2)} AS cnpj_dv,
  {tint('c3')} AS identificador_matriz_filial,
  {nbu('c4')} AS nome_fantasia,
  {padn('c5', 2)} AS situacao_cadastral,
  {dt('c6')} AS data_situacao_cadastral,
  {padn('c7', 2)} AS motivo_situacao_cadastral,
  {nbu('c8')} AS nome_cidade_exterior,
  {padn('c9', 3)} AS codigo_pais,
  {dt('c10')} AS data_inicio_atividade,
  {padn('c11', 7)} AS cnae_fiscal_principal,
  {nb('c12')} AS cnae_fiscal_secundaria,
  {nbu('c13')} AS tipo_logradouro, {nbu('c14')} AS logradouro, {nb('c15')} AS numero,
  {nbu('c16')} AS complemento, {nbu('c17')} AS bairro,
  CASE WHEN LENGTH({q('c18')}) > 0 THEN {pad('c18', 8)} ELSE NULL END AS cep,
  {nb('c19')} AS uf,
  {padn('c20', 4)} AS codigo_municipio,
  {nb('c21')} AS ddd_1, NULLIF({tint('c22')}, 0) AS telefone_1,
  {nb('c23')} AS ddd_2, NULLIF({tint('c24')}, 0) AS telefone_2,
  {nb('c25')} AS ddd_fax, NULLIF({tint('c26')}, 0) AS fax,
  CASE WHEN LENGTH({q('c27')}) > 0 THEN LOWER({q('c27')}) ELSE NULL END AS correio_eletronico,
  {nbu('c28')} AS situacao_especial,
  {dt('c29')} AS data_situacao_especial,
  '{MONTH}' AS reference_month
FROM raw_estab WHERE LENGTH({q('c0')}) = 8
"""

CTES["socio"] = f"""
SELECT
  {pad('c0', 8)} AS cnpj_basico,
  {tint('c1')} AS identificador_socio,
  {nbu('c2')} AS nome_socio_razao_social,
  {nb('c3')} AS cpf_cnpj_socio,
  {padn('c4', 2)} AS qualificacao_socio,
  {dt2('c5')} AS data_entrada_sociedade,
  {padn('c6', 3)} AS pais,
  {nb('c7')} AS representante_legal,
  {nbu('c8')} AS nome_do_representante,
  {padn('c9', 2)} AS qualificacao_representante_legal,
  {tint('c10')} AS faixa_etaria,
  '{MONTH}' AS reference_month
FROM raw_partner WHERE LENGTH({q('c0')}) = 8
"""

CTES["simples"] = f"""
SELECT
  {pad('c0', 8)} AS cnpj_basico,
  CASE UPPER({q('c1')}) WHEN 'S' THEN TRUE WHEN 'N' THEN FALSE ELSE NULL END AS optante_simples_nacional,
  {dt2('c2')} AS data_optante_simples_nacional,
  {dt2('c3')} AS data_exclusao_simples_nacional,
  CASE UPPER({q('c4')}) WHEN 'S' THEN TRUE WHEN 'N' THEN FALSE ELSE NULL END AS opcao_mei,
  {dt2('c5')} AS data_opcao_mei,
  {dt2('c6')} AS data_exclusao_mei
FROM raw_tax WHERE LENGTH({q('c0')}) >= 6
"""

CTES["lk_cnae"] = f"SELECT {q('c0')} AS cnae_fiscal, {q('c1')} AS descricao FROM raw_lk_cnaes WHERE LENGTH({q('c0')}) > 0"
CTES["lk_motivo"] = f"SELECT {pad('c0', 2)} AS codigo, {q('c1')} AS descricao FROM raw_lk_motivos WHERE LENGTH({q('c0')}) > 0"
CTES["lk_municipio"] = f"SELECT {pad('c0', 4)} AS codigo, {q('c1')} AS nome FROM raw_lk_municipios WHERE LENGTH({q('c0')}) > 0"
CTES["lk_natureza"] = f"SELECT {tint('c0')} AS codigo, {q('c1')} AS descricao FROM raw_lk_naturezas WHERE LENGTH({q('c0')}) > 0"
CTES["lk_pais"] = f"SELECT {pad('c0', 3)} AS codigo, {q('c1')} AS nome FROM raw_lk_paises WHERE LENGTH({q('c0')}) > 0"
CTES["lk_qualificacao"] = f"SELECT {pad('c0', 2)} AS codigo, {q('c1')} AS descricao FROM raw_lk_qualificacoes WHERE LENGTH({q('c0')}) > 0"


def _head_offices(wanted: str) -> str:
    """Search rows: head offices with the ``wanted`` status under their
    company, names looked up by code (null where a lookup has no row)."""
    return f"""
WITH head AS (FROM estab WHERE identificador_matriz_filial = 1 AND {wanted}),
named AS (
  SELECT head.*, lk_municipio.nome AS municipio_nome, lk_cnae.descricao AS cnae_descricao
  FROM head LEFT JOIN lk_municipio ON lk_municipio.codigo = head.codigo_municipio
            LEFT JOIN lk_cnae ON lk_cnae.cnae_fiscal = head.cnae_fiscal_principal)
SELECT cnpj_basico, razao_social, nome_fantasia, cnpj_ordem, cnpj_dv, cnpj_basico || cnpj_ordem || cnpj_dv AS cnpj_14,
       situacao_cadastral, codigo_municipio, municipio_nome, uf, cnae_fiscal_principal, cnae_descricao, porte_empresa,
       natureza_juridica, lk_natureza.descricao AS natureza_juridica_descricao, capital_social, data_inicio_atividade,
       correio_eletronico, empresa.reference_month
FROM named JOIN empresa USING (cnpj_basico) LEFT JOIN lk_natureza ON lk_natureza.codigo = natureza_juridica
"""


CTES["mv_active"] = _head_offices("situacao_cadastral = '02'")
CTES["mv_inactive"] = _head_offices("situacao_cadastral IS DISTINCT FROM '02' AND situacao_cadastral IS NOT NULL")


# prelude tables read by several others: computed once per query
MATERIALIZE = {"raw_estab", "empresa", "estab", "socio", "mv_active", "mv_inactive", "fbase", "f_records0",
               "f_company", "f_records", "f_by_muni"}


def with_prelude(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` every prelude table (DuckDB only evaluates the ones used)."""
    ctes = dict(CTES)
    if extra:
        ctes.update(extra)
    parts = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in MATERIALIZE else ''}({sql})"
                        for name, sql in ctes.items())
    head = body.lstrip()
    if head[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts},\n{head[15:]}"
    if head[:5].upper() == "WITH ":
        return f"WITH {parts},\n{head[5:]}"
    return f"WITH {parts}\n{body}"
