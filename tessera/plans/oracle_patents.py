"""DuckDB statement of the patent proxies and cleaned patent tables."""

from __future__ import annotations

from tessera.plans.oracle_base import CTES, MATERIALIZE, nb, q

A = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def dmy(x: str) -> str:
    return f"strftime(DATE '2000-01-01' + CAST({x} AS INTEGER), '%d/%m/%Y')"


norm = nb


def dayfirst(c: str) -> str:
    t = q(c)
    return f"CAST(coalesce(try_strptime({t}, '%d/%m/%Y'), try_strptime({t}, '%Y-%m-%d')) AS DATE)"


def code(c: str = "codigo_interno") -> str:
    return f"TRY_CAST(TRY_CAST({q(c)} AS DOUBLE) AS BIGINT)"


def first(src: str, keys: str) -> str:
    return (f"SELECT * EXCLUDE (_row, _rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY _row) AS _rn "
            f"FROM {src} WHERE {keys.split(',')[0]} IS NOT NULL) t WHERE _rn = 1")


def semi(src: str, key: str = "codigo_interno") -> str:
    return f"SELECT * FROM ({src}) s WHERE {key} IN (SELECT codigo_interno FROM pt_bib)"


_PREFIX = "CASE WHEN p_size % 3 = 0 THEN 'PI' WHEN p_size % 3 = 1 THEN 'MU' ELSE 'BR10' END"

CTES["raw_pt_bib"] = f"""
SELECT p_partkey * 2 AS _row, CAST(p_partkey AS VARCHAR) AS codigo_interno,
       {_PREFIX} || LPAD(CAST(p_partkey AS VARCHAR), 7, '0') AS numero_inpi,
       CASE WHEN p_partkey % 37 = 0 THEN '31/02/2010' ELSE {dmy('p_partkey')} END AS data_deposito,
       {dmy('p_partkey + 30')} AS data_protocolo, {dmy('p_partkey + 540')} AS data_publicacao,
       '' AS numero_pct, CASE WHEN p_partkey % 4 = 0 THEN 'WO' || p_partkey ELSE '' END AS numero_wo,
       CASE WHEN p_partkey % 4 = 0 THEN {dmy('p_partkey + 2000')} ELSE '' END AS data_publicacao_wo,
       CASE WHEN p_partkey % 6 = 0 THEN {dmy('p_partkey + 900')} ELSE '' END AS data_entrada_fase_nacional,
       CASE WHEN p_partkey % 13 = 0 THEN '1.0' ELSE '0' END AS sigilo
FROM part
UNION ALL
SELECT p_partkey * 2 + 1, CAST(p_partkey AS VARCHAR), 'DUP' || {_PREFIX} || LPAD(CAST(p_partkey AS VARCHAR), 7, '0'),
       CASE WHEN p_partkey % 37 = 0 THEN '31/02/2010' ELSE {dmy('p_partkey')} END,
       {dmy('p_partkey + 30')}, {dmy('p_partkey + 540')},
       '', CASE WHEN p_partkey % 4 = 0 THEN 'WO' || p_partkey ELSE '' END,
       CASE WHEN p_partkey % 4 = 0 THEN {dmy('p_partkey + 2000')} ELSE '' END,
       CASE WHEN p_partkey % 6 = 0 THEN {dmy('p_partkey + 900')} ELSE '' END,
       CASE WHEN p_partkey % 13 = 0 THEN '1.0' ELSE '0' END
FROM part WHERE p_partkey % 41 = 0
"""

CTES["pt_bib"] = first(f"""(SELECT _row, {code()} AS codigo_interno, {norm('numero_inpi')} AS numero_inpi,
  NULLIF(upper(regexp_extract(trim(numero_inpi), '^([A-Za-z]+)', 1)), '') AS tipo_patente,
  {dayfirst('data_deposito')} AS data_deposito, {dayfirst('data_protocolo')} AS data_protocolo,
  {dayfirst('data_publicacao')} AS data_publicacao, {norm('numero_pct')} AS numero_pct, {norm('numero_wo')} AS numero_wo,
  {dayfirst('data_publicacao_wo')} AS data_publicacao_wo, {dayfirst('data_entrada_fase_nacional')} AS data_entrada_fase_nacional,
  COALESCE(TRY_CAST(trim(sigilo) AS DOUBLE) > 0, FALSE) AS sigilo,
  DATE '2024-01-31' AS snapshot_date FROM raw_pt_bib) b""", "codigo_interno")

CTES["pt_content"] = semi(first(f"""(SELECT p_partkey * 2 AS _row, {code('CAST(p_partkey AS VARCHAR)')} AS codigo_interno,
  {norm("CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END")} AS titulo,
  {norm("p_type || ' ' || p_name")} AS resumo FROM part) c""", "codigo_interno"))

_ROW = "((l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey)"

CTES["pt_inventors"] = semi(first(f"""(SELECT {_ROW} AS _row, l_partkey AS codigo_interno, l_linenumber AS ordem,
  'Inventor ' || CAST(l_suppkey AS VARCHAR) AS autor, 'BR' AS pais, 'SP' AS estado FROM lineitem) i""",
                                  "codigo_interno, ordem"))

_DEP_ID = ("CASE WHEN l_suppkey % 2 = 0 THEN LPAD(CAST(l_suppkey * 13 % 1500 AS VARCHAR), 8, '0') || '000100' "
           "ELSE '***' || LPAD(CAST(l_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0') || '**' END")
_DEP_T = ("CASE WHEN l_suppkey % 2 = 0 THEN 'Pessoa Jurídica' WHEN l_suppkey % 3 = 0 THEN 'pessoa física' "
          "ELSE 'Pessoa Física' END")

CTES["pt_depositors"] = semi(first(f"""(SELECT {_ROW} AS _row, l_partkey AS codigo_interno, l_linenumber AS ordem,
  'Depositante ' || CAST(l_suppkey AS VARCHAR) AS depositante, {_DEP_ID} AS cgccpfdepositante,
  {_DEP_T} AS tipopessoadepositante, 'BR' AS pais, 'SP' AS uf, CAST(l_shipdate AS DATE) AS data_inicio,
  CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_shipdate AS DATE) + 365 END AS data_fim,
  CASE WHEN lower({_DEP_T}) LIKE '%jur%' AND length({_DEP_ID}) = 14 AND regexp_full_match({_DEP_ID}, '[0-9]{{14}}')
       THEN left({_DEP_ID}, 8) END AS cnpj_basico_resolved FROM lineitem) d""", "codigo_interno, ordem"))

_BR = "CAST(split_part(p_brand, '#', 2) AS INTEGER)"
_SYM = (f"substr({A}, ({_BR} % 8) % 26 + 1, 1) || LPAD(CAST(p_size % 100 AS VARCHAR), 2, '0') || "
        f"substr({A}, CAST(p_partkey % 26 + 1 AS INTEGER), 1)")
_SYM2 = (f"substr({A}, ({_BR} % 8) % 26 + 1, 1) || LPAD(CAST(p_size % 100 AS VARCHAR), 2, '0') || "
         f"substr({A}, CAST((p_partkey + 1) % 26 + 1 AS INTEGER), 1)")

CTES["raw_pt_ipc"] = f"""
SELECT p_partkey * 2 AS _row, CAST(p_partkey AS VARCHAR) AS codigo_interno, '1' AS ordem, {_SYM} || ' 1/00' AS simbolo,
       '2024.01' AS versao FROM part
UNION ALL
SELECT p_partkey * 2 + 1, CAST(p_partkey AS VARCHAR), '2', {_SYM2} || ' 2/00', '2024.01' FROM part WHERE p_partkey % 3 = 0
"""

CTES["pt_ipc"] = semi(first(f"""(SELECT _row, {code()} AS codigo_interno, CAST({code('ordem')} AS INTEGER) AS ordem,
  {norm('simbolo')} AS simbolo, {norm('versao')} AS versao FROM raw_pt_ipc) x""", "codigo_interno, ordem"))

CTES["pt_ipc_dim"] = """
SELECT simbolo, left(simbolo, 1) AS secao, left(simbolo, 3) AS classe, 'Title of ' || simbolo AS titulo_en,
       '2024.01' AS edition
FROM (SELECT DISTINCT left(simbolo, 4) AS simbolo FROM raw_pt_ipc) g
WHERE simbolo <> (SELECT max(left(simbolo, 4)) FROM raw_pt_ipc)
"""

CTES["pt_dispatches"] = semi(f"""SELECT l_partkey AS codigo_interno, CAST(l_orderkey % 3000 AS INTEGER) AS numero_rpi,
  CAST(l_shipdate AS DATE) AS data_rpi, l_returnflag || '.' || CAST(l_linenumber AS VARCHAR) AS codigo_despacho,
  l_linestatus AS complemento, {_ROW} AS id FROM lineitem""")

_PROC_ID = "CASE WHEN p_partkey % 4 = 0 THEN LPAD(CAST(p_partkey % 1500 AS VARCHAR), 8, '0') || '000100' ELSE '' END"
_PROC_T = "CASE WHEN p_partkey % 4 = 0 THEN 'Pessoa Jurídica' ELSE 'Pessoa Física' END"

_TURNS = "(SELECT p.*, unnest(range(p_partkey % 3 + 1)) AS t FROM part p)"

CTES["pt_attorneys"] = semi(f"""SELECT p_partkey * 4 + t AS id, p_partkey AS codigo_interno,
  'Procurador ' || ((p_partkey + t * 7) % 50) AS procurador, CASE WHEN t = 0 THEN DATE '2000-01-11' + CAST(p_partkey AS INTEGER) END AS data_inicio, {norm(_PROC_ID)} AS cgccpfprocurador,
  {_PROC_T} AS tipopessoaprocurador,
  CASE WHEN lower({_PROC_T}) LIKE '%jur%' AND length({_PROC_ID}) = 14 THEN left({_PROC_ID}, 8) END
    AS cnpj_basico_resolved FROM {_TURNS}""")

CTES["pt_priorities"] = semi(first(f"""(SELECT p_partkey * 4 + t AS _row, p_partkey AS codigo_interno,
  CASE WHEN t = 1 THEN 'EP' ELSE 'US' END AS pais_prioridade, 'US' || CAST(p_partkey AS VARCHAR) AS numero_prioridade,
  CAST(DATE '2000-01-01' + CAST(p_partkey - 200 AS INTEGER) AS DATE) AS data_prioridade
  FROM {_TURNS} WHERE p_partkey % 4 = 0) p""", "codigo_interno, pais_prioridade, numero_prioridade"))

CTES["pt_links"] = f"""SELECT * FROM ({semi(first(f'''(SELECT p_partkey * 4 + t AS _row, p_partkey AS codigo_interno,
  CASE WHEN p_partkey % 9 = 1 THEN p_partkey + 10000000 ELSE p_partkey // 2 END AS codigo_interno_vinculado,
  CASE WHEN (p_partkey + t) % 2 = 0 THEN 'A' ELSE 'I' END AS tipo_vinculo, DATE '2000-01-01' + CAST(p_partkey + t AS INTEGER) AS data_vinculo
  FROM {_TURNS} WHERE p_partkey > 0) v''', "codigo_interno, codigo_interno_vinculado, tipo_vinculo"))}) l
WHERE codigo_interno_vinculado IN (SELECT codigo_interno FROM pt_bib)"""

CTES["pt_renumberings"] = semi(first("""(SELECT p_partkey * 2 AS _row, p_partkey AS codigo_interno,
  'OLD' || CAST(p_partkey AS VARCHAR) AS numero_original FROM part WHERE p_partkey % 5 = 0) r""",
                                     "codigo_interno, numero_original"))

CTES["pt_view"] = """
SELECT b.codigo_interno, b.numero_inpi, b.tipo_patente, b.data_deposito, b.data_publicacao, b.sigilo,
       b.snapshot_date, c.titulo, inv.autor AS inventor_principal, inv.pais AS inventor_pais,
       dep.depositante AS depositante_principal, dep.tipopessoadepositante AS depositante_tipo,
       dep.cnpj_basico_resolved AS depositante_cnpj_basico, ipc.simbolo AS ipc_principal,
       left(ipc.simbolo, 4) AS ipc_secao_classe
FROM pt_bib b
LEFT JOIN pt_content c ON b.codigo_interno = c.codigo_interno
LEFT JOIN pt_inventors inv ON b.codigo_interno = inv.codigo_interno AND inv.ordem = 1
LEFT JOIN pt_depositors dep ON b.codigo_interno = dep.codigo_interno AND dep.ordem = 1
LEFT JOIN pt_ipc ipc ON b.codigo_interno = ipc.codigo_interno AND ipc.ordem = 1
"""

MATERIALIZE.update({"pt_bib", "pt_view", "pt_depositors", "pt_ipc"})
