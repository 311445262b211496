"""Funding queries: loaders, records, enrichment, summaries, Gini, map."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import funding as FU
from tessera.operators.common import page, top_k
from tessera.plans import oracle_funding as OF  # noqa: F401  (registers prelude tables)
from tessera.plans.catalog import register
from tessera.plans.oracle_funding import gini_sql

_DIRECT_COLS = ["instrumento", "ref", "contrato", "data_assinatura", "titulo", "proponente", "cnpj_proponente",
                "municipio", "uf", "valor_finep", "valor_pago", "status", "cnpj_proponente_norm", "id"]

register("funding_direct", "SELECT * FROM f_direct")(
    lambda I: I.funding("direct").select(*_DIRECT_COLS))
register("funding_credit", "SELECT * FROM f_credit")(
    lambda I: I.funding("credit").select("data_assinatura", "contrato", "proponente", "cnpj_proponente", "uf",
                                         "valor_financiado", "valor_liberado", "cnpj_proponente_norm", "id"))
register("funding_equity", "SELECT * FROM f_equity")(
    lambda I: I.funding("equity").select("ref", "contrato", "cnpj_proponente", "proponente", "data_assinatura",
                                         "valor_total_contratado", "valor_total_liberado", "opcao_exercida",
                                         "desinvestido", "tir", "moic", "cnpj_proponente_norm", "id"))
register("funding_audiovisual", "SELECT * FROM f_audiovisual")(
    lambda I: I.funding("audiovisual").select(*_DIRECT_COLS))

register("src_funding_sheet", """
SELECT 'direct' AS source, COUNT(*) AS n FROM f_direct UNION ALL
SELECT 'credit', COUNT(*) FROM f_credit UNION ALL
SELECT 'equity', COUNT(*) FROM f_equity UNION ALL
SELECT 'audiovisual', COUNT(*) FROM f_audiovisual
""")(lambda I: I.funding("direct").select(F.lit("direct").alias("source"))
     .unionByName(I.funding("credit").select(F.lit("credit").alias("source")))
     .unionByName(I.funding("equity").select(F.lit("equity").alias("source")))
     .unionByName(I.funding("audiovisual").select(F.lit("audiovisual").alias("source")))
     .groupBy("source").agg(F.count(F.lit(1)).alias("n")))

register("with_norm_id", """
SELECT f_cnpj AS raw, regexp_replace(f_cnpj, '[^0-9]', '', 'g') AS norm FROM fbase
""")(lambda I: __import__("tessera.sources.proxies", fromlist=["x"])._funding_base(I.spark, I.sf_dir)
     .select(F.col("f_cnpj").alias("raw"), FU.with_norm_id(F.col("f_cnpj")).alias("norm")))

_DISB_D = """
SELECT f_ref AS ref, f_contract AS contrato, inst AS parcela, CAST(inst AS VARCHAR) AS numero_liberacao,
       CAST(CAST(l_shipdate AS DATE) + CAST(inst * 30 AS INTEGER) AS DATE) AS data_liberacao,
       CASE WHEN inst = 1 THEN f_paid ELSE CAST(f_approved - f_paid AS DECIMAL(15,2)) END AS valor_liberado
FROM fbase, unnest(CASE WHEN l_linenumber % 2 = 0 THEN [1, 2] ELSE [1] END) AS u(inst)
WHERE {split}
"""

register("disb_direct", _DISB_D.format(split=FU.__dict__.get("_x", "l_returnflag = 'R'")))(
    lambda I: I.disbursements("direct").select("ref", "contrato", "parcela", "numero_liberacao",
                                               "data_liberacao", "valor_liberado"))
register("disb_audiovisual", _DISB_D.format(split="l_returnflag = 'N'"))(
    lambda I: I.disbursements("audiovisual").select("ref", "contrato", "parcela", "numero_liberacao",
                                                    "data_liberacao", "valor_liberado"))
register("disb_credit", """
SELECT f_contract AS contrato, CASE WHEN f_cnpj = '' THEN NULL ELSE f_cnpj END AS cnpj_proponente, inst AS parcela,
       CAST(CAST(l_shipdate AS DATE) + CAST(inst * 30 AS INTEGER) AS DATE) AS data_liberacao,
       CASE WHEN inst = 1 THEN f_paid ELSE CAST(f_approved - f_paid AS DECIMAL(15,2)) END AS valor_liberado,
       regexp_replace(CASE WHEN f_cnpj = '' THEN NULL ELSE f_cnpj END, '[^0-9]', '', 'g') AS cnpj_proponente_norm
FROM fbase, unnest(CASE WHEN l_linenumber % 2 = 0 THEN [1, 2] ELSE [1] END) AS u(inst)
WHERE l_returnflag = 'A' AND l_linestatus = 'F'
""")(lambda I: I.disbursements("credit").select("contrato", "cnpj_proponente", "parcela", "data_liberacao",
                                                "valor_liberado", "cnpj_proponente_norm"))

_REC = ["source", "source_id", "cnpj_14", "municipio_nome", "uf", "total_aprovado_finep", "total_liberado",
        "instrumento"]
register("all_projects", "SELECT source, source_id, cnpj_14, municipio_nome, uf, total_aprovado_finep, "
         "total_liberado, instrumento FROM f_records")(lambda I: I.records.select(*_REC))

register("lookup_company", "SELECT * FROM f_company")(
    lambda I: FU.lookup_company(I.records.select("cnpj_14"), I.active_view, I.inactive_view))

register("filter_projects", """
SELECT source_id, cnpj_14, uf FROM f_records
WHERE COALESCE(uf, '') = 'SP' AND (lower(COALESCE(company_razao_social, '')) LIKE '%customer#00000%'
  OR lower(COALESCE(company_nome_fantasia, '')) LIKE '%customer#00000%'
  OR lower(COALESCE(company_cnae_descricao, '')) LIKE '%customer#00000%'
  OR lower(COALESCE(municipio_nome, '')) LIKE '%customer#00000%'
  OR lower(COALESCE(instrumento, '')) LIKE '%customer#00000%')
""")(lambda I: FU.filter_projects(I.records, uf="sp", q="Customer#00000").select("source_id", "cnpj_14", "uf"))

register("filter_projects_id", """
SELECT source_id, cnpj_14 FROM f_records WHERE COALESCE(cnpj_14, '') LIKE '000000%'
""")(lambda I: FU.filter_projects(I.records, cnpj="000.000").select("source_id", "cnpj_14"))

_MEAS = """COUNT(DISTINCT NULLIF(cnpj_14, '')) AS total_empresas, COUNT(*) AS total_projetos,
       CAST(SUM(total_aprovado_finep) AS DECIMAL(20,2)) AS total_aprovado_finep,
       CAST(SUM(total_liberado) AS DECIMAL(20,2)) AS total_liberado,
       list_sort(list_distinct(list(source))) AS fontes"""

register("funding_by_state", f"""
SELECT COALESCE(NULLIF(uf, ''), 'NA') AS uf, {_MEAS} FROM f_records GROUP BY 1
""")(lambda I: FU.funding_by_state(I.records))

register("funding_by_activity", f"""
SELECT company_cnae_fiscal_principal AS cnae_fiscal_principal, company_cnae_descricao AS cnae_descricao, {_MEAS}
FROM f_records GROUP BY 1, 2
""")(lambda I: FU.funding_by_activity(I.records))

register("funding_by_company", """
SELECT cnpj_14, first(company_razao_social) AS razao_social, first(company_nome_fantasia) AS nome_fantasia,
       first(company_municipio_nome) AS municipio_nome,
       first(company_cnae_fiscal_principal) AS cnae_fiscal_principal,
       first(company_cnae_descricao) AS cnae_descricao, first(company_porte_empresa) AS porte_empresa,
       first(company_natureza_juridica) AS natureza_juridica,
       first(company_natureza_juridica_descricao) AS natureza_juridica_descricao,
       first(company_capital_social) AS capital_social, first(company_match_source) AS match_source,
       min_by(COALESCE(NULLIF(uf, ''), company_uf), source_id)
         FILTER (WHERE COALESCE(NULLIF(uf, ''), company_uf) IS NOT NULL) AS uf,
       COUNT(*) AS total_projetos, CAST(SUM(total_aprovado_finep) AS DECIMAL(20,2)) AS total_aprovado_finep,
       CAST(SUM(total_liberado) AS DECIMAL(20,2)) AS total_liberado,
       list_sort(list_distinct(list(source))) AS fontes
FROM f_records WHERE COALESCE(cnpj_14, '') <> '' GROUP BY cnpj_14
""")(lambda I: FU.funding_by_company(I.records))

register("funding_by_municipality", "SELECT * FROM f_by_muni")(lambda I: I.by_municipality)

register("gini_overall", gini_sql("f_by_muni", "total_liberado", None))(
    lambda I: FU.gini(I.by_municipality, "total_liberado"))
register("gini_by_state", gini_sql("(SELECT * FROM f_by_muni WHERE uf IS NOT NULL) q", "total_liberado", "uf"))(
    lambda I: FU.gini(I.by_municipality.filter(F.col("uf").isNotNull()), "total_liberado", ["uf"]))

register("funding_overview", f"""
WITH m AS (SELECT COUNT(*) AS total_municipios FROM f_by_muni),
     g AS ({gini_sql('f_by_muni', 'total_liberado', None)}),
     s AS (SELECT map_from_entries(list(struct_pack(k := source, v := n) ORDER BY source)) AS projetos_por_fonte
           FROM (SELECT source, COUNT(*) AS n FROM f_records GROUP BY source) x)
SELECT COUNT(DISTINCT NULLIF(cnpj_14, '')) AS total_empresas, COUNT(DISTINCT NULLIF(uf, '')) AS total_ufs,
       COUNT(*) AS total_projetos,
       CAST(COALESCE(SUM(total_aprovado_finep), 0) AS DECIMAL(20,2)) AS total_aprovado_finep,
       CAST(COALESCE(SUM(total_liberado), 0) AS DECIMAL(20,2)) AS total_liberado,
       list_sort(list_distinct(list(source))) AS fontes,
       CAST(CASE WHEN COUNT(*) > 0 THEN CAST(COALESCE(SUM(total_aprovado_finep), 0) AS DECIMAL(20,2)) / COUNT(*)
            ELSE 0 END AS DECIMAL(20,2)) AS ticket_medio_projeto,
       any_value(m.total_municipios) AS total_municipios, any_value(g.gini) AS gini_liberado,
       any_value(s.projetos_por_fonte) AS projetos_por_fonte
FROM f_records, m, g, s
""")(lambda I: FU.funding_overview(I.records, I.by_municipality))

register("map_metadata", """
SELECT COUNT(*) FILTER (WHERE municipality_ibge_code IS NOT NULL) AS features,
       COUNT(*) FILTER (WHERE total_liberado > 0) AS municipios_com_valor,
       MAX(total_aprovado_finep) AS max_aprovado FROM f_by_muni
""")(lambda I: FU.map_metadata(I.by_municipality))

_BYCO = """(SELECT cnpj_14, CAST(SUM(total_aprovado_finep) AS DECIMAL(20,2)) AS a,
            CAST(SUM(total_liberado) AS DECIMAL(20,2)) AS l FROM f_records
            WHERE COALESCE(cnpj_14, '') <> '' GROUP BY cnpj_14)"""

register("release_ratio", f"""
SELECT cnpj_14, r AS release_ratio, CASE WHEN r >= 0.7 THEN 'high' WHEN r >= 0.4 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT cnpj_14, CASE WHEN a > 0 THEN ROUND(CAST(l AS DOUBLE) / CAST(a AS DOUBLE), 6) ELSE 0.0 END AS r
      FROM {_BYCO} t) x
""")(lambda I: FU.release_ratio(FU.funding_by_company(I.records)))

register("share_of_max", """
SELECT uf, total_aprovado_finep, CASE WHEN mx > 0 THEN ROUND(CAST(total_aprovado_finep AS DOUBLE) / CAST(mx AS DOUBLE), 6)
       ELSE 0.0 END AS share
FROM (SELECT uf, total_aprovado_finep, MAX(total_aprovado_finep) OVER () AS mx FROM
      (SELECT COALESCE(NULLIF(uf, ''), 'NA') AS uf, CAST(SUM(total_aprovado_finep) AS DECIMAL(20,2)) AS total_aprovado_finep
       FROM f_records GROUP BY 1) a) b
""")(lambda I: FU.share_of_max(FU.funding_by_state(I.records), "uf", "total_aprovado_finep"))

register("choropleth_class", """
SELECT municipality_ibge_code, total_liberado, share,
  CASE WHEN total_liberado IS NULL OR total_liberado <= 0 THEN 0 WHEN share >= 0.8 THEN 5 WHEN share >= 0.55 THEN 4
       WHEN share >= 0.3 THEN 3 WHEN share >= 0.12 THEN 2 ELSE 1 END AS class
FROM (SELECT municipality_ibge_code, total_liberado,
        CASE WHEN mx > 0 THEN ROUND(CAST(total_liberado AS DOUBLE) / CAST(mx AS DOUBLE), 6) ELSE 0.0 END AS share
      FROM (SELECT *, MAX(total_liberado) OVER () AS mx FROM f_by_muni) a) b
""")(lambda I: FU.choropleth_class(I.by_municipality, "municipality_ibge_code", "total_liberado"))

_DISB_COLS = ["contrato", "ref", "parcela", "valor_liberado", "id", "titulo", "cnpj_proponente_norm", "razao_social", "match_source"]
_COMPANY = """(SELECT * FROM (SELECT cnpj_14, razao_social, match_source,
             row_number() OVER (PARTITION BY cnpj_14 ORDER BY tier) AS rn FROM (
             SELECT cnpj_14, razao_social, 'active' AS match_source, 0 AS tier FROM mv_active
             UNION ALL SELECT cnpj_14, razao_social, 'inactive', 1 FROM mv_inactive) u) y WHERE rn = 1)"""
_DISB = """
WITH d AS (
  SELECT f_ref AS ref, f_contract AS contrato, inst AS parcela,
         CASE WHEN inst = 1 THEN f_paid ELSE CAST(f_approved - f_paid AS DECIMAL(15,2)) END AS valor_liberado
  FROM fbase, unnest(CASE WHEN l_linenumber % 2 = 0 THEN [1, 2] ELSE [1] END) AS u(inst)
  WHERE {split}),
p AS (SELECT f_contract AS contrato, f_ref AS ref, '{sheet}-' || f_contract || '-' || f_ref AS id, f_title AS titulo,
    regexp_replace(nullif(f_cnpj, ''), '[^0-9]', '', 'g') AS cnpj_proponente_norm FROM fbase WHERE {split} AND {kept}
  QUALIFY row_number() OVER (PARTITION BY f_contract, f_ref ORDER BY l_partkey DESC) = 1)
SELECT d.contrato, d.ref, d.parcela, d.valor_liberado, p.id, p.titulo, p.cnpj_proponente_norm,
       c.razao_social, c.match_source
FROM d LEFT JOIN p ON d.contrato = p.contrato AND d.ref IS NOT DISTINCT FROM p.ref
LEFT JOIN {company} c ON p.cnpj_proponente_norm = c.cnpj_14
"""
for _key, _sheet, _split, _kept in (("disbursement_project", "direct", "l_returnflag = 'R'", "f_instrument IS NOT NULL"),
                                    ("disbursement_project_audiovisual", "audiovisual", "l_returnflag = 'N'", "true")):
    register(_key, _DISB.format(split=_split, sheet=_sheet, kept=_kept, company=_COMPANY))((lambda sheet: lambda I: FU.disbursement_project(
        I.disbursements(sheet), I.funding(sheet), I.stored_view("active"), I.stored_view("inactive")).select(*_DISB_COLS))(_sheet))
register("disbursement_project_credit", f"""
WITH d AS (SELECT f_contract AS contrato, inst AS parcela, CASE WHEN inst = 1 THEN f_paid ELSE CAST(f_approved - f_paid AS DECIMAL(15,2)) END AS valor_liberado,
    regexp_replace(nullif(f_cnpj, ''), '[^0-9]', '', 'g') AS cnpj_proponente_norm
  FROM fbase, unnest(CASE WHEN l_linenumber % 2 = 0 THEN [1, 2] ELSE [1] END) AS u(inst) WHERE l_returnflag = 'A' AND l_linestatus = 'F')
SELECT contrato, NULL::VARCHAR AS ref, parcela, valor_liberado, NULL::VARCHAR AS id, NULL::VARCHAR AS titulo, cnpj_proponente_norm, c.razao_social, c.match_source
FROM d LEFT JOIN {_COMPANY} c ON d.cnpj_proponente_norm = c.cnpj_14
""")(lambda I: FU.disbursement_project(I.disbursements("credit"), None, I.stored_view("active"), I.stored_view("inactive")).select(*_DISB_COLS))

register("list_funding_audiovisual", """
SELECT id, contrato, ref, uf FROM f_audiovisual WHERE titulo ILIKE '%projeto 2%' AND (contrato ILIKE '%2%' OR ref ILIKE '%2%') AND uf = 'RJ'
""")(lambda I: FU.list_funding(I.funding("audiovisual"), q="projeto 2", fields=["titulo"], ref="2", uf="rj").select("id", "contrato", "ref", "uf"))
register("list_funding_credit", """
SELECT id, contrato, uf FROM f_credit WHERE proponente ILIKE '%customer%' AND contrato ILIKE '%1%' AND starts_with(cnpj_proponente_norm, '0000001')
""")(lambda I: FU.list_funding(I.funding("credit"), q="customer", fields=["proponente"], ref="1", cnpj="00.000.01").select("id", "contrato", "uf"))
register("list_funding_equity", """
SELECT id, contrato, ref FROM f_equity WHERE proponente ILIKE '%customer%' AND (contrato ILIKE '%3%' OR ref ILIKE '%3%')
""")(lambda I: FU.list_funding(I.funding("equity"), q="customer", fields=["proponente"], ref="3", uf="sp").select("id", "contrato", "ref"))

register("list_funding", """
SELECT id, contrato, ref, uf FROM f_direct
WHERE (COALESCE(titulo, '') ILIKE '%projeto 1%' OR COALESCE(proponente, '') ILIKE '%projeto 1%')
  AND (COALESCE(contrato, '') ILIKE '%1%' OR COALESCE(ref, '') ILIKE '%1%') AND uf = 'SP'
""")(lambda I: FU.list_funding(I.funding("direct"), q="projeto 1", fields=["titulo", "proponente"], ref="1",
                               uf="sp").select("id", "contrato", "ref", "uf"))

register("resolve_geo", f"""
SELECT r.source_id, g.geo_codigo FROM f_records r LEFT JOIN f_geo_key g
  ON r.uf = g.g_uf AND {OF.city_key_sql('r.municipio_nome')} = g.g_key
""")(lambda I: FU.resolve_geo(I.records, I.geo_muni).select("source_id", "geo_codigo"))

register("sorted_set", """
SELECT COALESCE(NULLIF(uf, ''), 'NA') AS uf, list_sort(list_distinct(list(source))) AS fontes FROM f_records GROUP BY 1
""")(lambda I: I.records.groupBy(F.coalesce(F.nullif(F.col("uf"), F.lit("")), F.lit("NA")).alias("uf"))
     .agg(F.array_sort(F.collect_set("source")).alias("fontes")))

register("counts_map", """
SELECT source, COUNT(*) AS n FROM f_records GROUP BY source
""")(lambda I: FU.funding_overview(I.records, I.by_municipality).select(
    F.explode("projetos_por_fonte").alias("source", "n")))

register("page", """
SELECT uf, total_aprovado_finep FROM (
  SELECT COALESCE(NULLIF(uf, ''), 'NA') AS uf, CAST(SUM(total_aprovado_finep) AS DECIMAL(20,2)) AS total_aprovado_finep,
         COUNT(*) AS total_projetos FROM f_records GROUP BY 1) t
ORDER BY total_aprovado_finep DESC, total_projetos DESC, uf LIMIT 2 OFFSET 2
""")(lambda I: page(FU.funding_by_state(I.records),
                    [F.col("total_aprovado_finep").desc(), F.col("total_projetos").desc(), F.col("uf")],
                    page_no=2, size=2).select("uf", "total_aprovado_finep"))

register("order_spec", """
SELECT source_id, uf FROM f_records ORDER BY uf DESC NULLS LAST, source_id
""")(lambda I: I.records.orderBy(F.col("uf").desc_nulls_last(), "source_id").select("source_id", "uf"))

register("top_k", """
SELECT cnpj_14, total_aprovado_finep FROM (
  SELECT cnpj_14, CAST(SUM(total_aprovado_finep) AS DECIMAL(20,2)) AS total_aprovado_finep, COUNT(*) AS total_projetos
  FROM f_records WHERE COALESCE(cnpj_14, '') <> '' GROUP BY cnpj_14) t
ORDER BY total_aprovado_finep DESC, total_projetos DESC, cnpj_14 LIMIT 8
""")(lambda I: top_k(FU.funding_by_company(I.records),
                     [F.col("total_aprovado_finep").desc(), F.col("total_projetos").desc(), F.col("cnpj_14")],
                     8).select("cnpj_14", "total_aprovado_finep"))

register("fn_yes_no", """
SELECT f_flag AS raw, CASE WHEN upper(strip_accents(f_flag)) = 'SIM' THEN TRUE
                         WHEN upper(strip_accents(f_flag)) = 'NAO' THEN FALSE END AS v FROM fbase
""")(lambda I: __import__("tessera.sources.proxies", fromlist=["x"])._funding_base(I.spark, I.sf_dir)
     .select(F.col("f_flag").alias("raw"), C.yes_no(F.col("f_flag")).alias("v")))

register("fn_funding_num", """
SELECT source_id, CAST(total_liberado AS DECIMAL(15,2)) AS v FROM f_records
""")(lambda I: I.records.select("source_id", C.funding_num(F.col("total_liberado")).alias("v")))

register("fn_nonneg", """
SELECT c_custkey, GREATEST(COALESCE(TRY_CAST(c_acctbal AS DOUBLE), 0.0), 0.0) AS v FROM customer
""")(lambda I: I.table("customer").select("c_custkey", C.nonneg(F.col("c_acctbal")).alias("v")))


register("fn_money_text", """
SELECT l_orderkey, l_linenumber, v, CASE WHEN r < 0 THEN '-' ELSE '' END || 'R$' || chr(160) || replace(format('{:,}', abs(r)), ',', '.') AS text
FROM (SELECT *, round(v)::BIGINT AS r FROM (SELECT l_orderkey, l_linenumber, (l_extendedprice::DECIMAL(15,2) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END)::DECIMAL(15,2) AS v FROM lineitem))
""")(lambda I: I.table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice").cast("decimal(15,2)") * F.when(
    F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).cast("decimal(15,2)").alias("v")).withColumn("text", C.money_text("v")))
register("fn_compact_money", """
SELECT o_orderkey, v, CASE WHEN v < 1000 THEN 'R$' || chr(160) || one(v) WHEN v < 1000000 THEN 'R$' || chr(160) || one(v / 1000) || chr(160) || 'mil'
  ELSE 'R$' || chr(160) || one(v / 1000000) || chr(160) || 'mi' END AS text
FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * [1, 100, 10000][(o_orderkey % 3 + 1)::INT] / 100.0 AS v FROM orders)
""".replace("one(v / 1000000)", "replace(rtrim(rtrim(printf('%.1f', round(v / 1000000, 1)), '0'), '.'), '.', ',')")
   .replace("one(v / 1000)", "replace(rtrim(rtrim(printf('%.1f', round(v / 1000, 1)), '0'), '.'), '.', ',')")
   .replace("one(v)", "replace(rtrim(rtrim(printf('%.1f', round(v, 1)), '0'), '.'), '.', ',')"))(
    lambda I: I.table("orders").select("o_orderkey", (F.floor("o_totalprice") * F.element_at(F.array(F.lit(1), F.lit(100), F.lit(10000)), (
        F.col("o_orderkey") % 3 + 1).cast("int")) / 100.0).alias("v")).withColumn("text", C.compact_money("v")))
register("fn_three_places", """
SELECT c_custkey, replace(printf('%.3f', c_custkey / 8.0 - floor(c_custkey / 8.0)), '.', ',') AS text FROM customer
""")(lambda I: I.table("customer").select("c_custkey", C.three_places(F.col("c_custkey") / 8.0 - F.floor(F.col("c_custkey") / 8.0)).alias("text")))
register("fn_dec0", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice, 2)::DECIMAL(18,2) ELSE 0::DECIMAL(18,2) END AS v FROM orders
""")(lambda I: I.table("orders").select("o_orderkey", C.dec0(F.when(F.col("o_orderkey") % 3 > 0, F.round("o_totalprice", 2).cast("string")).when(
    F.col("o_orderkey") % 2 == 0, F.lit("x"))).alias("v")))
_CELL = "[n::VARCHAR, ' ' || n || ' ', n || '.7', 'x', NULL][(n % 5 + 1)::INT]"
for _key, _fn, _sql in (("fn_int0", C.int0, "CASE WHEN n % 5 < 3 THEN n::INT ELSE 0 END"), ("fn_smallint", C.smallint, "CASE WHEN n % 5 < 3 AND n < 32768 THEN n::SMALLINT END"),
                        ("fn_to_int", C.to_int, "CASE WHEN n % 5 < 2 THEN n::INT END"), ("fn_norm", C.norm, f"nullif(trim({_CELL}), '')")):
    register(_key, f"SELECT n, {_sql} AS v FROM (SELECT DISTINCT l_partkey * 7 AS n FROM lineitem)")((lambda fn: lambda I: I.table("lineitem").select(
        (F.col("l_partkey") * 7).alias("n")).distinct().withColumn("cell", F.element_at(F.array(
            F.col("n").cast("string"), F.concat(F.lit(" "), "n", F.lit(" ")), F.concat("n", F.lit(".7")), F.lit("x"), F.lit(None).cast("string")),
            (F.col("n") % 5 + 1).cast("int"))).select("n", fn(F.col("cell")).alias("v")))(_fn))
register("fn_date_only", "SELECT event_id, ts::DATE AS v FROM events")(lambda I: I.table("events").select("event_id", C.date_only("ts").alias("v")))
