"""Patent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import patents as PT
from tessera.plans import oracle_patents as OP  # noqa: F401  (prelude tables)
from tessera.plans.catalog import register

register("clean_patents", "SELECT * FROM pt_bib")(lambda I: I.patents)
for _k, _t in [("clean_patent_content", "conteudo"), ("clean_inventors", "inventores"),
               ("clean_depositors", "depositantes"), ("clean_ipc", "ipc"), ("clean_dispatches", "despachos"),
               ("clean_attorneys", "procuradores"), ("clean_priorities", "prioridades"),
               ("clean_links", "vinculos"), ("clean_renumberings", "renumeracoes")]:
    _sql = {"conteudo": "pt_content", "inventores": "pt_inventors", "depositantes": "pt_depositors",
            "ipc": "pt_ipc", "despachos": "pt_dispatches", "procuradores": "pt_attorneys",
            "prioridades": "pt_priorities", "vinculos": "pt_links", "renumeracoes": "pt_renumberings"}[_t]
    register(_k, f"SELECT * FROM {_sql}")((lambda t: lambda I: I.patent_part(t))(_t))

register("src_ipc_dim", "SELECT * FROM pt_ipc_dim")(lambda I: I.ipc_dim)

register("first_by_key", """
SELECT codigo_interno, numero_inpi FROM pt_bib
""")(lambda I: PT.first_by_key(I.raw_patent("bibliografia").select(
    "_row", C.to_int_trunc(F.col("codigo_interno")).alias("codigo_interno"), "numero_inpi"), ["codigo_interno"]))

register("with_parent", """
SELECT codigo_interno, codigo_interno_vinculado FROM pt_links
""")(lambda I: I.patent_part("vinculos").select("codigo_interno", "codigo_interno_vinculado"))

register("patent_search_view", "SELECT * FROM pt_view")(lambda I: I.patent_view)

register("filter_patents", """
SELECT codigo_interno FROM pt_view
WHERE (titulo ILIKE '%blue%' OR depositante_principal ILIKE '%blue%' OR inventor_principal ILIKE '%blue%')
  AND tipo_patente = 'PI' AND ipc_secao_classe ILIKE 'A%' AND data_deposito >= DATE '2000-02-01'
  AND data_deposito <= DATE '2004-12-31' AND sigilo = false
""")(lambda I: PT.filter_patents(I.patent_view, q="blue", tipo="pi", ipc="a", date_min="2000-02-01",
                                 date_max="2004-12-31", sigilo="false").select("codigo_interno"))

register("filter_patents_company", """
SELECT codigo_interno, depositante_cnpj_basico FROM pt_view WHERE depositante_cnpj_basico = '00000026'
""")(lambda I: PT.filter_patents(I.patent_view, cnpj="00.000.026/0001-00").select(
    "codigo_interno", "depositante_cnpj_basico"))

register("patents_total", """
SELECT COUNT(*) AS total_patentes, MAX(snapshot_date) AS snapshot_date FROM pt_view
""")(lambda I: PT.patents_total(I.patent_view))
register("patents_by_type", """
SELECT tipo_patente, COUNT(codigo_interno) AS total FROM pt_view GROUP BY tipo_patente
""")(lambda I: PT.patents_by_type(I.patent_view))
register("patents_by_ipc", """
SELECT t.ipc_secao_classe, t.total, d.titulo_en FROM (
  SELECT ipc_secao_classe, COUNT(codigo_interno) AS total FROM pt_view WHERE ipc_secao_classe IS NOT NULL
  GROUP BY ipc_secao_classe ORDER BY total DESC, ipc_secao_classe LIMIT 50) t
LEFT JOIN pt_ipc_dim d ON d.simbolo = t.ipc_secao_classe
""")(lambda I: PT.patents_by_ipc(I.patent_view, I.ipc_dim))
register("patents_by_year", """
SELECT CAST(year(data_deposito) AS INTEGER) AS ano, COUNT(codigo_interno) AS total FROM pt_view
WHERE data_deposito IS NOT NULL GROUP BY 1
""")(lambda I: PT.patents_by_year(I.patent_view))
register("patents_snapshot", """
SELECT max(snapshot_date) AS snapshot_date FROM pt_view
""")(lambda I: I.patents.agg(F.max("snapshot_date").alias("snapshot_date")))

_LIST = {
    "inventores": ("pt_inventors", "autor ILIKE '%inventor 1%'", dict(q="inventor 1")),
    "depositantes": ("pt_depositors", "depositante ILIKE '%depositante 2%'", dict(q="depositante 2")),
    "ipc": ("pt_ipc", "simbolo ILIKE '%a%'", dict(q="a")),
    "despachos": ("pt_dispatches", "(COALESCE(codigo_despacho, '') ILIKE '%r.1%' OR COALESCE(complemento, '') "
                  "ILIKE '%r.1%') AND data_rpi >= DATE '1999-01-01' AND data_rpi <= DATE '1999-12-31'",
                  dict(q="r.1", date_min="1999-01-01", date_max="1999-12-31")),
    "procuradores": ("pt_attorneys", "procurador ILIKE '%procurador 1%'", dict(q="procurador 1")),
    "prioridades": ("pt_priorities", "(COALESCE(numero_prioridade, '') ILIKE '%us1%' OR "
                    "COALESCE(pais_prioridade, '') ILIKE '%us1%')", dict(q="us1")),
    "vinculos": ("pt_links", "tipo_vinculo ILIKE '%a%'", dict(q="a")),
    "renumeracoes": ("pt_renumberings", "numero_original ILIKE '%old1%'", dict(q="old1")),
    "ipc_ref": ("pt_ipc_dim", "(COALESCE(simbolo, '') ILIKE '%b%' OR COALESCE(titulo_en, '') ILIKE '%b%')",
                dict(q="b")),
}

for _kind, (_tab, _where, _kw) in _LIST.items():
    def _mk(kind, kw):
        def q(I):
            src = I.ipc_dim if kind == "ipc_ref" else I.patent_part(kind)
            return PT.list_patent_part(src, kind, **kw)
        return q
    register(f"list_patent_part_{_kind}", f"SELECT * FROM {_tab} WHERE {_where}")(_mk(_kind, _kw))

register("fn_patent_type", """
SELECT numero_inpi AS raw, NULLIF(upper(regexp_extract(trim(numero_inpi), '^([A-Za-z]+)', 1)), '') AS v FROM raw_pt_bib
""")(lambda I: I.raw_patent("bibliografia").select(F.col("numero_inpi").alias("raw"),
                                                   C.patent_type(F.col("numero_inpi")).alias("v")))
register("fn_secrecy", """
SELECT sigilo AS raw, COALESCE(TRY_CAST(trim(sigilo) AS DOUBLE) > 0, FALSE) AS v FROM raw_pt_bib
""")(lambda I: I.raw_patent("bibliografia").select(F.col("sigilo").alias("raw"), C.secrecy("sigilo").alias("v")))
register("fn_date_dayfirst", f"""
SELECT data_deposito AS raw, {OP.dayfirst('data_deposito')} AS v FROM raw_pt_bib
""")(lambda I: I.raw_patent("bibliografia").select(F.col("data_deposito").alias("raw"),
                                                   C.date_dayfirst("data_deposito").alias("v")))
register("fn_to_int_trunc", """
SELECT sigilo AS raw, TRY_CAST(trunc(TRY_CAST(trim(sigilo) AS DOUBLE)) AS BIGINT) AS v FROM raw_pt_bib
""")(lambda I: I.raw_patent("bibliografia").select(F.col("sigilo").alias("raw"), C.to_int_trunc("sigilo").alias("v")))
register("fn_resolve_root", """
SELECT codigo_interno, ordem, cnpj_basico_resolved AS v FROM pt_depositors
""")(lambda I: I.patent_part("depositantes").select("codigo_interno", "ordem",
                                                     F.col("cnpj_basico_resolved").alias("v")))
register("fn_ipc_parts", """
SELECT simbolo, left(simbolo, 1) AS secao, left(simbolo, 3) AS classe, left(simbolo, 4) AS grupo FROM pt_ipc
""")(lambda I: I.patent_part("ipc").select("simbolo", C.ipc_section("simbolo").alias("secao"),
                                           C.ipc_class("simbolo").alias("classe"),
                                           C.ipc_group("simbolo").alias("grupo")))
