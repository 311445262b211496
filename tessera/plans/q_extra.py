"""Lookups by root, single-row fetch, ownership profile, load report and
cleaner maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.common import first_by, top_k
from tessera.plans.catalog import register
from tessera.sources import proxies as P


# --------------------------------------------------------------------------
# operators
# --------------------------------------------------------------------------

def lookup_company_root(roots: DataFrame, active: DataFrame, inactive: DataFrame) -> DataFrame:
    """JOIN-8: per company root the preferred establishment row: active view
    before inactive, head office (ordem 0001) first, then lowest id."""
    cols = ["cnpj_basico", "cnpj_14", "cnpj_ordem", "razao_social", "uf", "municipio_nome"]
    wanted = roots.select("cnpj_basico").filter(F.col("cnpj_basico").isNotNull()).distinct()
    both = (active.select(*cols, F.lit(0).alias("_tier"), F.lit("active").alias("match_source"))
            .unionByName(inactive.select(*cols, F.lit(1).alias("_tier"), F.lit("inactive").alias("match_source")))
            .join(wanted, "cnpj_basico", "left_semi"))
    order = [F.col("_tier"), F.when(F.col("cnpj_ordem") == "0001", 0).otherwise(1), F.col("cnpj_14")]
    return first_by(both, ["cnpj_basico"], order).drop("_tier")


def get_one(df: DataFrame, key: str, value) -> DataFrame:
    """FLT-11: one row by key."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def apply_cleaners(df: DataFrame, cleaners: dict) -> DataFrame:
    """PRJ-26 / UDF-1: apply a {column: Column function} map; names not in
    the table are ignored. Functions are native Column builders, so the
    whole map stays one projection."""
    use = {c: fn(F.col(c)) for c, fn in cleaners.items() if c in df.columns}
    return df.withColumns(use) if use else df


def profile_kinds(partners: DataFrame) -> DataFrame:
    """AGG-18: rows, distinct ids, names and (id, name) pairs per kind."""
    return partners.groupBy("identificador_socio").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cpf_cnpj_socio").alias("ids"),
        F.count_distinct("nome_socio_razao_social").alias("names"),
        F.count_distinct("cpf_cnpj_socio", "nome_socio_razao_social").alias("pairs"))


def profile_collisions(partners: DataFrame) -> DataFrame:
    """AGG-18: masks shared by more than one name (people only)."""
    p = partners.filter(F.col("identificador_socio").isin(2, 3) & F.col("cpf_cnpj_socio").isNotNull())
    return p.groupBy("cpf_cnpj_socio").agg(F.count_distinct("nome_socio_razao_social").alias("names")) \
        .filter(F.col("names") > 1)


def profile_top(partners: DataFrame, k: int = 10) -> DataFrame:
    """AGG-18: the people in most companies (top-k report)."""
    g = partners.filter(F.col("identificador_socio").isin(2, 3)).groupBy(
        "nome_socio_razao_social", "cpf_cnpj_socio").agg(F.count_distinct("cnpj_basico").alias("companies"))
    return top_k(g, [F.col("companies").desc(), F.col("nome_socio_razao_social"), F.col("cpf_cnpj_socio")], k)


def load_report(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-21: rows per dataset plus a total row (rollup)."""
    parts = [df.select(F.lit(name).alias("dataset")) for name, df in tables.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.rollup("dataset").agg(F.count(F.lit(1)).alias("rows")).select(
        F.coalesce("dataset", F.lit("total")).alias("dataset"), "rows")


# --------------------------------------------------------------------------
# registered queries
# --------------------------------------------------------------------------

register("lookup_company_root", """
SELECT cnpj_basico, cnpj_14, cnpj_ordem, razao_social, uf, municipio_nome, match_source FROM (
  SELECT *, row_number() OVER (PARTITION BY cnpj_basico ORDER BY tier, CASE WHEN cnpj_ordem = '0001' THEN 0 ELSE 1 END,
                               cnpj_14) AS rn FROM (
    SELECT cnpj_basico, cnpj_14, cnpj_ordem, razao_social, uf, municipio_nome, 0 AS tier, 'active' AS match_source FROM mv_active
    UNION ALL
    SELECT cnpj_basico, cnpj_14, cnpj_ordem, razao_social, uf, municipio_nome, 1, 'inactive' FROM mv_inactive) u
  WHERE cnpj_basico IN (SELECT cnpj_basico_resolved FROM pt_depositors WHERE cnpj_basico_resolved IS NOT NULL)) t
WHERE rn = 1
""")(lambda I: lookup_company_root(
    I.patent_part("depositantes").select(F.col("cnpj_basico_resolved").alias("cnpj_basico")),
    I.active_view, I.inactive_view))

register("get_one", "SELECT * FROM pt_bib WHERE codigo_interno = 1 LIMIT 1")(
    lambda I: get_one(I.patents, "codigo_interno", 1))

register("apply_cleaners", f"""
SELECT UPPER(CASE WHEN LENGTH(TRIM(REPLACE(c1, '"', ''))) > 0 THEN TRIM(REPLACE(c1, '"', '')) END) AS c1,
       COALESCE(TRY_CAST(REPLACE(REPLACE(TRIM(REPLACE(c4, '"', '')), '.', ''), ',', '.') AS DECIMAL(15,2)), 0.0) AS c4
FROM raw_company
""")(lambda I: apply_cleaners(P.raw_company(I.spark, I.sf_dir),
                              {"c1": C.clean_string_upper, "c4": C.clean_money, "not_a_column": C.clean_string})
     .select("c1", "c4"))

register("profile_kinds", """
SELECT identificador_socio, COUNT(*) AS rows, COUNT(DISTINCT cpf_cnpj_socio) AS ids,
       COUNT(DISTINCT nome_socio_razao_social) AS names,
       COUNT(DISTINCT CASE WHEN cpf_cnpj_socio IS NOT NULL AND nome_socio_razao_social IS NOT NULL
                           THEN (cpf_cnpj_socio, nome_socio_razao_social) END) AS pairs
FROM socio GROUP BY identificador_socio
""")(lambda I: profile_kinds(I.partners))

# some masks cut to their first digit: masks that several names share
register("profile_collisions", """
SELECT mask AS cpf_cnpj_socio, COUNT(DISTINCT nome_socio_razao_social) AS names FROM (
  SELECT *, CASE WHEN cnpj_basico[-1] IN ('0', '4', '8') THEN left(cpf_cnpj_socio, 4) ELSE cpf_cnpj_socio END AS mask FROM socio) t
WHERE identificador_socio IN (2, 3) AND mask IS NOT NULL GROUP BY mask HAVING COUNT(DISTINCT nome_socio_razao_social) > 1
""")(lambda I: profile_collisions(I.partners.withColumn("cpf_cnpj_socio", F.when(
    F.right("cnpj_basico", F.lit(1)).isin("0", "4", "8"), F.left("cpf_cnpj_socio", F.lit(4))).otherwise(F.col("cpf_cnpj_socio")))))

register("profile_top", """
SELECT nome_socio_razao_social, cpf_cnpj_socio, COUNT(DISTINCT cnpj_basico) AS companies FROM socio
WHERE identificador_socio IN (2, 3) GROUP BY 1, 2 ORDER BY companies DESC, 1, 2 LIMIT 10
""")(lambda I: profile_top(I.partners))

_PATENT_TABLES = {"bibliografia": "pt_bib", "conteudo": "pt_content", "inventores": "pt_inventors", "depositantes": "pt_depositors", "ipc": "pt_ipc",
                  "despachos": "pt_dispatches", "procuradores": "pt_attorneys", "prioridades": "pt_priorities", "vinculos": "pt_links", "renumeracoes": "pt_renumberings"}
register("load_report", "SELECT coalesce(dataset, 'total') AS dataset, count(*) AS rows FROM ("
         + " UNION ALL ".join(f"SELECT '{n}' AS dataset FROM {t}" for n, t in _PATENT_TABLES.items()) + ") GROUP BY ROLLUP (dataset)")(
    lambda I: load_report({n: I.patents if n == "bibliografia" else I.patent_part(n) for n in _PATENT_TABLES}))
