"""Innovation funding: sheet loaders, project union, company enrichment,
filters and the analytic summaries (overview, Gini, per company / state /
activity / municipality, map measures).

All summaries are one lazy plan: ``all_projects -> enrich -> filter ->
groupBy``. Money stays DECIMAL; sums are cast to DECIMAL(20,2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.common import attach_scalars, first_by

MONEY = "decimal(20,2)"

# fixed values: sheet layouts (position -> column name, cell type)
LAYOUTS = {
    "direct": [
        ("instrumento", "text"), ("demanda", "text"), ("ref", "text"), ("contrato", "text"),
        ("data_assinatura", "date"), ("prazo_utilizacao_original", "date"), ("prazo_utilizacao", "date"),
        ("titulo", "text"), ("proponente", "text"), ("cnpj_proponente", "text"), ("executor", "text"),
        ("cnpj_executor", "text"), ("municipio", "text"), ("uf", "text"), ("valor_finep", "num"),
        ("status", "text"), ("contrapartida_financeira", "num"), ("contrapartida_nao_financeira", "num"),
        ("valor_pago", "num"), ("intervenientes", "int0"), ("intervenientes_financeira", "num"),
        ("intervenientes_nao_financeira", "num"), ("resumo_publico", "text"),
    ],
    "credit": [
        ("data_assinatura", "date"), ("contrato", "text"), ("proponente", "text"),
        ("cnpj_proponente", "text"), ("uf", "text"), ("valor_financiado", "num"),
        ("valor_liberado", "num"), ("contrapartida", "num"), ("outros_recursos", "num"),
        ("agente_financeiro", "text"),
    ],
    "equity": [
        ("ref", "text"), ("contrato", "text"), ("cnpj_proponente", "text"), ("proponente", "text"),
        ("data_assinatura", "date"), ("data_follow_on", "date"), ("valor_follow_on", "num"),
        ("valor_total_contratado", "num"), ("valor_total_liberado", "num"), ("opcao_exercida", "yes_no"),
        ("opcao_prorrogada", "yes_no"), ("data_exercicio", "date"), ("valuation", "num"),
        ("participacao", "num"), ("desinvestido", "yes_no"), ("data_desinvestimento", "date"),
        ("valor_desinvestimento", "num"), ("tir", "ratio"), ("moic", "ratio"),
    ],
    "audiovisual": [
        ("instrumento", "text"), ("demanda", "text"), ("ref", "text"), ("contrato", "text"),
        ("data_assinatura", "date"), ("prazo_utilizacao", "date"), ("titulo", "text"),
        ("proponente", "text"), ("cnpj_proponente", "text"), ("executor", "text"), ("municipio", "text"),
        ("uf", "text"), ("valor_finep", "num"), ("status", "text"), ("contrapartida_financeira", "num"),
        ("contrapartida_nao_financeira", "num"), ("valor_pago", "num"), ("intervenientes", "int0"),
        ("intervenientes_financeira", "num"), ("intervenientes_nao_financeira", "num"),
    ],
}

# fixed values: column that must be present for a row to be kept
REQUIRED = {"direct": ["instrumento"], "credit": ["contrato"], "equity": ["contrato"],
            "audiovisual": ["instrumento", "contrato"]}


def _typed(c, kind: str):
    if kind == "text":
        return C.clean_string(F.col(c).cast("string"))
    if kind == "num":
        return C.funding_num(F.col(c))
    if kind == "ratio":
        return F.col(c).try_cast("decimal(10,4)")
    if kind == "int0":
        return C.int0(F.col(c).cast("string"))
    if kind == "date":
        return F.to_date(C.parse_ts(F.col(c).cast("string")))
    if kind == "yes_no":
        return C.yes_no(F.col(c).cast("string"))
    raise ValueError(kind)


def read_funding_sheet(raw: DataFrame, source: str) -> DataFrame:
    """SRC-9 + PRJ-16..19: positional cells -> typed project rows; fully
    blank rows and rows without the required key are skipped; the sheet's row
    number (``_row``) is kept as ``row_no`` where it is known; the digits-only proposer id (PRJ-23) and a stable source id are added."""
    layout = LAYOUTS[source]
    cols = [_typed(f"c{i}", kind).alias(name) for i, (name, kind) in enumerate(layout)]
    df = raw.filter(F.coalesce(*[F.col(f"c{i}").cast("string") for i in range(len(layout))]).isNotNull())
    df = df.select(*cols, (F.col("_row") if "_row" in raw.columns else F.lit(None)).cast("long").alias("row_no"))
    req = REQUIRED[source]
    keep = F.lit(False)
    for r in req:
        keep = keep | F.col(r).isNotNull()
    df = df.filter(keep)
    if "cnpj_proponente" in df.columns:
        df = df.withColumn("cnpj_proponente_norm", with_norm_id(F.col("cnpj_proponente")))
    else:
        df = df.withColumn("cnpj_proponente_norm", F.lit(None).cast("string"))
    key = F.concat_ws("-", F.lit(source), F.col("contrato"), F.coalesce(F.col("ref"), F.lit("")))  \
        if "ref" in df.columns else F.concat_ws("-", F.lit(source), F.col("contrato"))
    return df.withColumn("id", key)


def with_norm_id(c):
    """PRJ-23: digits-only id; empty text stays empty, NULL stays NULL."""
    return C.norm_id(c)


# fixed values: disbursement sheet layouts (position of each field)
DISB_LAYOUT = {
    "direct": {"ref": 2, "contrato": 3, "parcela": 14, "numero_liberacao": 15, "data_liberacao": 16,
               "valor_liberado": 17},
    "audiovisual": {"ref": 2, "contrato": 3, "parcela": 14, "numero_liberacao": 15, "data_liberacao": 16,
                    "valor_liberado": 17},
    "credit": {"contrato": 1, "cnpj_proponente": 3, "parcela": 9, "data_liberacao": 10,
               "valor_liberado": 11},
}


def read_disbursements(raw: DataFrame, source: str) -> DataFrame:
    """PRJ-20..22: disbursement rows; a numeric contract cell (credit sheet)
    is normalised to integer text."""
    lay = DISB_LAYOUT[source]
    out = []
    for name, pos in lay.items():
        c = F.col(f"c{pos}")
        if name == "contrato" and source == "credit":
            v = c.try_cast("double").try_cast("bigint").cast("string")
        elif name == "parcela":
            v = C.to_int_trunc(c.cast("string"), "int")
        elif name == "data_liberacao":
            v = F.to_date(C.parse_ts(c.cast("string")))
        elif name == "valor_liberado":
            v = C.funding_num(c)
        else:
            v = C.clean_string(c.cast("string"))
        out.append(v.alias(name))
    df = raw.select(*out).filter(F.col("contrato").isNotNull())
    if "ref" not in df.columns:
        df = df.withColumn("ref", F.lit(None).cast("string"))
    if "cnpj_proponente" in df.columns:
        df = df.withColumn("cnpj_proponente_norm", with_norm_id(F.col("cnpj_proponente")))
    return df


# --------------------------------------------------------------------------
# SET-1, JOIN-7: one record shape, enriched from the company views
# --------------------------------------------------------------------------

RECORD_COLS = ["source", "source_id", "cnpj_14", "municipio_nome", "uf", "total_aprovado_finep",
               "total_liberado", "instrumento"]


def _zero(c):
    return F.coalesce(F.col(c), F.lit(0)).cast("decimal(15,2)")


def project_records(direct: DataFrame, credit: DataFrame, equity: DataFrame,
                    audiovisual: DataFrame) -> DataFrame:
    """SET-1: the four project tables in one record shape."""
    nul = F.lit(None).cast("string")
    d = direct.select(F.lit("operacao_direta").alias("source"), F.col("id").alias("source_id"),
                      F.col("cnpj_proponente_norm").alias("cnpj_14"),
                      C.norm_city("municipio").alias("municipio_nome"), "uf",
                      _zero("valor_finep").alias("total_aprovado_finep"),
                      _zero("valor_pago").alias("total_liberado"), "instrumento")
    c = credit.select(F.lit("credito_descentralizado").alias("source"), F.col("id").alias("source_id"),
                      F.col("cnpj_proponente_norm").alias("cnpj_14"), nul.alias("municipio_nome"), "uf",
                      _zero("valor_financiado").alias("total_aprovado_finep"),
                      _zero("valor_liberado").alias("total_liberado"),
                      F.lit("Credito Descentralizado").alias("instrumento"))
    e = equity.select(F.lit("investimento").alias("source"), F.col("id").alias("source_id"),
                      F.col("cnpj_proponente_norm").alias("cnpj_14"), nul.alias("municipio_nome"),
                      nul.alias("uf"), _zero("valor_total_contratado").alias("total_aprovado_finep"),
                      _zero("valor_total_liberado").alias("total_liberado"),
                      F.lit("Investimento").alias("instrumento"))
    a = audiovisual.select(F.lit("ancine").alias("source"), F.col("id").alias("source_id"),
                           F.col("cnpj_proponente_norm").alias("cnpj_14"),
                           C.norm_city("municipio").alias("municipio_nome"), "uf",
                           _zero("valor_finep").alias("total_aprovado_finep"),
                           _zero("valor_pago").alias("total_liberado"),
                           F.coalesce("instrumento", F.lit("Ancine")).alias("instrumento"))
    return d.unionByName(c).unionByName(e).unionByName(a)


LOOKUP_COLS = ["cnpj_14", "razao_social", "nome_fantasia", "situacao_cadastral", "municipio_nome", "uf",
               "cnae_fiscal_principal", "cnae_descricao", "porte_empresa", "natureza_juridica",
               "natureza_juridica_descricao", "capital_social", "data_inicio_atividade",
               "reference_month"]


def lookup_company(ids: DataFrame, active: DataFrame, inactive: DataFrame,
                   tiered: DataFrame | None = None) -> DataFrame:
    """JOIN-7: each 14-digit id from the active view, else the inactive one,
    tagged with ``match_source``. ``ids`` has one column ``cnpj_14``.
    ``tiered`` (both views from one join, see ``search_view_tiered``)
    replaces the union of the two views when given."""
    # no broadcast hint: the id set grows with the funding data; AQE turns
    # the semi join into a broadcast at runtime when it is small
    wanted = ids.select("cnpj_14").filter(F.length("cnpj_14") == 14).distinct()
    if tiered is not None:
        both = tiered.select(*LOOKUP_COLS, "match_source", "_tier")
    else:
        both = (active.select(*LOOKUP_COLS, F.lit("active").alias("match_source"), F.lit(0).alias("_tier"))
                .unionByName(inactive.select(*LOOKUP_COLS, F.lit("inactive").alias("match_source"),
                                             F.lit(1).alias("_tier"))))
    both = both.join(wanted, "cnpj_14", "left_semi")
    return first_by(both, ["cnpj_14"], [F.col("_tier")]).drop("_tier")


def enrich_records(records: DataFrame, active: DataFrame, inactive: DataFrame,
                   tiered: DataFrame | None = None) -> DataFrame:
    """Records with the company attributes (prefixed ``company_``); missing
    state and city are filled from the company."""
    comp = lookup_company(records, active, inactive, tiered)
    comp = comp.select([F.col(c).alias("company_" + c) for c in comp.columns])
    out = records.join(comp, records.cnpj_14 == comp.company_cnpj_14, "left")
    return (out.withColumn("uf", F.when(F.coalesce(F.col("uf"), F.lit("")) == "", F.col("company_uf"))
                           .otherwise(F.col("uf")))
            .withColumn("municipio_nome",
                        F.when(F.coalesce(F.col("municipio_nome"), F.lit("")) == "",
                               F.nullif(C.norm_city("company_municipio_nome"), F.lit("")))
                        .otherwise(F.col("municipio_nome")))
            .drop("company_cnpj_14"))


def filter_projects(records: DataFrame, cnpj: str | None = None, uf: str | None = None,
                    q: str | None = None) -> DataFrame:
    """FLT-4: id equal (14 digits) or prefix, state equal, case-insensitive
    contains over five enriched fields."""
    digits = "".join(ch for ch in (cnpj or "") if ch.isdigit())
    cond = F.lit(True)
    if digits:
        rc = F.coalesce(F.col("cnpj_14"), F.lit(""))
        cond = cond & ((rc == digits) if len(digits) == 14 else rc.startswith(digits))
    if uf and uf.strip():
        cond = cond & (F.coalesce(F.col("uf"), F.lit("")) == uf.strip().upper())
    if q and q.strip():
        needle = q.strip().lower()
        hay = F.lit(False)
        for c in ["company_razao_social", "company_nome_fantasia", "company_cnae_descricao",
                  "municipio_nome", "instrumento"]:
            hay = hay | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle)
        cond = cond & hay
    return records.filter(cond)


# --------------------------------------------------------------------------
# AGG-3..9 summaries
# --------------------------------------------------------------------------

def _measures():
    return [F.count_distinct(F.nullif(F.col("cnpj_14"), F.lit(""))).alias("total_empresas"),
            F.count(F.lit(1)).alias("total_projetos"),
            F.sum("total_aprovado_finep").cast(MONEY).alias("total_aprovado_finep"),
            F.sum("total_liberado").cast(MONEY).alias("total_liberado"),
            F.array_sort(F.collect_set("source")).alias("fontes")]


def _company_sums(records: DataFrame, *keys) -> DataFrame:
    """Records of equal ``keys``, company id and source as one row with their
    number and sums: hashed numbers only, so the distinct counts and sets of
    the summaries (which sort what they take) see a fraction of the rows."""
    return records.groupBy(*keys, "cnpj_14", "source").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("total_aprovado_finep").alias("total_aprovado_finep"),
        F.sum("total_liberado").alias("total_liberado"))


def _sum_measures():
    """``_measures`` of the rows of ``_company_sums``."""
    return [F.sum("_n").alias("total_projetos") if "total_projetos" in str(x) else x for x in _measures()]


def funding_by_state(records: DataFrame) -> DataFrame:
    """AGG-6: per state (``NA`` when missing)."""
    state = F.coalesce(F.nullif(F.col("uf"), F.lit("")), F.lit("NA")).alias("uf")
    return _company_sums(records, state).groupBy("uf").agg(*_sum_measures())


def funding_by_activity(records: DataFrame) -> DataFrame:
    """AGG-7: per (activity code, description) of the matched company; the
    NULL group is kept."""
    return records.groupBy(F.col("company_cnae_fiscal_principal").alias("cnae_fiscal_principal"),
                           F.col("company_cnae_descricao").alias("cnae_descricao")).agg(*_measures())


def funding_by_company(records: DataFrame) -> DataFrame:
    """AGG-5: per company id with descriptive attributes (state: the record
    value of the lexicographically first record, else the company's)."""
    r = records.filter(F.coalesce(F.col("cnpj_14"), F.lit("")) != "")
    attrs = ["razao_social", "nome_fantasia", "municipio_nome", "cnae_fiscal_principal", "cnae_descricao",
             "porte_empresa", "natureza_juridica", "natureza_juridica_descricao", "capital_social",
             "match_source"]
    aggs = [F.first(F.col("company_" + a), ignorenulls=True).alias(a) for a in attrs]
    state = F.coalesce(F.nullif(F.col("uf"), F.lit("")), F.col("company_uf"))
    # first record (by source id) that has a state
    aggs.append(F.min_by(state, F.when(state.isNotNull(), F.col("source_id"))).alias("uf"))
    m = [x for x in _measures() if "total_empresas" not in str(x)]
    return r.groupBy("cnpj_14").agg(*aggs, *m)


def resolve_geo(records: DataFrame, geo_muni: DataFrame) -> DataFrame:
    """JOIN-18 (name path): attach the national municipality by (state,
    accent-free upper name). The registry-code path cannot fire in the
    source platform (the company lookup does not carry that code), so it is
    not taken here either."""
    g = (geo_muni.select(F.col("uf").alias("_guf"), C.city_key("nome").alias("_gkey"),
                              F.col("codigo").alias("geo_codigo"), F.col("nome").alias("geo_nome"),
                              F.col("latitude").alias("geo_latitude"), F.col("longitude").alias("geo_longitude")))
    g = first_by(g, ["_guf", "_gkey"], [F.col("geo_codigo")])
    key = C.city_key(F.col("municipio_nome"))
    return (records.join(g, (F.col("uf") == F.col("_guf")) & (key == F.col("_gkey")), "left")
            .drop("_guf", "_gkey"))


def funding_by_municipality(records: DataFrame, geo_muni: DataFrame) -> DataFrame:
    """AGG-8: groups of (state, upper normalised name); geography attached
    when any record of the group resolves (lowest code wins)."""
    named = records.filter(F.coalesce(F.col("municipio_nome"), F.lit("")) != "")
    r = resolve_geo(_company_sums(named, "uf", "municipio_nome"), geo_muni)
    g = r.groupBy(F.col("uf").alias("_uf"), F.upper("municipio_nome").alias("_key")).agg(
        F.min("geo_codigo").alias("municipality_ibge_code"),
        F.min_by(F.struct("geo_nome", "geo_latitude", "geo_longitude"),
                 F.col("geo_codigo")).alias("_geo"),
        F.min("municipio_nome").alias("_name"),
        *_sum_measures())
    return g.select(
        F.coalesce(F.col("_geo.geo_nome"), F.col("_name")).alias("municipio_nome"),
        F.col("_uf").alias("uf"), "municipality_ibge_code",
        F.col("_geo.geo_latitude").alias("latitude"), F.col("_geo.geo_longitude").alias("longitude"),
        "total_empresas", "total_projetos", "total_aprovado_finep", "total_liberado", "fontes")


def gini(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """AGG-4 / UDF-2 / WIN-10: Gini of non-negative values per group (or
    overall), 6 dp; 0 when the group is empty or sums to zero.

    ``sum((2i - n - 1) * x) / (n * sum(x))`` with ``i`` the rank by value
    (ties do not change the sum). Equal values are counted first; the distinct
    values are dealt out by range, ranked within their range, and each range
    is moved up by the counts of the ranges below it (one summary row a range
    and group), so no task sorts a whole group."""
    from tessera.session import stage_table
    by = by or []
    d = (df.select(*by, F.col(value).alias("_x")).filter(F.col("_x").isNotNull() & (F.col("_x") >= 0))
         .groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c")))
    d = stage_table(d.repartitionByRange(*by, "_x").withColumn("_p", F.spark_partition_id()), "gini")
    ranges = d.groupBy(*by, "_p").agg(F.sum("_c").alias("_m"))
    below = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_p").alias("_q"),
                           F.coalesce(F.sum("_m").over(below), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_r", F.coalesce(F.sum("_c").over(within), F.lit(0)))
    on = [F.col("_p") == F.col("_q")] + [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    d = d.join(ranges, on)
    # twice the sum of the ranks of a value's rows, times the value
    ranks = (2 * (F.col("_base") + F.col("_r")) + F.col("_c") + 1) * F.col("_c")
    agg = [F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_x")).alias("_s"), F.sum(ranks * F.col("_x")).alias("_ix2")]
    g = d.groupBy(*by).agg(*agg) if by else d.agg(*agg)
    # sum((2i - n - 1) x) = 2 sum(i x) - (n + 1) sum(x)
    val = F.when((F.col("_n") == 0) | (F.col("_s") == 0) | F.col("_s").isNull(), F.lit(0.0)).otherwise(
        F.round((F.col("_ix2") - (F.col("_n") + 1) * F.col("_s")).cast("double")
                / (F.col("_n") * F.col("_s")).cast("double"), 6))
    return g.select(*by, F.coalesce(val, F.lit(0.0)).alias("gini"))


def funding_overview(records: DataFrame, by_municipality: DataFrame) -> DataFrame:
    """AGG-3: one-row overview. Mean ticket divides the approved total by
    the record count (0.00 when none)."""
    src = records.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    per_source = src.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))
                         .alias("projetos_por_fonte"))
    main = records.agg(
        F.count_distinct(F.nullif(F.col("cnpj_14"), F.lit(""))).alias("total_empresas"),
        F.count_distinct(F.nullif(F.col("uf"), F.lit(""))).alias("total_ufs"),
        F.count(F.lit(1)).alias("total_projetos"),
        F.coalesce(F.sum("total_aprovado_finep"), F.lit(0)).cast(MONEY).alias("total_aprovado_finep"),
        F.coalesce(F.sum("total_liberado"), F.lit(0)).cast(MONEY).alias("total_liberado"),
        F.array_sort(F.collect_set("source")).alias("fontes"))
    main = main.withColumn("ticket_medio_projeto", F.when(
        F.col("total_projetos") > 0,
        (F.col("total_aprovado_finep") / F.col("total_projetos")).cast(MONEY)).otherwise(
        F.lit(0).cast(MONEY)))
    muni = by_municipality.agg(F.count(F.lit(1)).alias("total_municipios"))
    g = gini(by_municipality, "total_liberado").withColumnRenamed("gini", "gini_liberado")
    return attach_scalars(attach_scalars(attach_scalars(main, muni), g), per_source)


def map_metadata(by_municipality: DataFrame) -> DataFrame:
    """AGG-9: features, municipalities with value, max approved."""
    return by_municipality.agg(
        F.count_if(F.col("municipality_ibge_code").isNotNull()).alias("features"),
        F.count_if(F.col("total_liberado") > 0).alias("municipios_com_valor"),
        F.max("total_aprovado_finep").alias("max_aprovado"))


# --------------------------------------------------------------------------
# AGG-19 / AGG-20 measures
# --------------------------------------------------------------------------

def release_ratio(by_company: DataFrame) -> DataFrame:
    """AGG-19: released / approved with bands (>= .7 high, >= .4 medium)."""
    ratio = F.when(F.col("total_aprovado_finep") > 0,
                   F.round(F.col("total_liberado").cast("double")
                           / F.col("total_aprovado_finep").cast("double"), 6)).otherwise(F.lit(0.0))
    return by_company.select("cnpj_14", ratio.alias("release_ratio")).withColumn(
        "band", F.when(F.col("release_ratio") >= 0.7, "high").when(F.col("release_ratio") >= 0.4, "medium")
        .otherwise("low"))


def share_of_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-19: value as a share of the maximum (bars)."""
    mx = df.agg(F.max(value).alias("_max"))
    out = attach_scalars(df.select(key, value), mx)
    return out.select(key, value, F.when(F.col("_max") > 0, F.round(
        F.col(value).cast("double") / F.col("_max").cast("double"), 6)).otherwise(F.lit(0.0)).alias("share"))


# fixed values: choropleth class thresholds (share of the maximum)
CHOROPLETH = [(0.8, 5), (0.55, 4), (0.3, 3), (0.12, 2)]


def choropleth_class(df: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-20: class 5..1 by share of the maximum; 0 for no value."""
    s = share_of_max(df, key, value)
    cls = F.when(F.col(value).isNull() | (F.col(value) <= 0), F.lit(0))
    for t, k in CHOROPLETH:
        cls = cls.when(F.col("share") >= t, F.lit(k))
    return s.withColumn("class", cls.otherwise(F.lit(1)))


# --------------------------------------------------------------------------
# JOIN-9 disbursement -> project; FLT-3 listing
# --------------------------------------------------------------------------

def disbursement_project(disb: DataFrame, projects: DataFrame | None, active: DataFrame,
                         inactive: DataFrame) -> DataFrame:
    """JOIN-9: disbursement ⟕ project on (contract, ref) null-safe; among
    duplicate project keys the last row of the sheet wins; project ⟕ company.
    A sheet without a project table (``projects`` None: decentralised credit)
    carries the proposer's id itself."""
    if projects is None:
        j = disb.withColumns({"id": F.lit(None).cast("string"), "titulo": F.lit(None).cast("string")})
    else:
        p = first_by(projects.select("contrato", "ref", "id", "titulo", "cnpj_proponente_norm", "row_no"),
                     ["contrato", "ref"], [F.col("row_no").desc(), F.col("id").desc()]).drop("row_no")
        p = p.withColumnRenamed("contrato", "_pc").withColumnRenamed("ref", "_pr")
        j = disb.join(p, (disb.contrato == p._pc) & disb.ref.eqNullSafe(p._pr), "left").drop("_pc", "_pr")
    comp = lookup_company(j.select(F.col("cnpj_proponente_norm").alias("cnpj_14")), active, inactive)
    comp = comp.select(F.col("cnpj_14").alias("_cid"), "razao_social", "match_source")
    return j.join(comp, F.col("cnpj_proponente_norm") == F.col("_cid"), "left").drop("_cid")


def list_funding(projects: DataFrame, q: str | None = None, fields: list[str] | None = None,
                 ref: str | None = None, uf: str | None = None, cnpj: str | None = None) -> DataFrame:
    """FLT-3: OR-contains over configured text fields, contract/ref
    contains, state (only where the table has it), id equal or prefix."""
    cond = F.lit(True)
    if q and fields:
        pat = "%" + q.strip() + "%"
        ors = F.lit(False)
        for f in fields:
            ors = ors | F.coalesce(F.col(f), F.lit("")).ilike(pat)
        cond = cond & ors
    if ref:
        pat = "%" + ref.strip() + "%"
        r = F.coalesce(F.col("contrato"), F.lit("")).ilike(pat)
        if "ref" in projects.columns:
            r = r | F.coalesce(F.col("ref"), F.lit("")).ilike(pat)
        cond = cond & r
    if uf and "uf" in projects.columns:
        cond = cond & (F.col("uf") == uf.strip().upper())
    digits = "".join(ch for ch in (cnpj or "") if ch.isdigit())
    if digits:
        n = F.coalesce(F.col("cnpj_proponente_norm"), F.lit(""))
        cond = cond & ((n == digits) if len(digits) == 14 else n.startswith(digits))
    return projects.filter(cond)
