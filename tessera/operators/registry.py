"""Company registry: cleaning jobs, search views, joins and aggregates.

Inputs are the raw positional text columns ``c0..cN`` of the monthly dumps
(see ``tessera.sources.readers``); outputs are typed DataFrames. Companies
and establishments join on ``cnpj_basico`` (sort-merge at scale); the
lookup dimensions are broadcast behind a size probe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.common import first_by, strip_accents_upper


def _raw_len(c: str):
    return F.length(C.strip_quotes(c))


def _nonblank_upper(c: str):
    return F.upper(C.clean_string(c))


# --------------------------------------------------------------------------
# PRJ-1..5 cleaning jobs
# --------------------------------------------------------------------------

def clean_companies(raw: DataFrame) -> DataFrame:
    """PRJ-1 (+FLT-2: raw id length = 8)."""
    return raw.filter(_raw_len("c0") == 8).select(
        C.padded("c0", 8).alias("cnpj_basico"),
        F.upper(C.strip_quotes("c1")).alias("razao_social"),
        F.nullif(C.try_int("c2"), F.lit(0)).alias("natureza_juridica"),
        C.padded_code("c3", 2).alias("qualificacao_responsavel"),
        C.clean_money("c4").alias("capital_social"),
        C.clean_size("c5").alias("porte_empresa"),
        C.clean_string("c6").alias("ente_federativo_responsavel"),
    )


def clean_establishments(raw: DataFrame) -> DataFrame:
    """PRJ-2: 30 columns, three dates, code padding, phones to INT."""
    return raw.filter(_raw_len("c0") == 8).select(
        C.padded("c0", 8).alias("cnpj_basico"),
        C.padded("c1", 4).alias("cnpj_ordem"),
        C.padded("c2", 2).alias("cnpj_dv"),
        C.try_int("c3").alias("identificador_matriz_filial"),
        _nonblank_upper("c4").alias("nome_fantasia"),
        C.padded_code("c5", 2).alias("situacao_cadastral"),
        C.clean_date("c6").alias("data_situacao_cadastral"),
        C.padded_code("c7", 2).alias("motivo_situacao_cadastral"),
        _nonblank_upper("c8").alias("nome_cidade_exterior"),
        C.padded_code("c9", 3).alias("codigo_pais"),
        C.clean_date("c10").alias("data_inicio_atividade"),
        C.padded_code("c11", 7).alias("cnae_fiscal_principal"),
        C.clean_string("c12").alias("cnae_fiscal_secundaria"),
        _nonblank_upper("c13").alias("tipo_logradouro"),
        _nonblank_upper("c14").alias("logradouro"),
        C.clean_string("c15").alias("numero"),
        _nonblank_upper("c16").alias("complemento"),
        _nonblank_upper("c17").alias("bairro"),
        F.when(F.length(C.strip_quotes("c18")) > 0, C.padded("c18", 8)).alias("cep"),
        C.clean_string("c19").alias("uf"),
        C.padded_code("c20", 4).alias("codigo_municipio"),
        C.clean_string("c21").alias("ddd_1"),
        F.nullif(C.try_int("c22"), F.lit(0)).alias("telefone_1"),
        C.clean_string("c23").alias("ddd_2"),
        F.nullif(C.try_int("c24"), F.lit(0)).alias("telefone_2"),
        C.clean_string("c25").alias("ddd_fax"),
        F.nullif(C.try_int("c26"), F.lit(0)).alias("fax"),
        F.lower(C.clean_string("c27")).alias("correio_eletronico"),
        _nonblank_upper("c28").alias("situacao_especial"),
        C.clean_date("c29").alias("data_situacao_especial"),
    )


def clean_partners(raw: DataFrame) -> DataFrame:
    """PRJ-3: 11 columns."""
    return raw.filter(_raw_len("c0") == 8).select(
        C.padded("c0", 8).alias("cnpj_basico"),
        C.try_int("c1").alias("identificador_socio"),
        _nonblank_upper("c2").alias("nome_socio_razao_social"),
        C.clean_string("c3").alias("cpf_cnpj_socio"),
        C.padded_code("c4", 2).alias("qualificacao_socio"),
        C.clean_date_strict("c5").alias("data_entrada_sociedade"),
        C.padded_code("c6", 3).alias("pais"),
        C.clean_string("c7").alias("representante_legal"),
        _nonblank_upper("c8").alias("nome_do_representante"),
        C.padded_code("c9", 2).alias("qualificacao_representante_legal"),
        C.try_int("c10").alias("faixa_etaria"),
    )


def clean_tax_regime(raw: DataFrame) -> DataFrame:
    """PRJ-4: S/N -> BOOLEAN, four dates; raw id length >= 6."""
    return raw.filter(_raw_len("c0") >= 6).select(
        C.padded("c0", 8).alias("cnpj_basico"),
        C.s_n("c1").alias("optante_simples_nacional"),
        C.clean_date_strict("c2").alias("data_optante_simples_nacional"),
        C.clean_date_strict("c3").alias("data_exclusao_simples_nacional"),
        C.s_n("c4").alias("opcao_mei"),
        C.clean_date_strict("c5").alias("data_opcao_mei"),
        C.clean_date_strict("c6").alias("data_exclusao_mei"),
    )


# fixed values: key rule and output names per lookup kind
LOOKUP_LAYOUT = {
    # kind: (key rule, key name, label name)
    "cnaes": ("text", "cnae_fiscal", "descricao"),
    "motivos": (2, "codigo", "descricao"),
    "municipios": (4, "codigo", "nome"),
    "naturezas": ("int", "codigo", "descricao"),
    "paises": (3, "codigo", "nome"),
    "qualificacoes": (2, "codigo", "descricao"),
}


def clean_lookup(raw: DataFrame, kind: str) -> DataFrame:
    """PRJ-5: key padding by kind (none / 2 / 3 / 4 / INT), renamed."""
    rule, key_name, label_name = LOOKUP_LAYOUT[kind]
    if rule == "text":
        key = C.strip_quotes("c0")
    elif rule == "int":
        key = C.try_int("c0")
    else:
        key = C.padded("c0", rule)
    return raw.filter(_raw_len("c0") > 0).select(
        key.alias(key_name), C.strip_quotes("c1").alias(label_name))


# --------------------------------------------------------------------------
# JOIN-1/2 search views, JOIN-3 full establishment
# --------------------------------------------------------------------------

SEARCH_VIEW_COLUMNS = [
    "cnpj_basico", "razao_social", "nome_fantasia", "cnpj_ordem", "cnpj_dv", "cnpj_14",
    "situacao_cadastral", "codigo_municipio", "municipio_nome", "uf", "cnae_fiscal_principal",
    "cnae_descricao", "porte_empresa", "natureza_juridica", "natureza_juridica_descricao",
    "capital_social", "data_inicio_atividade", "correio_eletronico", "reference_month",
]


def _search_view(companies: DataFrame, establishments: DataFrame, municipios: DataFrame,
                 cnaes: DataFrame, naturezas: DataFrame, active: bool | None) -> DataFrame:
    status = F.col("situacao_cadastral")
    # NULL status is in neither view: plain three-valued comparisons.
    # active=None: both views in one pass (status present).
    keep = status.isNotNull() if active is None else ((status == "02") if active else (status != "02"))
    est = establishments.filter((F.col("identificador_matriz_filial") == 1) & keep)
    est = est.select("cnpj_basico", "nome_fantasia", "cnpj_ordem", "cnpj_dv", "situacao_cadastral",
                     "codigo_municipio", "uf", "cnae_fiscal_principal", "data_inicio_atividade",
                     "correio_eletronico")
    emp = companies.select("cnpj_basico", "razao_social", "porte_empresa", "natureza_juridica",
                           "capital_social", "reference_month")
    m = (municipios.select(F.col("codigo").alias("codigo_municipio"),
                                F.col("nome").alias("municipio_nome")))
    c = (cnaes.select(F.col("cnae_fiscal").alias("cnae_fiscal_principal"),
                           F.col("descricao").alias("cnae_descricao")))
    n = (naturezas.select(F.col("codigo").alias("natureza_juridica"),
                               F.col("descricao").alias("natureza_juridica_descricao")))
    out = (emp.join(est, "cnpj_basico", "inner")
           .join(m, "codigo_municipio", "left")
           .join(c, "cnae_fiscal_principal", "left")
           .join(n, "natureza_juridica", "left")
           .withColumn("cnpj_14", F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv")))
    return out.select(*SEARCH_VIEW_COLUMNS)


def search_view_active(companies, establishments, municipios, cnaes, naturezas) -> DataFrame:
    """JOIN-1: companies with an active (status 02) head office."""
    return _search_view(companies, establishments, municipios, cnaes, naturezas, True)


def search_view_inactive(companies, establishments, municipios, cnaes, naturezas) -> DataFrame:
    """JOIN-2: head office status present and not 02."""
    return _search_view(companies, establishments, municipios, cnaes, naturezas, False)


def search_view_tiered(companies, establishments, municipios, cnaes, naturezas) -> DataFrame:
    """Both search views from one join: every head office with a status,
    tagged ``match_source`` (active / inactive) and ``_tier`` (0 / 1).
    Equal to ``active ∪ inactive`` with the tags, at the cost of one view."""
    v = _search_view(companies, establishments, municipios, cnaes, naturezas, None)
    act = F.col("situacao_cadastral") == "02"
    return (v.withColumn("match_source", F.when(act, F.lit("active")).otherwise(F.lit("inactive")))
            .withColumn("_tier", F.when(act, F.lit(0)).otherwise(F.lit(1))))


def establishment_full(establishments: DataFrame, companies: DataFrame) -> DataFrame:
    """JOIN-3: establishment with its 14-digit id and company attributes."""
    emp = companies.select("cnpj_basico", "razao_social", "capital_social", "porte_empresa")
    return (establishments.join(emp, "cnpj_basico", "left")
            .withColumn("cnpj_completo", F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv")))


# --------------------------------------------------------------------------
# AGG-1, JOIN-4, JOIN-5 company profile parts
# --------------------------------------------------------------------------

def establishment_stats(establishments: DataFrame) -> DataFrame:
    """AGG-1: establishments per company, total and active."""
    return establishments.groupBy("cnpj_basico").agg(
        F.count(F.lit(1)).alias("total_estabelecimentos"),
        F.count_if(F.col("situacao_cadastral") == "02").alias("estabelecimentos_ativos"))


def company_header(companies: DataFrame, establishments: DataFrame, naturezas: DataFrame,
                   qualificacoes: DataFrame) -> DataFrame:
    """JOIN-4: company header with descriptions and establishment counts."""
    stats = establishment_stats(establishments)
    nat = (naturezas.select(F.col("codigo").alias("natureza_juridica"),
                                 F.col("descricao").alias("natureza_juridica_descricao")))
    qual = (qualificacoes.select(F.col("codigo").alias("qualificacao_responsavel"),
                                      F.col("descricao").alias("qualificacao_responsavel_descricao")))
    return (companies.join(nat, "natureza_juridica", "left")
            .join(qual, "qualificacao_responsavel", "left")
            .join(stats, "cnpj_basico", "left")
            .select("cnpj_basico", "razao_social", "natureza_juridica", "natureza_juridica_descricao",
                    "qualificacao_responsavel", "qualificacao_responsavel_descricao", "capital_social",
                    "porte_empresa", "ente_federativo_responsavel",
                    F.coalesce("total_estabelecimentos", F.lit(0)).alias("total_estabelecimentos"),
                    F.coalesce("estabelecimentos_ativos", F.lit(0)).alias("estabelecimentos_ativos")))


def establishment_detail(establishments: DataFrame, cnaes: DataFrame, motivos: DataFrame,
                         paises: DataFrame, municipios: DataFrame) -> DataFrame:
    """JOIN-5: establishments with activity, reason, country and town names,
    formatted id and phone."""
    c = (cnaes.select(F.col("cnae_fiscal").alias("cnae_fiscal_principal"),
                           F.col("descricao").alias("cnae_descricao")))
    mo = (motivos.select(F.col("codigo").alias("motivo_situacao_cadastral"),
                              F.col("descricao").alias("motivo_descricao")))
    p = (paises.select(F.col("codigo").alias("codigo_pais"), F.col("nome").alias("pais_nome")))
    m = (municipios.select(F.col("codigo").alias("codigo_municipio"),
                                F.col("nome").alias("municipio_nome")))
    return (establishments.join(c, "cnae_fiscal_principal", "left")
            .join(mo, "motivo_situacao_cadastral", "left")
            .join(p, "codigo_pais", "left")
            .join(m, "codigo_municipio", "left")
            .select("cnpj_basico", "cnpj_ordem", "cnpj_dv",
                    C.format_id_parts("cnpj_basico", "cnpj_ordem", "cnpj_dv").alias("cnpj_formatado"),
                    "identificador_matriz_filial", "nome_fantasia", "situacao_cadastral",
                    "motivo_situacao_cadastral", "motivo_descricao", "codigo_pais", "pais_nome",
                    "cnae_fiscal_principal", "cnae_descricao", "codigo_municipio", "municipio_nome",
                    "uf", C.format_phone("ddd_1", "telefone_1").alias("telefone_1_formatado")))


def company_profile(companies: DataFrame, establishments: DataFrame) -> DataFrame:
    """PRJ-29: company header + sorted array of establishment structs, in
    numbered chunks by the first digit of the branch number: a chunk holds at
    most a thousand branches, so a company of any size is several rows and
    keys. A company without branches is chunk 0 with none."""
    est = establishments.select(
        "cnpj_basico",
        F.struct("cnpj_ordem", "cnpj_dv", "identificador_matriz_filial", "nome_fantasia",
                 "situacao_cadastral",
                 F.struct("logradouro", "numero", "bairro", "cep", "uf", "codigo_municipio").alias("endereco"),
                 F.struct("ddd_1", "telefone_1", "correio_eletronico").alias("contato")).alias("e"))
    chunk = F.coalesce(F.left(F.col("e.cnpj_ordem"), F.lit(1)).try_cast("int"), F.lit(0)).alias("chunk")
    grouped = est.groupBy("cnpj_basico", chunk).agg(F.array_sort(F.collect_list("e")).alias("estabelecimentos"))
    return companies.select("cnpj_basico", "razao_social", "capital_social", "porte_empresa") \
        .join(grouped, "cnpj_basico", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))


def with_full_id(df: DataFrame) -> DataFrame:
    """PRJ-30: 14-digit and formatted ids."""
    full = F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv")
    return df.withColumn("cnpj_14", full).withColumn("cnpj_formatado", C.format_id(full))


# fixed values: code -> label maps of the company profile
SIZE_LABELS = {"00": "Não informado", "01": "Micro empresa", "03": "Empresa de pequeno porte",
               "05": "Demais"}
HQ_LABELS = {1: "Matriz", 2: "Filial"}
STATUS_LABELS = {"01": "Nula", "02": "Ativa", "03": "Suspensa", "04": "Inapta", "08": "Baixada"}


def _label(c, mapping):
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[c]


def decode_labels(df: DataFrame) -> DataFrame:
    """PRJ-28: size / HQ-branch / status labels via literal maps."""
    out = df
    if "porte_empresa" in df.columns:
        out = out.withColumn("porte_empresa_descricao", _label(F.col("porte_empresa"), SIZE_LABELS))
    if "identificador_matriz_filial" in df.columns:
        out = out.withColumn("matriz_filial_descricao",
                             _label(F.col("identificador_matriz_filial"), HQ_LABELS))
    if "situacao_cadastral" in df.columns:
        out = out.withColumn("situacao_cadastral_descricao",
                             _label(F.col("situacao_cadastral"), STATUS_LABELS))
    return out


# --------------------------------------------------------------------------
# FLT-1 company search, FLT-12 / AGG-2 person search, JOIN-6 person detail
# --------------------------------------------------------------------------

def search_companies(view: DataFrame, q: str | None = None, uf: str | None = None,
                     city: str | None = None, cnae: str | None = None) -> DataFrame:
    """FLT-1: the company search predicate, decided on the driver from the
    arguments, evaluated as native predicates on the executors."""
    cond = F.lit(True)
    if q:
        digits = "".join(ch for ch in q if ch.isdigit())
        if digits and all(ch.isdigit() for ch in q.replace(".", "").replace("/", "").replace("-", "")):
            if len(digits) == 14:
                cond = cond & (F.col("cnpj_14") == digits)
            elif len(digits) >= 9:
                cond = cond & F.col("cnpj_14").startswith(digits)
            else:
                cond = cond & F.col("cnpj_basico").startswith(digits[:8])
        else:
            pat = "%" + strip_accents_upper(q) + "%"
            cond = cond & (F.col("razao_social").ilike(pat)
                           | F.coalesce(F.col("nome_fantasia"), F.lit("")).ilike(pat))
    if uf:
        cond = cond & (F.col("uf") == uf.strip().upper())
    if city:
        cond = cond & F.col("municipio_nome").ilike("%" + city.strip() + "%")
    if cnae and cnae.isdigit():
        cond = cond & (F.col("cnae_fiscal_principal") == cnae)
    return view.filter(cond)


def person_company_counts(partners: DataFrame, q: str | None = None) -> DataFrame:
    """AGG-2 / FLT-12: people (kinds 2, 3) grouped by (name, mask, age band)
    with the number of distinct companies; optional accent-stripped name
    filter (>= 3 chars)."""
    p = partners.filter(F.col("identificador_socio").isin(2, 3))
    if q is not None:
        if len(q.strip()) < 3:
            raise ValueError("person search needs at least 3 characters")
        p = p.filter(F.col("nome_socio_razao_social").ilike("%" + strip_accents_upper(q) + "%"))
    return p.groupBy(F.col("nome_socio_razao_social").alias("nome"), "cpf_cnpj_socio", "faixa_etaria") \
        .agg(F.countDistinct("cnpj_basico").alias("total_empresas"))


def person_detail(partners: DataFrame, companies: DataFrame, establishments: DataFrame,
                  qualificacoes: DataFrame, municipios: DataFrame) -> DataFrame:
    """JOIN-6 + WIN-8: for every person (name, mask) of kind 2/3, one row per
    company: latest month first, then entry date and role as tiebreaks."""
    p = partners.filter(F.col("identificador_socio").isin(2, 3))
    emp = companies.select("cnpj_basico", "razao_social")
    hq = establishments.filter(F.col("identificador_matriz_filial") == 1).select(
        "cnpj_basico", "situacao_cadastral", "uf", "codigo_municipio")
    q = (qualificacoes.select(F.col("codigo").alias("qualificacao_socio"),
                                   F.col("descricao").alias("qualificacao_socio_descricao")))
    m = (municipios.select(F.col("codigo").alias("codigo_municipio"),
                                F.col("nome").alias("municipio_nome")))
    rows = (p.join(emp, "cnpj_basico", "inner")
            .join(q, "qualificacao_socio", "left")
            .join(hq, "cnpj_basico", "left")
            .join(m, "codigo_municipio", "left"))
    first = first_by(rows, ["nome_socio_razao_social", "cpf_cnpj_socio", "cnpj_basico"],
                     [F.col("reference_month").desc(), F.col("data_entrada_sociedade").asc_nulls_last(),
                      F.col("qualificacao_socio").asc_nulls_last(), F.col("uf").asc_nulls_last(),
                      F.col("situacao_cadastral").asc_nulls_last()])
    return first.select(F.col("nome_socio_razao_social").alias("nome"), "cpf_cnpj_socio",
                        "faixa_etaria", "cnpj_basico", "razao_social", "qualificacao_socio",
                        "qualificacao_socio_descricao", "data_entrada_sociedade",
                        "situacao_cadastral", "uf", "municipio_nome", "reference_month")


# --------------------------------------------------------------------------
# JOIN-11 stubs, SET-2 unified search, WIN-7
# --------------------------------------------------------------------------

STUB_NAME = "EMPRESA NAO ENCONTRADA NA BASE"


def stub_companies(children: DataFrame, companies: DataFrame, month: str) -> DataFrame:
    """JOIN-11: company roots referenced by child rows but missing from the
    company table, as stub company rows."""
    roots = children.select("cnpj_basico").distinct()
    missing = roots.join(companies.select("cnpj_basico"), "cnpj_basico", "left_anti")
    return missing.select(
        "cnpj_basico", F.lit(STUB_NAME).alias("razao_social"),
        F.lit(month).alias("reference_month"))


# fixed values: columns of a search hit, in order
SEARCH_COLUMNS = [
    "cnpj_14", "cnpj_basico", "razao_social", "nome_fantasia", "situacao_cadastral", "codigo_municipio",
    "municipio_nome", "uf", "cnae_fiscal_principal", "cnae_descricao", "porte_empresa", "natureza_juridica",
    "natureza_juridica_descricao", "capital_social", "data_inicio_atividade", "correio_eletronico", "reference_month"]


def unified_search(active: DataFrame, inactive: DataFrame, q: str, k: int = 20) -> DataFrame:
    """SET-2 + FLT-10 + WIN-7: active and inactive views unioned, one row per
    14-digit id (active first), first ``k`` by id, all view columns and where
    the match came from.

    From 14 digits on the exact id or its root matches, from 8 on the root
    (first 8) or the id's prefix, below that either prefix. Text matches the
    names without accents; an empty query matches everything."""
    digits = "".join(ch for ch in q if ch in "0123456789")
    text = strip_accents_upper(q)
    tests = []
    if len(digits) >= 14:
        tests += [F.col("cnpj_14") == digits[:14], F.col("cnpj_basico") == digits[:8]]
    elif len(digits) >= 8:
        tests += [F.col("cnpj_14").startswith(digits), F.col("cnpj_basico") == digits[:8]]
    elif digits:
        tests += [F.col("cnpj_14").startswith(digits), F.col("cnpj_basico").startswith(digits)]
    if text:
        tests += [F.col("razao_social").ilike(f"%{text}%"), F.coalesce(F.col("nome_fantasia"), F.lit("")).ilike(f"%{text}%")]
    cond = reduce(lambda x, y: x | y, tests) if tests else F.lit(True)
    both = (active.filter(cond).select(*SEARCH_COLUMNS, F.lit("active").alias("match_source"))
            .unionByName(inactive.filter(cond).select(*SEARCH_COLUMNS, F.lit("inactive").alias("match_source"))))
    return first_by(both, ["cnpj_14"], [F.col("match_source")]).orderBy("cnpj_14").limit(k)
