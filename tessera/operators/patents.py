"""Patents: ten table loaders, referential filters, search view, summary,
filters and sub-table listings.

Keys are integer ``codigo_interno`` (plus ``ordem`` for child tables).
Duplicate keys keep the first row in file order (``_row``); children whose
patent is missing are dropped with a semi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.common import first_by


def _code(c="codigo_interno"):
    return C.to_int_trunc(F.col(c), "bigint")


def _ordem():
    return C.to_int_trunc(F.col("ordem"), "int")


def first_by_key(df: DataFrame, keys: list[str], order: str = "_row") -> DataFrame:
    """WIN-9: first row per key in file order."""
    return first_by(df.filter(F.col(keys[0]).isNotNull()), keys, [F.col(order)]).drop(order)


def with_parent(child: DataFrame, parent: DataFrame, key: str = "codigo_interno",
                parent_key: str = "codigo_interno") -> DataFrame:
    """JOIN-12: keep child rows whose key exists in the parent (semi join)."""
    p = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.join(p, key, "left_semi")


def clean_patents(raw: DataFrame, snapshot_date: str) -> DataFrame:
    """PRJ-6: integer key, type prefix, five day-first dates, secrecy flag,
    snapshot date; duplicate keys keep the first row."""
    df = raw.select(
        "_row", _code().alias("codigo_interno"), C.norm("numero_inpi").alias("numero_inpi"),
        C.patent_type(F.col("numero_inpi")).alias("tipo_patente"),
        C.date_dayfirst("data_deposito").alias("data_deposito"),
        C.date_dayfirst("data_protocolo").alias("data_protocolo"),
        C.date_dayfirst("data_publicacao").alias("data_publicacao"),
        C.norm("numero_pct").alias("numero_pct"), C.norm("numero_wo").alias("numero_wo"),
        C.date_dayfirst("data_publicacao_wo").alias("data_publicacao_wo"),
        C.date_dayfirst("data_entrada_fase_nacional").alias("data_entrada_fase_nacional"),
        C.secrecy("sigilo").alias("sigilo"),
        F.lit(snapshot_date).cast("date").alias("snapshot_date"))
    return first_by_key(df, ["codigo_interno"])


def clean_patent_content(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """PRJ-7: title and abstract; patent must exist."""
    df = raw.select("_row", _code().alias("codigo_interno"), C.norm("titulo").alias("titulo"),
                    C.norm("resumo").alias("resumo"))
    return with_parent(first_by_key(df, ["codigo_interno"]), patents)


def clean_inventors(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """PRJ-8."""
    df = raw.select("_row", _code().alias("codigo_interno"), _ordem().alias("ordem"),
                    C.norm("autor").alias("autor"), C.norm("pais").alias("pais"),
                    C.norm("estado").alias("estado"))
    return with_parent(first_by_key(df, ["codigo_interno", "ordem"]), patents)


def clean_depositors(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """PRJ-9: depositors with the company root resolved (FN-20)."""
    df = raw.select("_row", _code().alias("codigo_interno"), _ordem().alias("ordem"),
                    C.norm("depositante").alias("depositante"),
                    C.norm("cgccpfdepositante").alias("cgccpfdepositante"),
                    C.norm("tipopessoadepositante").alias("tipopessoadepositante"),
                    C.norm("pais").alias("pais"), C.norm("uf").alias("uf"),
                    C.date_dayfirst("data_inicio_depositante").alias("data_inicio"),
                    C.date_dayfirst("data_fim_depositante").alias("data_fim"))
    df = df.withColumn("cnpj_basico_resolved",
                       C.resolve_root(F.col("cgccpfdepositante"), F.col("tipopessoadepositante")))
    return with_parent(first_by_key(df, ["codigo_interno", "ordem"]), patents)


def clean_ipc(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """PRJ-10."""
    df = raw.select("_row", _code().alias("codigo_interno"), _ordem().alias("ordem"),
                    C.norm("simbolo").alias("simbolo"), C.norm("versao").alias("versao"))
    return with_parent(first_by_key(df, ["codigo_interno", "ordem"]), patents)


def clean_dispatches(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """PRJ-11: surrogate key = hash of the row's content and file position."""
    df = raw.select("_row", _code().alias("codigo_interno"), C.to_int_trunc(F.col("numero_rpi"), "int")
                    .alias("numero_rpi"), C.date_dayfirst("data_rpi").alias("data_rpi"),
                    C.norm("codigo_despacho").alias("codigo_despacho"),
                    C.norm("complemento").alias("complemento"))
    df = df.filter(F.col("codigo_interno").isNotNull()).withColumn("id", F.col("_row")).drop("_row")
    return with_parent(df, patents)


def clean_attorneys(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """PRJ-12: attorneys with company root resolved. A patent may have any
    number of them: every row is kept under its file position as key."""
    df = raw.select(F.col("_row").alias("id"), _code().alias("codigo_interno"), C.norm("procurador").alias("procurador"),
                    C.norm("cgccpfprocurador").alias("cgccpfprocurador"),
                    C.norm("tipopessoaprocurador").alias("tipopessoaprocurador"),
                    C.date_dayfirst("data_inicio_procurador").alias("data_inicio"))
    df = df.filter(F.col("codigo_interno").isNotNull()).withColumn(
        "cnpj_basico_resolved", C.resolve_root(F.col("cgccpfprocurador"), F.col("tipopessoaprocurador")))
    return with_parent(df, patents)


def clean_priorities(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """PRJ-13: priority claims, one per patent, country and number (rows
    without a country or number are blank lines)."""
    df = raw.select("_row", _code().alias("codigo_interno"), C.norm("pais_prioridade").alias("pais_prioridade"),
                    C.norm("numero_prioridade").alias("numero_prioridade"),
                    C.date_dayfirst("data_prioridade").alias("data_prioridade"))
    df = df.filter(F.col("numero_prioridade").isNotNull() & F.col("pais_prioridade").isNotNull())
    return with_parent(first_by_key(df, ["codigo_interno", "pais_prioridade", "numero_prioridade"]), patents)


def clean_links(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """PRJ-14: one link per pair of patents and type; both ends must exist."""
    df = raw.select("_row", _code().alias("codigo_interno"),
                    _code("codigo_interno_vinculado").alias("codigo_interno_vinculado"),
                    C.norm("tipo_vinculo").alias("tipo_vinculo"), C.date_dayfirst("data_vinculo").alias("data_vinculo"))
    df = first_by_key(df, ["codigo_interno", "codigo_interno_vinculado", "tipo_vinculo"])
    df = with_parent(df, patents)
    return with_parent(df, patents, key="codigo_interno_vinculado")


def clean_renumberings(raw: DataFrame, patents: DataFrame) -> DataFrame:
    """PRJ-15: original number required."""
    df = raw.select("_row", _code().alias("codigo_interno"), C.norm("numero_original").alias("numero_original"))
    df = df.filter(F.col("numero_original").isNotNull())
    return with_parent(first_by_key(df, ["codigo_interno", "numero_original"]), patents)


# --------------------------------------------------------------------------
# JOIN-10 search view, FLT-5 filters, AGG-10 summary
# --------------------------------------------------------------------------

def patent_search_view(patents, content, inventors, depositors, ipc) -> DataFrame:
    """JOIN-10: bibliography ⟕ content ⟕ first inventor ⟕ first depositor ⟕
    first IPC (``ordem = 1``); all joins on ``codigo_interno``."""
    inv = inventors.filter(F.col("ordem") == 1).select(
        "codigo_interno", F.col("autor").alias("inventor_principal"), F.col("pais").alias("inventor_pais"))
    dep = depositors.filter(F.col("ordem") == 1).select(
        "codigo_interno", F.col("depositante").alias("depositante_principal"),
        F.col("tipopessoadepositante").alias("depositante_tipo"),
        F.col("cnpj_basico_resolved").alias("depositante_cnpj_basico"))
    ip = ipc.filter(F.col("ordem") == 1).select(
        "codigo_interno", F.col("simbolo").alias("ipc_principal"),
        F.left(F.col("simbolo"), F.lit(4)).alias("ipc_secao_classe"))
    return (patents.select("codigo_interno", "numero_inpi", "tipo_patente", "data_deposito", "data_publicacao",
                           "sigilo", "snapshot_date")
            .join(content.select("codigo_interno", "titulo"), "codigo_interno", "left")
            .join(inv, "codigo_interno", "left").join(dep, "codigo_interno", "left")
            .join(ip, "codigo_interno", "left"))


def filter_patents(view: DataFrame, q=None, tipo=None, ipc=None, cnpj=None, numero=None,
                   date_min=None, date_max=None, sigilo=None) -> DataFrame:
    """FLT-5: the patent search predicate."""
    cond = F.lit(True)
    if q:
        pat = "%" + q.strip() + "%"
        cond = cond & (F.col("titulo").ilike(pat) | F.col("depositante_principal").ilike(pat)
                       | F.col("inventor_principal").ilike(pat))
    if tipo:
        cond = cond & (F.col("tipo_patente") == tipo.strip().upper())
    if ipc:
        cond = cond & F.col("ipc_secao_classe").ilike(ipc.strip().upper() + "%")
    if cnpj:
        digits = "".join(ch for ch in cnpj if ch.isdigit())
        if len(digits) >= 8:
            cond = cond & (F.col("depositante_cnpj_basico") == digits[:8])
    if numero:
        cond = cond & (F.col("numero_inpi") == numero.strip())
    if date_min:
        cond = cond & (F.col("data_deposito") >= F.lit(date_min.strip()).cast("date"))
    if date_max:
        cond = cond & (F.col("data_deposito") <= F.lit(date_max.strip()).cast("date"))
    s = (sigilo or "").strip().lower()
    if s in {"true", "1", "yes"}:
        cond = cond & (F.col("sigilo") == True)  # noqa: E712
    elif s in {"false", "0", "no"}:
        cond = cond & (F.col("sigilo") == False)  # noqa: E712
    return view.filter(cond)


def patents_by_type(view: DataFrame) -> DataFrame:
    return view.groupBy("tipo_patente").agg(F.count("codigo_interno").alias("total"))


def patents_by_ipc(view: DataFrame, ipc_dim: DataFrame, k: int = 50) -> DataFrame:
    """AGG-10 + JOIN-22: top-k IPC groups with the dimension title."""
    g = (view.filter(F.col("ipc_secao_classe").isNotNull()).groupBy("ipc_secao_classe")
         .agg(F.count("codigo_interno").alias("total")))
    top = g.orderBy(F.col("total").desc(), F.col("ipc_secao_classe")).limit(k)
    dim = (ipc_dim.select(F.col("simbolo").alias("ipc_secao_classe"), "titulo_en"))
    return top.join(dim, "ipc_secao_classe", "left")


def patents_by_year(view: DataFrame) -> DataFrame:
    return (view.filter(F.col("data_deposito").isNotNull())
            .groupBy(F.year("data_deposito").alias("ano")).agg(F.count("codigo_interno").alias("total")))


def patents_total(view: DataFrame) -> DataFrame:
    return view.agg(F.count(F.lit(1)).alias("total_patentes"),
                    F.max("snapshot_date").alias("snapshot_date"))


# --------------------------------------------------------------------------
# FLT-6 sub-table listings
# --------------------------------------------------------------------------

# fixed values: per sub-table text fields and order
SUBTABLES = {
    "inventores": (["autor"], ["codigo_interno", "ordem"]),
    "depositantes": (["depositante"], ["codigo_interno", "ordem"]),
    "ipc": (["simbolo"], ["codigo_interno", "ordem"]),
    "despachos": (["codigo_despacho", "complemento"], ["data_rpi", "id"]),
    "procuradores": (["procurador"], ["codigo_interno", "id"]),
    "prioridades": (["numero_prioridade", "pais_prioridade"], ["codigo_interno", "pais_prioridade", "numero_prioridade"]),
    "vinculos": (["tipo_vinculo"], ["codigo_interno", "codigo_interno_vinculado", "tipo_vinculo"]),
    "renumeracoes": (["numero_original"], ["codigo_interno", "numero_original"]),
    "ipc_ref": (["simbolo", "titulo_en"], ["simbolo"]),
}


def list_patent_part(df: DataFrame, kind: str, q: str | None = None, codigo: int | None = None,
                     date_min: str | None = None, date_max: str | None = None) -> DataFrame:
    """FLT-6: one listing function for the nine sub-tables, in their order."""
    fields, order = SUBTABLES[kind]
    cond = F.lit(True)
    if q:
        ors = F.lit(False)
        for f in fields:
            ors = ors | F.coalesce(F.col(f), F.lit("")).ilike("%" + q.strip() + "%")
        cond = cond & ors
    if codigo is not None and "codigo_interno" in df.columns:
        cond = cond & (F.col("codigo_interno") == codigo)
    if date_min and kind == "despachos":
        cond = cond & (F.col("data_rpi") >= F.lit(date_min).cast("date"))
    if date_max and kind == "despachos":
        cond = cond & (F.col("data_rpi") <= F.lit(date_max).cast("date"))
    return df.filter(cond).orderBy(*order)
