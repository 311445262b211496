"""Stand-in inputs built from the driver's test tables.

The registry, funding, patent, organization and geography inputs of the
source platform are not available here, so each is shaped from the TPC-H-ish
tables (``customer`` -> companies, ``orders`` -> establishments,
``lineitem`` -> partners and funding rows, ``part`` -> patents, ``events``
-> organization snapshots and manifests, ``nation``/``region`` -> lookups
and geography). Every proxy is a plain projection/join of whole tables: no
row is sampled away, dirt is injected by key arithmetic so that the cleaning
jobs have work to do. The oracle module builds the same proxies in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: state code per region key of the proxy geography
REGION_UF = {0: "SP", 1: "RJ", 2: "MG", 3: "RS", 4: "BA"}
# fixed values: state name per state code
UF_NAME = {"SP": "São Paulo", "RJ": "Rio de Janeiro", "MG": "Minas Gerais",
           "RS": "Rio Grande do Sul", "BA": "Bahia"}
# fixed values: two-digit national state code per state code
UF_CODE = {"SP": "35", "RJ": "33", "MG": "31", "RS": "43", "BA": "29"}

DEFAULT_MONTH = "2024-01"
NBSP = "\u00a0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _uf_of_region(c):
    expr = None
    for k, v in REGION_UF.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def _s(c):
    return c.cast("string")


def _ymd(c):
    return F.date_format(c, "yyyyMMdd")


def br_money(c):
    """Double -> Brazilian money text ('1.234,56')."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


# --------------------------------------------------------------------------
# registry
# --------------------------------------------------------------------------

def raw_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit(' "'), F.when(k % 17 == 0, _s(k)).otherwise(F.lpad(_s(k), 8, "0")),
                 F.lit('" ')).alias("c0"),
        F.concat(F.lit(" "), F.col("c_name"), F.when(k % 7 == 0, F.lit(NBSP)).otherwise(F.lit("")),
                 F.lit(" ")).alias("c1"),
        F.when(k % 11 == 0, F.lit("x")).otherwise(_s(F.col("c_nationkey"))).alias("c2"),
        _s((k % 4) * 5).alias("c3"),
        F.when(k % 13 == 0, F.lit("")).otherwise(br_money(F.col("c_acctbal"))).alias("c4"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("1"))
         .when(F.col("c_mktsegment") == "MACHINERY", F.lit("3"))
         .when(F.col("c_mktsegment") == "FURNITURE", F.lit("05"))
         .when(F.col("c_mktsegment") == "BUILDING", F.lit(""))
         .otherwise(F.lit("99")).alias("c5"),
        F.when(k % 3 == 0, F.lit("UNIAO")).otherwise(F.lit("")).alias("c6"),
    )


def _dv_sql_free(base12):
    # the proxy's check digits use the engine's own column function
    from tessera.functions.columns import check_digits
    return check_digits(base12)


def raw_estab(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    df = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
          .withColumn("rn", F.row_number().over(w)))
    k, cust, rn = F.col("o_orderkey"), F.col("o_custkey"), F.col("rn")
    base = F.concat(F.lpad(_s(cust), 8, "0"), F.lpad(_s(rn), 4, "0"))
    dv = _dv_sql_free(base)
    bad = F.lpad(_s((dv.cast("int") + 1) % 100), 2, "0")
    e = F.lit("")
    return df.select(
        F.concat(F.lit('"'), F.lpad(_s(cust), 8, "0"), F.lit('"')).alias("c0"),
        _s(rn).alias("c1"),
        F.when(k % 19 == 0, bad).otherwise(dv).alias("c2"),
        F.when(rn == 1, F.lit("1")).otherwise(F.lit("2")).alias("c3"),
        F.when(k % 4 == 0, e).otherwise(F.concat(F.lit(" loja "), F.lower("o_orderpriority"))).alias("c4"),
        F.when(k % 23 == 0, e).when(F.col("o_orderstatus") == "O", F.lit("2"))
         .when(F.col("o_orderstatus") == "P", F.lit("3")).otherwise(F.lit("8")).alias("c5"),
        F.when(k % 29 == 0, F.lit("0")).when(k % 31 == 0, F.lit("20190229"))
         .otherwise(_ymd(F.col("o_orderdate"))).alias("c6"),
        _s(k % 3).alias("c7"),
        e.alias("c8"),
        F.when(k % 10 == 0, _s(F.col("c_nationkey") + 10)).otherwise(e).alias("c9"),
        _ymd(F.col("o_orderdate")).alias("c10"),
        _s(cust % 150).alias("c11"),
        e.alias("c12"),
        F.lit("rua").alias("c13"),
        F.concat(F.lit("rua "), _s(k % 97)).alias("c14"),
        _s(k % 1000).alias("c15"),
        e.alias("c16"),
        F.concat(F.lit("bairro "), _s(cust % 7)).alias("c17"),
        _s(k * 7).alias("c18"),
        _uf_of_region(F.col("n_regionkey")).alias("c19"),
        _s(F.col("c_nationkey") + 1).alias("c20"),
        _s(11 + cust % 80).alias("c21"),
        F.when(k % 5 == 0, F.lit("0")).otherwise(_s(30000000 + k)).alias("c22"),
        e.alias("c23"), e.alias("c24"), e.alias("c25"), e.alias("c26"),
        F.concat(F.lit("Contato"), _s(k), F.lit("@Example.COM")).alias("c27"),
        e.alias("c28"),
        F.lit("0").alias("c29"),
    )


def raw_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    df = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    s = F.col("l_suppkey")
    kind = F.when(s % 10 == 0, F.lit(1)).when(s % 10 == 5, F.lit(3)).otherwise(F.lit(2))
    e = F.lit("")
    return df.select(
        F.lpad(_s(F.col("o_custkey")), 8, "0").alias("c0"),
        _s(kind).alias("c1"),
        F.when(kind == 1, F.concat(F.lit("EMPRESA "), _s(F.col("l_partkey"))))
         .when(kind == 2, F.concat(F.lit("Socio "), _s(s)))
         .otherwise(F.concat(F.lit("FOREIGN "), _s(s))).alias("c2"),
        F.when(kind == 1, F.concat(F.lpad(_s(F.col("l_partkey")), 8, "0"), F.lit("000100")))
         .when(kind == 2, F.concat(F.lit("***"), F.lpad(_s((s * 7919) % 1000000), 6, "0"), F.lit("**")))
         .otherwise(e).alias("c3"),
        _s(F.col("l_linenumber") * 5).alias("c4"),
        _ymd(F.col("l_shipdate")).alias("c5"),
        F.when(kind == 3, F.lit("105")).otherwise(e).alias("c6"),
        e.alias("c7"), e.alias("c8"), F.lit("0").alias("c9"),
        F.when(kind == 2, _s(s % 9 + 1)).otherwise(F.lit("0")).alias("c10"),
    )


def raw_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    d_in = _ymd(F.date_add(F.to_date(F.lit("2000-01-01")), k.cast("int")))
    d_out = _ymd(F.date_add(F.to_date(F.lit("2010-01-01")), k.cast("int")))
    return c.select(
        F.lpad(_s(k), 8, "0").alias("c0"),
        F.when(k % 2 == 0, F.lit("S")).otherwise(F.lit("N")).alias("c1"),
        d_in.alias("c2"),
        F.when(k % 2 == 0, F.lit("00000000")).otherwise(d_out).alias("c3"),
        F.when(k % 3 == 0, F.lit("s")).otherwise(F.lit("n")).alias("c4"),
        F.when(k % 3 == 0, d_in).otherwise(F.lit("0")).alias("c5"),
        F.lit("").alias("c6"),
    )


LOOKUP_KINDS = ["cnaes", "motivos", "municipios", "naturezas", "paises", "qualificacoes"]


def muni_name(nationkey, nname):
    """Municipality name of a nation row (accents on some)."""
    return (F.when(nationkey % 3 == 0, F.concat(F.lit("São "), nname))
            .when(nationkey % 3 == 1, F.concat(F.lit("Guaíba "), nname))
            .otherwise(nname))


def raw_lookup(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    if kind == "cnaes":
        p = table(spark, sf_dir, "part")
        return p.select(F.lpad(_s(F.col("p_partkey")), 7, "0").alias("c0"),
                        F.concat(F.lit("Atividade "), F.col("p_name"), F.lit(" ção")).alias("c1"))
    if kind == "motivos":
        r = table(spark, sf_dir, "region")
        return r.select(_s(F.col("r_regionkey")).alias("c0"),
                        F.concat(F.lit("Motivo "), F.col("r_name")).alias("c1"))
    n = table(spark, sf_dir, "nation")
    nk, nn = F.col("n_nationkey"), F.col("n_name")
    if kind == "municipios":
        return n.select(_s(nk + 1).alias("c0"), F.upper(muni_name(nk, nn)).alias("c1"))
    if kind == "naturezas":
        return n.select(_s(nk).alias("c0"), F.concat(F.lit("Natureza "), nn).alias("c1"))
    if kind == "paises":
        return n.select(_s(nk + 10).alias("c0"), F.concat(F.lit("País "), nn).alias("c1"))
    if kind == "qualificacoes":
        return n.select(_s(nk * 2).alias("c0"), F.concat(F.lit("Qualificação "), nn).alias("c1"))
    raise ValueError(kind)


# --------------------------------------------------------------------------
# funding sheets (one lineitem = one project row; the four sheets split the
# whole table by (returnflag, linestatus))
# --------------------------------------------------------------------------

FUNDING_SPLIT = {
    "direct": "l_returnflag = 'R'",
    "credit": "l_returnflag = 'A' AND l_linestatus = 'F'",
    "equity": "l_returnflag = 'A' AND l_linestatus = 'O'",
    "audiovisual": "l_returnflag = 'N'",
}


def _funding_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.columns import check_digits, format_id
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # the head-office id is a per-company value and the town a per-nation one:
    # computed on their own rows, before the joins
    base = F.concat(F.lpad(_s(F.col("c_custkey")), 8, "0"), F.lit("0001"))
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        format_id(F.concat(base, check_digits(base))).alias("_id"))
    n = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat(F.lit(" "), muni_name(F.col("n_nationkey"), F.col("n_name")), F.lit("  ")).alias("_city"),
        _uf_of_region(F.col("n_regionkey")).alias("_uf"))
    # orders meet their companies first, so that a project row is shuffled once
    owned = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
             .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))
    df = li.join(owned, li.l_orderkey == F.col("o_orderkey"))
    pk = F.col("l_partkey")
    return df.select(
        "*",
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(None).cast("string"))
         .when(F.col("l_linestatus") == "O", F.lit("Subvenção"))
         .otherwise(F.lit("Reembolsável")).alias("f_instrument"),
        _s(F.col("l_orderkey")).alias("f_contract"),
        _s(F.col("l_linenumber")).alias("f_ref"),
        F.date_format(F.col("l_shipdate"), "yyyy-MM-dd").alias("f_signed"),
        F.concat(F.lit("Projeto "), _s(F.col("l_orderkey")), F.lit("-"), _s(F.col("l_linenumber"))).alias("f_title"),
        F.when(pk % 50 == 0, F.lit("")).otherwise(F.col("_id")).alias("f_cnpj"),
        F.when(pk % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("_city")).alias("f_city"),
        F.when(pk % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("_uf")).alias("f_uf"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("f_approved"),
        F.round(F.col("l_extendedprice").cast("decimal(15,2)")
                * (1 - F.col("l_discount").cast("decimal(15,2)")), 2).cast("decimal(15,2)").alias("f_paid"),
        F.when(F.col("l_returnflag") == "R", F.lit("Concluído")).otherwise(F.lit("Em execução")).alias("f_status"),
        F.when(pk % 3 == 0, F.lit("Sim")).when(pk % 3 == 1, F.lit("Não")).otherwise(F.lit("")).alias("f_flag"),
    )


def raw_funding(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Sheet rows of one funding source as positional text/number cells
    (header already removed), in the sheet's own column order."""
    b = _funding_base(spark, sf_dir).filter(FUNDING_SPLIT[source])
    e = F.lit(None).cast("string")
    if source == "direct":
        cols = ["f_instrument", F.concat(F.lit("Chamada "), _s(F.col("l_partkey") % 20)), "f_ref", "f_contract",
                "f_signed", "f_signed", "f_signed", "f_title", "c_name", "f_cnpj", "c_name", "f_cnpj",
                "f_city", "f_uf", "f_approved", "f_status", F.lit(0.0), F.lit(0.0), "f_paid", e,
                F.lit(0.0), F.lit(0.0), "f_title"]
    elif source == "credit":
        cols = ["f_signed", "f_contract", "c_name", "f_cnpj", "f_uf", "f_approved", "f_paid",
                F.lit(0.0), F.lit(0.0), F.lit("Banco Parceiro")]
    elif source == "equity":
        cols = ["f_ref", "f_contract", "f_cnpj", "c_name", "f_signed", e, F.lit(None).cast("double"),
                "f_approved", "f_paid", "f_flag", "f_flag", e, F.lit(None).cast("double"),
                F.lit(None).cast("double"), "f_flag", e, F.lit(None).cast("double"),
                F.lit(0.1), F.lit(1.5)]
    else:  # audiovisual
        cols = ["f_instrument", F.concat(F.lit("Chamada "), _s(F.col("l_partkey") % 20)), "f_ref", "f_contract",
                "f_signed", "f_signed", "f_title", "c_name", "f_cnpj", "c_name", "f_city", "f_uf",
                "f_approved", "f_status", F.lit(0.0), F.lit(0.0), "f_paid", e, F.lit(0.0), F.lit(0.0)]
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey")
    return b.select(row.alias("_row"),
                    *[(F.col(x) if isinstance(x, str) else x).alias(f"c{i}") for i, x in enumerate(cols)])


def raw_disbursement(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Disbursement sheet rows: one per project row, released value split
    in two instalments for even line numbers."""
    b = _funding_base(spark, sf_dir).filter(FUNDING_SPLIT[source])
    inst = F.explode(F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit(1), F.lit(2)))
                     .otherwise(F.array(F.lit(1))))
    b = b.select("*", inst.alias("instalment"))
    # second instalment (even lines) releases the rest of the approved value
    value = F.when(F.col("instalment") == 1, F.col("f_paid")).otherwise(
        (F.col("f_approved") - F.col("f_paid")).cast("decimal(15,2)"))
    dt = F.date_format(F.date_add(F.col("l_shipdate").cast("date"), F.col("instalment") * 30), "yyyy-MM-dd")
    e = F.lit(None).cast("string")
    if source == "credit":
        contract_num = F.col("l_orderkey").cast("double")
        cols = [e, contract_num, e, "f_cnpj", e, e, e, e, e, F.col("instalment").cast("double"), dt, value]
    else:
        cols = [e, e, "f_ref", "f_contract"] + [e] * 10 + [
            F.col("instalment").cast("double"), _s(F.col("instalment")), dt, value]
    return b.select(*[(F.col(x) if isinstance(x, str) else x).alias(f"c{i}") for i, x in enumerate(cols)])


# --------------------------------------------------------------------------
# geography: one municipality per nation, one state per region; polygons
# are axis-aligned boxes (lon 2k..2k+2 - 70, lat 4r..4r+4 - 30)
# --------------------------------------------------------------------------

def _uf_code_of_uf(c):
    expr = None
    for k, v in UF_CODE.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def geo_muni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National municipalities: 7-digit code, state, name (mixed case with
    accents), box polygon ring and its centre."""
    n = table(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    uf = _uf_of_region(r)
    x0 = (k * 2 - 70).cast("double")
    y0 = (r * 4 - 30).cast("double")
    ring = F.array(*[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
                     for dx, dy in [(0, 0), (2, 0), (2, 4), (0, 4), (0, 0)]])
    return n.select(
        F.concat(_uf_code_of_uf(uf), F.lpad(_s(k + 1), 5, "0")).alias("codigo"),
        uf.alias("uf"), _uf_code_of_uf(uf).alias("codigo_uf"),
        muni_name(k, F.initcap(F.col("n_name"))).alias("nome"),
        F.array(ring).alias("rings"),
        (y0 + 2).alias("latitude"), (x0 + 1).alias("longitude"))


def geo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    uf = _uf_of_region(F.col("r_regionkey"))
    name = None
    for k, v in UF_NAME.items():
        name = F.when(uf == k, F.lit(v)) if name is None else name.when(uf == k, F.lit(v))
    y0 = (F.col("r_regionkey") * 4 - 30).cast("double")
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), (y0 + dy).alias("y"))
                     for x, dy in [(-70, 0), (-20, 0), (-20, 4), (-70, 4), (-70, 0)]])
    return r.select(_uf_code_of_uf(uf).alias("codigo"), uf.alias("uf"), name.alias("nome"),
                    F.array(ring).alias("rings"))


# --------------------------------------------------------------------------
# patents: ten header CSV tables, all text, with a file-order row number
# --------------------------------------------------------------------------

ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _dmy(days_from_2000):
    return F.date_format(F.date_add(F.to_date(F.lit("2000-01-01")), days_from_2000.cast("int")), "dd/MM/yyyy")


def _letter(idx):
    return F.substr(F.lit(ALPHA), (idx % 26 + 1).cast("int"), F.lit(1))


def raw_patent(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    if name == "bibliografia":
        prefix = (F.when(F.col("p_size") % 3 == 0, F.lit("PI")).when(F.col("p_size") % 3 == 1, F.lit("MU"))
                  .otherwise(F.lit("BR10")))
        base = p.select(
            pk, (pk * 2).alias("_row"), _s(pk).alias("codigo_interno"),
            F.concat(prefix, F.lpad(_s(pk), 7, "0")).alias("numero_inpi"),
            F.when(pk % 37 == 0, F.lit("31/02/2010")).otherwise(_dmy(pk)).alias("data_deposito"),
            _dmy(pk + 30).alias("data_protocolo"),
            _dmy(pk + 540).alias("data_publicacao"),
            F.lit("").alias("numero_pct"), F.when(pk % 4 == 0, F.concat(F.lit("WO"), _s(pk))).otherwise(F.lit("")).alias("numero_wo"),
            F.when(pk % 4 == 0, _dmy(pk + 2000)).otherwise(F.lit("")).alias("data_publicacao_wo"),
            F.when(pk % 6 == 0, _dmy(pk + 900)).otherwise(F.lit("")).alias("data_entrada_fase_nacional"),
            F.when(pk % 13 == 0, F.lit("1.0")).otherwise(F.lit("0")).alias("sigilo"))
        dup = base.filter(pk % 41 == 0).select(
            pk, (pk * 2 + 1).alias("_row"), "codigo_interno",
            F.concat(F.lit("DUP"), F.col("numero_inpi")).alias("numero_inpi"), "data_deposito",
            "data_protocolo", "data_publicacao", "numero_pct", "numero_wo", "data_publicacao_wo",
            "data_entrada_fase_nacional", "sigilo")
        return base.unionByName(dup).drop("p_partkey")
    if name == "conteudo":
        return p.select((pk * 2).alias("_row"), _s(pk).alias("codigo_interno"),
                        F.when(pk % 17 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("titulo"),
                        F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("resumo"))
    if name == "ipc":
        brand = F.substring_index(F.col("p_brand"), "#", -1).cast("int")
        sym = F.concat(_letter(brand % 8), F.lpad(_s(F.col("p_size") % 100), 2, "0"), _letter(pk),
                       F.lit(" 1/00"))
        sym2 = F.concat(_letter(brand % 8), F.lpad(_s(F.col("p_size") % 100), 2, "0"), _letter(pk + 1),
                        F.lit(" 2/00"))
        one = p.select((pk * 2).alias("_row"), _s(pk).alias("codigo_interno"), F.lit("1").alias("ordem"),
                       sym.alias("simbolo"), F.lit("2024.01").alias("versao"))
        two = p.filter(pk % 3 == 0).select((pk * 2 + 1).alias("_row"), _s(pk).alias("codigo_interno"),
                                           F.lit("2").alias("ordem"), sym2.alias("simbolo"),
                                           F.lit("2024.01").alias("versao"))
        return one.unionByName(two)
    # 1 + pk % 3 attorneys, two countries per number, two types per link
    turn = F.col("t")
    if name == "procuradores":
        p = p.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), pk % 3)))
        return p.select((pk * 4 + turn).alias("_row"), _s(pk).alias("codigo_interno"),
                        F.concat(F.lit("Procurador "), _s((pk + turn * 7) % 50)).alias("procurador"),
                        F.when(turn == 0, _dmy(pk + 10)).otherwise(F.lit("")).alias("data_inicio_procurador"),
                        F.when(pk % 4 == 0, F.concat(F.lpad(_s(pk % 1500), 8, "0"), F.lit("000100")))
                         .otherwise(F.lit("")).alias("cgccpfprocurador"),
                        F.when(pk % 4 == 0, F.lit("Pessoa Jurídica")).otherwise(F.lit("Pessoa Física"))
                         .alias("tipopessoaprocurador"))
    if name == "prioridades":
        p = p.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), pk % 3)))
        return p.select((pk * 4 + turn).alias("_row"), _s(pk).alias("codigo_interno"),
                        F.when(pk % 4 == 0, F.when(turn == 1, F.lit("EP")).otherwise(F.lit("US"))).otherwise(F.lit("")).alias("pais_prioridade"),
                        F.when(pk % 4 == 0, F.concat(F.lit("US"), _s(pk))).otherwise(F.lit(""))
                         .alias("numero_prioridade"),
                        F.when(pk % 4 == 0, _dmy(pk - 200)).otherwise(F.lit("")).alias("data_prioridade"))
    if name == "vinculos":
        p = p.filter(pk > 0).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), pk % 3)))
        return p.select(
            (pk * 4 + turn).alias("_row"), _s(pk).alias("codigo_interno"),
            F.when(pk % 9 == 1, _s(pk + 10000000)).otherwise(_s(F.floor(pk / 2))).alias("codigo_interno_vinculado"),
            F.when((pk + turn) % 2 == 0, F.lit("A")).otherwise(F.lit("I")).alias("tipo_vinculo"),
            _dmy(pk + turn).alias("data_vinculo"))
    if name == "renumeracoes":
        return p.select((pk * 2).alias("_row"), _s(pk).alias("codigo_interno"),
                        F.when(pk % 5 == 0, F.concat(F.lit("OLD"), _s(pk))).otherwise(F.lit(""))
                         .alias("numero_original"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_returnflag", "l_linestatus", "l_shipdate")
    # file position: unique even where the source repeats (order, line)
    row = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")).alias("_row")
    if name == "inventores":
        return li.select(row, _s(F.col("l_partkey")).alias("codigo_interno"),
                         _s(F.col("l_linenumber")).alias("ordem"),
                         F.concat(F.lit("Inventor "), _s(F.col("l_suppkey"))).alias("autor"),
                         F.lit("BR").alias("pais"), F.lit("SP").alias("estado"))
    if name == "depositantes":
        s = F.col("l_suppkey")
        return li.select(row, _s(F.col("l_partkey")).alias("codigo_interno"),
                         _s(F.col("l_linenumber")).alias("ordem"),
                         F.concat(F.lit("Depositante "), _s(s)).alias("depositante"),
                         F.when(s % 2 == 0, F.concat(F.lpad(_s(s * 13 % 1500), 8, "0"), F.lit("000100")))
                          .otherwise(F.concat(F.lit("***"), F.lpad(_s(s * 7919 % 1000000), 6, "0"), F.lit("**")))
                          .alias("cgccpfdepositante"),
                         F.when(s % 2 == 0, F.lit("Pessoa Jurídica")).when(s % 3 == 0, F.lit("pessoa física"))
                          .otherwise(F.lit("Pessoa Física")).alias("tipopessoadepositante"),
                         F.lit("BR").alias("pais"), F.lit("SP").alias("uf"),
                         F.date_format(F.col("l_shipdate"), "dd/MM/yyyy").alias("data_inicio_depositante"),
                         F.when(s % 4 == 0, F.date_format(F.date_add("l_shipdate", 365), "dd/MM/yyyy")).otherwise(F.lit("")).alias("data_fim_depositante"))
    if name == "despachos":
        return li.select(row, _s(F.col("l_partkey")).alias("codigo_interno"),
                         _s(F.col("l_orderkey") % 3000).alias("numero_rpi"),
                         F.date_format(F.col("l_shipdate"), "dd/MM/yyyy").alias("data_rpi"),
                         F.concat(F.col("l_returnflag"), F.lit("."), _s(F.col("l_linenumber"))).alias("codigo_despacho"),
                         F.col("l_linestatus").alias("complemento"))
    raise ValueError(name)


def raw_ipc_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPC subclass dimension: distinct 4-char groups of the part symbols,
    one group (the last alphabetically) left without a row."""
    ipc = raw_patent(spark, sf_dir, "ipc").select(F.left(F.col("simbolo"), F.lit(4)).alias("simbolo")).distinct()
    last = ipc.agg(F.max("simbolo").alias("_mx"))
    from tessera.operators.common import attach_scalars
    return attach_scalars(ipc, last).filter(F.col("simbolo") != F.col("_mx")).select(
        "simbolo", F.left(F.col("simbolo"), F.lit(1)).alias("secao"), F.left(F.col("simbolo"), F.lit(3)).alias("classe"),
        F.concat(F.lit("Title of "), F.col("simbolo")).alias("titulo_en"), F.lit("2024.01").alias("edition"))


def _box(x0, y0, x1, y1):
    """A ring around a box, as coordinate pairs."""
    return F.array(*[F.array(x, y) for x, y in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]])


def geo_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The national municipality frame: codes as numbers, names with blanks,
    geometry as GeoJSON. Every second town has two parts, the first with a
    hole; the others are single polygons."""
    m = geo_muni(spark, sf_dir).withColumn("k", F.substring("codigo", 3, 5).cast("int") - 1)
    x, y = F.col("longitude") - 1, F.col("latitude") - 2
    two = F.array(F.array(_box(x, y, x + 1.5, y + 4), _box(x + 0.5, y + 1, x + 1, y + 2)), F.array(_box(x + 1.625, y, x + 2, y + 1)))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), two.alias("coordinates")))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(_box(x, y, x + 2, y + 4)).alias("coordinates")))
    return m.select("k", F.col("codigo").cast("double").alias("code_muni"), F.concat(F.lit("  "), "nome", F.lit(" ")).alias("name_muni"),
                    F.lower("uf").alias("abbrev_state"), F.col("codigo_uf").cast("int").alias("code_state"), F.when(F.col("k") % 2 == 0, many).otherwise(one).alias("geometry"))


def city_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, x, y, uf``: one point an event, half of them in one town."""
    ev, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    k = F.when(F.col("event_id") % 2 == 0, F.lit(7)).otherwise(F.col("user_id") % 25)
    j = ev.withColumn("_k", k).join(F.broadcast(n), F.col("_k") == F.col("n_nationkey"))
    return j.select(F.col("event_id").alias("pid"), ((F.col("_k") * 2 - 70).cast("double") + F.pmod("value", F.lit(2.0))).alias("x"),
                    ((F.col("n_regionkey") * 4 - 30).cast("double") + F.pmod(F.col("value") * 7, F.lit(4.0))).alias("y"), _uf_of_region(F.col("n_regionkey")).alias("uf"))
