"""Ownership, patent and project graphs as node and edge DataFrames, and
hop-by-hop network expansion.

Nodes carry a string id with a label prefix (``C:`` company root, ``P:``
person key); ownership edges are ``(src, dst, reference_month)`` with
``type = 'SOCIO_DE'``. Network expansion is a loop of equi joins against
the undirected adjacency, one join per hop, with an anti join against what
was already reached, each hop's new nodes written to the shared folder. The
neighbours come from an edge table or from the stored graph (``graph_store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.common import first_by, strip_accents_upper

STUB_NAME = "EMPRESA NAO ENCONTRADA NA BASE"


# --------------------------------------------------------------------------
# GRA-1..5 node and edge tables
# --------------------------------------------------------------------------

def person_rows(partners: DataFrame) -> DataFrame:
    """Partners of kind 2/3 with their person key (FN-31); rows without a
    name have no identity and are dropped."""
    p = partners.filter(F.col("identificador_socio").isin(2, 3))
    return p.withColumn("pessoa_id", C.person_key("cpf_cnpj_socio", "nome_socio_razao_social",
                                                  "identificador_socio")).filter(F.col("pessoa_id").isNotNull())


def person_nodes(partners: DataFrame) -> DataFrame:
    """GRA-2: one node per person key; the latest row's values win
    (month, then entry date, then company id as the deterministic order)."""
    p = person_rows(partners)
    order = F.struct("reference_month", "data_entrada_sociedade", "cnpj_basico", "qualificacao_socio")
    vals = F.struct(F.col("nome_socio_razao_social").alias("nome"), F.col("cpf_cnpj_socio").alias("cpf_cnpj_socio"),
                    F.col("identificador_socio").alias("identificador_socio"),
                    F.col("faixa_etaria").alias("faixa_etaria"))
    g = p.groupBy("pessoa_id").agg(F.max_by(vals, order).alias("v"))
    return g.select("pessoa_id", "v.*")


def person_edges(partners: DataFrame) -> DataFrame:
    """GRA-3: person -> company, one per (person, company, month)."""
    p = person_rows(partners)
    order = F.struct("data_entrada_sociedade", "qualificacao_socio")
    g = p.groupBy("pessoa_id", "cnpj_basico", "reference_month").agg(
        F.max_by(F.struct("qualificacao_socio", "data_entrada_sociedade"), order).alias("v"),
        F.count(F.lit(1)).alias("duplicate_count"))
    return g.select("pessoa_id", "cnpj_basico", "reference_month", "v.qualificacao_socio",
                    "v.data_entrada_sociedade", "duplicate_count")


def company_rows(partners: DataFrame) -> DataFrame:
    """Company partners (kind 1, id >= 14 chars) with their root."""
    p = partners.filter((F.col("identificador_socio") == 1) & (F.length("cpf_cnpj_socio") >= 14))
    return p.withColumn("cnpj_socio_basico", F.trim(F.left(F.col("cpf_cnpj_socio"), F.lit(8))))


def company_edges(partners: DataFrame) -> DataFrame:
    """GRA-4: company partners (kind 1, id >= 14 chars): partner root (first
    8 chars) -> company, one per (src, dst, month)."""
    p = company_rows(partners)
    order = F.struct("data_entrada_sociedade", "qualificacao_socio")
    g = p.groupBy("cnpj_socio_basico", "cnpj_basico", "reference_month").agg(
        F.max_by(F.struct(F.col("nome_socio_razao_social").alias("razao_social_socio"), "qualificacao_socio",
                          "data_entrada_sociedade"), order).alias("v"),
        F.count(F.lit(1)).alias("duplicate_count"))
    return g.select("cnpj_socio_basico", "cnpj_basico", "reference_month", "v.*", "duplicate_count")


def company_nodes(companies: DataFrame, partners: DataFrame) -> DataFrame:
    """GRA-1: company nodes; roots referenced only by edges become stubs."""
    real = companies.select("cnpj_basico", "razao_social", "porte_empresa", "natureza_juridica",
                            F.lit(False).alias("is_stub"))
    # an edge's ends are those of its rows: no need to group the edges first
    ce = company_rows(partners)
    refs = (ce.select(F.col("cnpj_socio_basico").alias("cnpj_basico"))
            .unionByName(ce.select("cnpj_basico"))
            .unionByName(person_rows(partners).select("cnpj_basico")).distinct())
    stubs = refs.join(real.select("cnpj_basico"), "cnpj_basico", "left_anti").select(
        "cnpj_basico", F.lit(STUB_NAME).alias("razao_social"), F.lit(None).cast("string").alias("porte_empresa"),
        F.lit(None).cast("int").alias("natureza_juridica"), F.lit(True).alias("is_stub"))
    return real.unionByName(stubs)


def establishment_nodes(establishments: DataFrame) -> DataFrame:
    """GRA-5: establishment nodes (10 columns)."""
    return establishments.select(
        F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv").alias("cnpj_14"), "cnpj_basico",
        "identificador_matriz_filial", "nome_fantasia", "situacao_cadastral", "uf", "codigo_municipio",
        "cnae_fiscal_principal", "data_inicio_atividade", "reference_month")


def belongs_to_edges(establishments: DataFrame) -> DataFrame:
    """GRA-5: establishment -> company, one per pair and month."""
    return establishments.select(F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv").alias("cnpj_14"), "cnpj_basico", "reference_month",
                                 F.lit("PERTENCE_A").alias("type")).distinct()


def ownership_edges(partners: DataFrame) -> DataFrame:
    """All SOCIO_DE edges in one shape: ``src``/``dst`` node ids."""
    pe = person_edges(partners).select(
        F.concat(F.lit("P:"), "pessoa_id").alias("src"), F.concat(F.lit("C:"), "cnpj_basico").alias("dst"),
        "reference_month")
    ce = company_edges(partners).select(
        F.concat(F.lit("C:"), "cnpj_socio_basico").alias("src"), F.concat(F.lit("C:"), "cnpj_basico").alias("dst"),
        "reference_month")
    return pe.unionByName(ce).withColumn("type", F.lit("SOCIO_DE"))


# --------------------------------------------------------------------------
# PRJ-27 graph columns, SNK-11 stored graph
# --------------------------------------------------------------------------

# fixed values: columns that graph nodes and edges carry, per table
GRAPH_FIELDS = {
    "empresa": ["cnpj_basico", "razao_social", "natureza_juridica", "porte_empresa"],
    "pessoa": ["nome", "cpf_cnpj_socio", "identificador_socio", "faixa_etaria"],
    "estabelecimento": ["cnpj_basico", "cnpj_ordem", "cnpj_dv", "identificador_matriz_filial", "nome_fantasia", "situacao_cadastral",
                        "data_inicio_atividade", "cnae_fiscal_principal", "uf", "codigo_municipio"],
    "socio_de": ["qualificacao_socio", "data_entrada_sociedade"],
}


def graph_columns(df: DataFrame, kind: str) -> DataFrame:
    """PRJ-27: a table cut to the columns its graph element carries; one that
    lacks any of them is an error."""
    missing = [c for c in GRAPH_FIELDS[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"{kind} lacks {', '.join(missing)}")
    return df.select(*GRAPH_FIELDS[kind])


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge from both its ends: ``node``, ``nbr`` and the edge."""
    e = edges.select("type", "src", "dst", "reference_month")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "*").unionByName(
        e.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "*"))


# --------------------------------------------------------------------------
# GRA-6/7/8 network expansion
# --------------------------------------------------------------------------

class EdgeTable:
    """A graph whose edges are a DataFrame."""

    def __init__(self, edges: DataFrame, store: bool = True):
        from tessera.session import stage_table
        e = edges.select("type", "src", "dst", "reference_month")
        # it feeds every hop: stored once, each reader takes the columns it needs
        self.edges = stage_table(e, "edges") if store else e

    def neighbours(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (with a column ``node``) joined to their edges, from
        either end: ``nbr, type, src, dst, reference_month``."""
        return nodes.join(adjacency(self.edges), "node")


def reach(seeds: DataFrame, graph, hops: int) -> DataFrame:
    """(seed, node) pairs within ``hops`` undirected hops of each seed.

    One equi join per hop, new nodes only (anti join on what was reached),
    deduplicated and written once; ``reached`` stays a union of such tables. A
    hub (one node in thousands of companies) makes one skewed join key: AQE's
    skew join splits that partition."""
    from tessera.session import stage_table
    reached = seeds.select("seed", F.col("seed").alias("node")).distinct()
    if hops > 0:
        reached = stage_table(reached, "reached")
    frontier = reached
    for _ in range(hops):
        nxt = (graph.neighbours(frontier).select("seed", F.col("nbr").alias("node")).distinct()
               .join(reached, ["seed", "node"], "left_anti"))
        frontier = stage_table(nxt, "reached")
        reached = reached.unionByName(frontier)
    return reached


def network(seeds: DataFrame, edges, hops: int, limit: int | None = None) -> DataFrame:
    """Distinct edges on undirected paths of 1..``hops`` hops from each seed;
    ``edges`` is an edge table or a stored graph.

    An edge lies on such a path iff one of its ends is within ``hops - 1``
    hops of the seed, so the edge set is the edges incident to the reached
    nodes. The whole network is returned unless the caller asks for a
    ``limit``: then per seed the first ``limit`` edges by (type, src, dst,
    month) are kept and ``truncated`` says whether more existed. Each reached
    node first keeps its own first ``limit + 1`` incident edges: the global
    first ``limit + 1`` of a seed are among them, so the cut is exact."""
    graph = EdgeTable(edges) if isinstance(edges, DataFrame) else edges
    near = reach(seeds, graph, hops - 1)
    inc = graph.neighbours(near).select("seed", "node", "type", "src", "dst", "reference_month")
    if limit is None:
        return inc.drop("node").dropDuplicates(["seed", "type", "src", "dst", "reference_month"]).withColumn(
            "truncated", F.lit(False))
    order = [F.col("type"), F.col("src"), F.col("dst"), F.col("reference_month")]
    wn = Window.partitionBy("seed", "node").orderBy(*order)
    inc = inc.withColumn("_r", F.row_number().over(wn)).filter(F.col("_r") <= limit + 1).drop("_r", "node")
    inc = inc.dropDuplicates(["seed", "type", "src", "dst", "reference_month"])
    w = Window.partitionBy("seed").orderBy(*order)
    ranked = inc.withColumn("_rank", F.row_number().over(w))
    more = ranked.groupBy("seed").agg((F.max("_rank") > limit).alias("truncated"))
    return ranked.filter(F.col("_rank") <= limit).join(more, "seed").drop("_rank")


def _depth(depth: int) -> int:
    if depth < 1:
        raise ValueError(f"network depth {depth}: must be at least 1")
    return depth


def company_network(seed_ids: DataFrame, edges, depth: int = 1, **kw) -> DataFrame:
    """GRA-6: company network; depth d (from 1 on) means 2d - 1 hops."""
    d = _depth(depth)
    seeds = seed_ids.select(F.concat(F.lit("C:"), F.col("cnpj_basico")).alias("seed"))
    return network(seeds, edges, 2 * d - 1, **kw)


def person_network(person_ids: DataFrame, edges, depth: int = 1, **kw) -> DataFrame:
    """GRA-7: person network; depth d means d hops."""
    d = _depth(depth)
    seeds = person_ids.select(F.concat(F.lit("P:"), F.col("pessoa_id")).alias("seed"))
    return network(seeds, edges, d, **kw)


def network_metadata(net: DataFrame, limit: int | None = None) -> DataFrame:
    """GRA-8: per seed: nodes, edges, relationships (+1 when truncated) and
    the limit asked for (null: the whole network)."""
    nodes = (net.select("seed", F.col("src").alias("n")).unionByName(net.select("seed", F.col("dst").alias("n")))
             .groupBy("seed").agg(F.count_distinct("n").alias("nodes")))
    e = net.groupBy("seed").agg(F.count(F.lit(1)).alias("edges"), F.max("truncated").alias("truncated"))
    return e.join(nodes, "seed").select(
        "seed", "nodes", "edges", (F.col("edges") + F.when(F.col("truncated"), 1).otherwise(0)).alias("relationships"),
        "truncated", F.lit(limit).cast("int").alias("limit"))


# --------------------------------------------------------------------------
# GRA-9 graph search
# --------------------------------------------------------------------------

def pick_person(people: DataFrame, mask: str, name: str | None = None) -> DataFrame:
    """GRA-7: the person that a masked id names, or a (masked id, name) pair;
    of several the first by name."""
    found = people.filter(F.col("cpf_cnpj_socio") == C.norm_mask(F.lit(mask)))
    if name is not None:
        found = found.filter(F.col("nome") == name)
    return found.orderBy("nome", "pessoa_id").limit(1)


def graph_search(company_nodes_df: DataFrame, person_nodes_df: DataFrame, edges: DataFrame, q: str,
                 k: int = 20) -> DataFrame:
    """GRA-9 over node and edge tables: see ``search_nodes``."""
    hits = search_nodes(node_table(company_nodes_df, person_nodes_df), q)
    deg = (edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
           .join(hits.select("node"), "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    out = hits.join(deg, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.orderBy("rank", "label", "node").limit(k)


def node_table(companies: DataFrame, people: DataFrame) -> DataFrame:
    """All nodes in one shape: ``node, kind, key, label``."""
    return companies.select(F.concat(F.lit("C:"), "cnpj_basico").alias("node"), F.lit("empresa").alias("kind"), F.col("cnpj_basico").alias("key"),
                            F.col("razao_social").alias("label")).unionByName(
        people.select(F.concat(F.lit("P:"), "pessoa_id").alias("node"), F.lit("pessoa").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("nome").alias("label")))


def search_nodes(nodes: DataFrame, q: str) -> DataFrame:
    """GRA-9 + SET-6 + SRT-5: companies whose root starts with the typed
    digits (all of them: 14 digits match no root) or whose name contains the
    text, persons by name; the text is upper-cased and accent-stripped, blank
    text matches no name. ``node, kind, label, rank``: exact id, prefix, other."""
    digits = "".join(ch for ch in q if ch in "0123456789")
    text = strip_accents_upper(q)
    key = F.coalesce("key", F.lit(""))
    found = F.upper(F.coalesce("label", F.lit(""))).contains(text) if text else F.lit(False)
    if digits:
        found = found | key.startswith(digits)
    rank = F.when(F.lit(bool(digits)) & (key == digits), 0).when(F.lit(bool(digits)) & key.startswith(digits), 1).otherwise(2)
    return nodes.filter(found).select("node", "kind", "label", rank.alias("rank"), *[c for c in ("degree",) if c in nodes.columns])


# --------------------------------------------------------------------------
# GRA-10..14 patent and project graphs, GRA-16/17 maintenance
# --------------------------------------------------------------------------

def patent_nodes(patents: DataFrame, content: DataFrame) -> DataFrame:
    """JOIN-21 / GRA-10: patent nodes with title."""
    return patents.select("codigo_interno", "numero_inpi", "tipo_patente", "data_deposito", "sigilo") \
        .join(content.select("codigo_interno", "titulo"), "codigo_interno", "left")


def ipc_nodes(ipc: DataFrame) -> DataFrame:
    """GRA-10 / SET-3: distinct IPC groups (4 chars) with section and class."""
    return ipc.select(C.ipc_group("simbolo").alias("grupo")).filter(F.col("grupo").isNotNull()).distinct() \
        .select("grupo", C.ipc_section("grupo").alias("secao"), C.ipc_class("grupo").alias("classe"))


def classified_edges(ipc: DataFrame) -> DataFrame:
    """GRA-10: patent -> IPC group, one per pair."""
    return ipc.select("codigo_interno", C.ipc_group("simbolo").alias("grupo")) \
        .filter(F.col("grupo").isNotNull()).distinct()


# fixed values: person type text of an individual depositor
INDIVIDUAL = "pessoa física"


def depositor_nodes(depositors: DataFrame) -> DataFrame:
    """GRA-11 / SET-3: distinct individual depositors keyed by FN-32."""
    d = depositors.filter(F.col("tipopessoadepositante") == INDIVIDUAL)
    d = d.withColumn("depositante_id", C.depositor_key(F.coalesce("depositante", F.lit("")), F.col("cgccpfdepositante")))
    first = first_by(d, ["depositante_id"], [F.col("codigo_interno"), F.col("ordem")])
    return first.select("depositante_id", F.upper(F.trim(F.coalesce("depositante", F.lit("")))).alias("nome"),
                        F.col("cgccpfdepositante").alias("cpf_mascara"))


def depositor_edges(depositors: DataFrame) -> DataFrame:
    """GRA-11: individual depositor -> patent, one per pair."""
    d = depositors.filter(F.col("tipopessoadepositante") == INDIVIDUAL)
    return d.select(C.depositor_key(F.coalesce("depositante", F.lit("")), F.col("cgccpfdepositante"))
                    .alias("depositante_id"), "codigo_interno").distinct()


def company_filed_edges(depositors: DataFrame, company_nodes_df: DataFrame) -> DataFrame:
    """GRA-12: company -> patent where the resolved root is a company node."""
    d = depositors.filter(F.col("cnpj_basico_resolved").isNotNull()).select(
        F.col("cnpj_basico_resolved").alias("cnpj_basico"), "codigo_interno").distinct()
    return d.join(company_nodes_df.select("cnpj_basico"), "cnpj_basico", "left_semi")


def patent_link_edges(links: DataFrame, patents: DataFrame) -> DataFrame:
    """GRA-13: patent -> linked patent, both nodes present."""
    ids = patents.select("codigo_interno")
    e = links.select("codigo_interno", "codigo_interno_vinculado", "tipo_vinculo").distinct()
    e = e.join(ids, "codigo_interno", "left_semi")
    return e.join(ids.withColumnRenamed("codigo_interno", "codigo_interno_vinculado"),
                  "codigo_interno_vinculado", "left_semi")


def project_nodes(projects: DataFrame) -> DataFrame:
    """GRA-14: one node a project: id, title, instrument, status, approved
    value; of equal ids the first row of the sheet."""
    first = first_by(projects, ["id"], [F.col("row_no").asc_nulls_last(), F.col("contrato")])
    return first.select("id", "titulo", "instrumento", "status", F.col("valor_finep").alias("valor_aprovado"))


def project_edges(projects: DataFrame, company_nodes_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRA-14: proposed-by and executed-by edges (executor only when it
    differs from the proposer); the company root must be a node."""
    roots = company_nodes_df.select("cnpj_basico")
    p = projects.select("id", F.left(C.digits_only(F.coalesce("cnpj_proponente", F.lit(""))), F.lit(8))
                        .alias("prop"), F.left(C.digits_only(F.coalesce("cnpj_executor", F.lit(""))), F.lit(8))
                        .alias("exec"))
    proposed = p.filter(F.length("prop") == 8).select("id", F.col("prop").alias("cnpj_basico")).distinct() \
        .join(roots, "cnpj_basico", "left_semi")
    executed = p.filter((F.length("exec") == 8) & (F.col("exec") != F.col("prop"))) \
        .select("id", F.col("exec").alias("cnpj_basico")).distinct().join(roots, "cnpj_basico", "left_semi")
    return proposed, executed


def repair_company_persons(person_nodes_df: DataFrame, person_edges_df: DataFrame,
                           company_nodes_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRA-16: person nodes that are companies (kind 1 with a 14-digit id)
    become company -> company edges; those persons are dropped."""
    wrong = person_nodes_df.filter((F.col("identificador_socio") == 1)
                                   & (F.length(C.digits_only("cpf_cnpj_socio")) >= 14))
    new_edges = (person_edges_df.join(wrong.select("pessoa_id", "cpf_cnpj_socio"), "pessoa_id")
                 .select(F.left(C.digits_only("cpf_cnpj_socio"), F.lit(8)).alias("cnpj_socio_basico"),
                         "cnpj_basico", "reference_month").distinct())
    new_edges = new_edges.join(company_nodes_df.select(F.col("cnpj_basico").alias("cnpj_socio_basico")),
                               "cnpj_socio_basico", "left_semi")
    kept = person_nodes_df.join(wrong.select("pessoa_id"), "pessoa_id", "left_anti")
    return new_edges, kept


def drop_label(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """GRA-17: remove one node label and every edge touching it."""
    gone = nodes.filter(F.col("label") == label).select("id")
    kept_nodes = nodes.filter(F.col("label") != label)
    e = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti") \
        .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept_nodes, e
