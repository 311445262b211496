"""Graph queries: node/edge tables, network expansion, search, patent and
project graphs, maintenance and documented graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.plans import oracle_graph as OG
from tessera.plans.catalog import register


def _seed_companies(I):
    """Network seeds: the five active companies with the largest capital
    (a top-k request over the whole view)."""
    return I.stored_view("active").orderBy(F.col("capital_social").desc(), "cnpj_basico").limit(5).select("cnpj_basico")


def _seed_persons(I):
    return G.person_nodes(I.partners).filter(F.col("nome").ilike("%SOCIO 11%")).select("pessoa_id")


register("person_nodes", "SELECT * FROM g_person_nodes")(lambda I: G.person_nodes(I.partners))
register("person_edges", "SELECT * FROM g_person_edges")(lambda I: G.person_edges(I.partners))
register("company_edges", "SELECT * FROM g_company_edges")(lambda I: G.company_edges(I.partners))
register("company_nodes", "SELECT * FROM g_company_nodes")(lambda I: G.company_nodes(I.companies, I.partners))
register("establishment_nodes", """
SELECT cnpj_basico || cnpj_ordem || cnpj_dv AS cnpj_14, cnpj_basico, identificador_matriz_filial, nome_fantasia,
       situacao_cadastral, uf, codigo_municipio, cnae_fiscal_principal, data_inicio_atividade, reference_month
FROM estab
""")(lambda I: G.establishment_nodes(I.establishments))

_NET_COLS = ["seed", "type", "src", "dst", "reference_month", "truncated"]

register("belongs_to_edges", """
SELECT DISTINCT cnpj_basico || cnpj_ordem || cnpj_dv AS cnpj_14, cnpj_basico, reference_month, 'PERTENCE_A' AS type FROM estab
""")(lambda I: G.belongs_to_edges(I.establishments))

# requests read the stored graph
register("company_network_d1", OG.network_sql("g_seed_companies", 1))(
    lambda I: G.company_network(_seed_companies(I), I.graph, 1).select(*_NET_COLS))
register("company_network_d2", OG.network_sql("g_seed_companies", 3))(
    lambda I: G.company_network(_seed_companies(I), I.graph, 2).select(*_NET_COLS))
register("person_network_d1", OG.network_sql("g_seed_persons", 1))(
    lambda I: G.person_network(_seed_persons(I), I.graph, 1).select(*_NET_COLS))
register("person_network_d2", OG.network_sql("g_seed_persons", 2))(
    lambda I: G.person_network(_seed_persons(I), I.graph, 2).select(*_NET_COLS))

register("company_network_limit", OG.network_sql("g_seed_companies", 1, 40))(
    lambda I: G.company_network(_seed_companies(I), I.graph, 1, limit=40).select(*_NET_COLS))

register("company_network_d2_limit", OG.network_sql("g_seed_companies", 3, 200))(
    lambda I: G.company_network(_seed_companies(I), I.graph, 2, limit=200).select(*_NET_COLS))

register("network_nodes", f"""
WITH net AS ({OG.network_sql('g_seed_companies', 3)}),
ends AS (SELECT seed, src AS node FROM net UNION SELECT seed, dst FROM net),
named AS (SELECT 'C:' || cnpj_basico AS node, 'empresa' AS kind, razao_social AS label FROM g_company_nodes
          UNION ALL SELECT 'P:' || pessoa_id, 'pessoa', nome FROM g_person_nodes)
SELECT e.seed, e.node, n.kind, n.label, (SELECT count(*) FROM g_edges x WHERE x.src = e.node) + (SELECT count(*) FROM g_edges x WHERE x.dst = e.node) AS degree
FROM ends e JOIN named n ON n.node = e.node
""")(lambda I: I.graph.describe(G.company_network(_seed_companies(I), I.graph, 2)))

register("pick_person", """
SELECT pessoa_id, nome FROM g_person_nodes WHERE cpf_cnpj_socio = (SELECT min(cpf_cnpj_socio) FROM g_person_nodes WHERE regexp_full_match(cpf_cnpj_socio, '\\*{3}[0-9]{6}\\*{2}'))
ORDER BY nome, pessoa_id LIMIT 1
""")(lambda I: _picked(I))


def _picked(I):
    from tessera.session import stage_table
    # read twice: for the mask and for the person
    people = stage_table(G.person_nodes(I.staged_partners), "people")
    mask = people.filter(F.col("cpf_cnpj_socio").rlike(r"^\*{3}\d{6}\*{2}$")).agg(F.min("cpf_cnpj_socio")).first()[0]
    return G.pick_person(people, f" {mask} ").select("pessoa_id", "nome")


register("graph_columns", "SELECT cnpj_basico, razao_social, natureza_juridica, porte_empresa FROM empresa")(
    lambda I: G.graph_columns(I.companies, "empresa"))
register("graph_columns_estabelecimento", """
SELECT cnpj_basico, cnpj_ordem, cnpj_dv, identificador_matriz_filial, nome_fantasia, situacao_cadastral, data_inicio_atividade, cnae_fiscal_principal, uf, codigo_municipio
FROM estab
""")(lambda I: G.graph_columns(I.establishments, "estabelecimento"))
register("graph_columns_pessoa", "SELECT nome, cpf_cnpj_socio, identificador_socio, faixa_etaria FROM g_person_nodes")(
    lambda I: G.graph_columns(G.person_nodes(I.partners), "pessoa"))
register("graph_columns_socio_de", "SELECT qualificacao_socio, data_entrada_sociedade FROM g_person_edges")(
    lambda I: G.graph_columns(G.person_edges(I.partners), "socio_de"))


def _written_graph(I):
    """A graph written anew, read back whole."""
    from tessera.operators.graph_store import GraphStore
    from tessera.plans.q_io import scratch
    store = GraphStore(I.spark, scratch(I.spark, "graph"))
    partners = I.staged_partners
    store.write(G.ownership_edges(partners), G.company_nodes(I.companies, partners), G.person_nodes(partners))
    return store


register("write_graph", """
SELECT src AS node, dst AS nbr, type, src, dst, reference_month FROM g_edges UNION ALL SELECT dst, src, type, src, dst, reference_month FROM g_edges
""")(lambda I: _written_graph(I).edges(I.month).select("node", "nbr", "type", "src", "dst", "reference_month"))
register("write_graph_nodes", """
WITH d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g_edges UNION ALL SELECT dst FROM g_edges) GROUP BY node)
SELECT n.*, coalesce(degree, 0) AS degree FROM (SELECT 'C:' || cnpj_basico AS node, 'empresa' AS kind, cnpj_basico AS key, razao_social AS label FROM g_company_nodes
  UNION ALL SELECT 'P:' || pessoa_id, 'pessoa', NULL, nome FROM g_person_nodes) n LEFT JOIN d USING (node)
""")(lambda I: _written_graph(I).nodes().drop("bucket"))

register("network_metadata", f"""
WITH net AS ({OG.network_sql('g_seed_companies', 3)})
SELECT e.seed, n.nodes, e.edges, e.edges + CASE WHEN e.truncated THEN 1 ELSE 0 END AS relationships,
       e.truncated, CAST(NULL AS INTEGER) AS "limit"
FROM (SELECT seed, COUNT(*) AS edges, bool_or(truncated) AS truncated FROM net GROUP BY seed) e
JOIN (SELECT seed, COUNT(DISTINCT x) AS nodes FROM (SELECT seed, src AS x FROM net UNION ALL
      SELECT seed, dst FROM net) u GROUP BY seed) n ON n.seed = e.seed
""")(lambda I: G.network_metadata(G.company_network(_seed_companies(I), I.graph, 2)))

register("graph_search", """
WITH hits AS (
  SELECT 'C:' || cnpj_basico AS node, 'empresa' AS kind, razao_social AS label,
         CASE WHEN cnpj_basico = '11' THEN 0 WHEN starts_with(cnpj_basico, '11') THEN 1 ELSE 2 END AS rank
  FROM g_company_nodes WHERE contains(upper(razao_social), '11') OR starts_with(cnpj_basico, '11')
  UNION ALL
  SELECT 'P:' || pessoa_id, 'pessoa', nome, 2 FROM g_person_nodes WHERE contains(upper(nome), '11')),
deg AS (SELECT node, COUNT(*) AS degree FROM (SELECT src AS node FROM g_edges UNION ALL SELECT dst FROM g_edges) x
        WHERE node IN (SELECT node FROM hits) GROUP BY node)
SELECT h.node, h.kind, h.label, h.rank, COALESCE(d.degree, 0) AS degree
FROM hits h LEFT JOIN deg d ON d.node = h.node ORDER BY h.rank, h.label, h.node LIMIT 20
""")(lambda I: I.graph.search("11"))

register("graph_search_accents", """
WITH hits AS (SELECT 'P:' || pessoa_id AS node, 'pessoa' AS kind, nome AS label, 2 AS rank FROM g_person_nodes WHERE contains(upper(nome), 'SOCIO 1')
              UNION ALL SELECT 'C:' || cnpj_basico, 'empresa', razao_social, CASE WHEN cnpj_basico = '1' THEN 0 WHEN starts_with(cnpj_basico, '1') THEN 1 ELSE 2 END
              FROM g_company_nodes WHERE contains(upper(razao_social), 'SOCIO 1') OR starts_with(cnpj_basico, '1'))
SELECT h.*, (SELECT count(*) FROM g_edges e WHERE e.src = h.node) + (SELECT count(*) FROM g_edges e WHERE e.dst = h.node) AS degree
FROM hits h ORDER BY rank, label, node LIMIT 20
""")(lambda I: I.graph.search("sócio 1"))
# the 14 digits match no root; the name they stand in does
register("graph_search_digits14", """
SELECT 'C:' || cnpj_basico AS node, 'empresa' AS kind, razao_social AS label, 2 AS rank,
  (SELECT count(*) FROM g_edges e WHERE e.src = 'C:' || cnpj_basico) + (SELECT count(*) FROM g_edges e WHERE e.dst = 'C:' || cnpj_basico) AS degree
FROM g_company_nodes WHERE contains(razao_social, '000000026') ORDER BY razao_social, node LIMIT 20
""")(lambda I: _searched(I, "00000026000100", "000000026"))


def _searched(I, *texts):
    """The hits of several searches over one set of nodes and edges."""
    from tessera.session import stage_table
    partners = I.staged_partners
    companies, people, edges = (stage_table(df, name) for df, name in (
        (G.company_nodes(I.companies, partners).select("cnpj_basico", "razao_social"), "companies"),
        (G.person_nodes(partners).select("pessoa_id", "nome"), "people"), (G.ownership_edges(partners).select("src", "dst"), "edges")))
    first, *rest = (G.graph_search(companies, people, edges, q) for q in texts)
    for hits in rest:
        first = first.unionByName(hits)
    return first


# patent graph ---------------------------------------------------------------

register("patent_nodes", """
SELECT b.codigo_interno, b.numero_inpi, b.tipo_patente, b.data_deposito, b.sigilo, c.titulo
FROM pt_bib b LEFT JOIN pt_content c ON c.codigo_interno = b.codigo_interno
""")(lambda I: G.patent_nodes(I.patents, I.patent_part("conteudo")))
register("ipc_nodes", """
SELECT DISTINCT left(simbolo, 4) AS grupo, left(simbolo, 1) AS secao, left(simbolo, 3) AS classe
FROM pt_ipc WHERE simbolo IS NOT NULL
""")(lambda I: G.ipc_nodes(I.patent_part("ipc")))
register("classified_edges", """
SELECT DISTINCT codigo_interno, left(simbolo, 4) AS grupo FROM pt_ipc WHERE simbolo IS NOT NULL
""")(lambda I: G.classified_edges(I.patent_part("ipc")))

_DKEY = "sha256(upper(trim(COALESCE(depositante, ''))) || '|' || COALESCE(cgccpfdepositante, ''))"
register("distinct_nodes", f"""
SELECT depositante_id, nome, cpf_mascara FROM (
  SELECT {_DKEY} AS depositante_id, upper(trim(COALESCE(depositante, ''))) AS nome, cgccpfdepositante AS cpf_mascara,
         row_number() OVER (PARTITION BY {_DKEY} ORDER BY codigo_interno, ordem) AS rn
  FROM pt_depositors WHERE tipopessoadepositante = 'pessoa física') t WHERE rn = 1
""")(lambda I: G.depositor_nodes(I.patent_part("depositantes")))
register("depositor_edges", f"""
SELECT DISTINCT {_DKEY} AS depositante_id, codigo_interno FROM pt_depositors WHERE tipopessoadepositante = 'pessoa física'
""")(lambda I: G.depositor_edges(I.patent_part("depositantes")))
register("company_filed_edges", """
SELECT DISTINCT cnpj_basico_resolved AS cnpj_basico, codigo_interno FROM pt_depositors
WHERE cnpj_basico_resolved IS NOT NULL AND cnpj_basico_resolved IN (SELECT cnpj_basico FROM g_company_nodes)
""")(lambda I: G.company_filed_edges(I.patent_part("depositantes"), G.company_nodes(I.companies, I.partners)))
register("patent_link_edges", """
SELECT DISTINCT codigo_interno, codigo_interno_vinculado, tipo_vinculo FROM pt_links
WHERE codigo_interno IN (SELECT codigo_interno FROM pt_bib)
  AND codigo_interno_vinculado IN (SELECT codigo_interno FROM pt_bib)
""")(lambda I: G.patent_link_edges(I.patent_part("vinculos"), I.patents))

# project graph ----------------------------------------------------------------

register("proposed_edges", """
SELECT DISTINCT id, left(regexp_replace(COALESCE(cnpj_proponente, ''), '[^0-9]', '', 'g'), 8) AS cnpj_basico
FROM f_direct
WHERE length(left(regexp_replace(COALESCE(cnpj_proponente, ''), '[^0-9]', '', 'g'), 8)) = 8
  AND left(regexp_replace(COALESCE(cnpj_proponente, ''), '[^0-9]', '', 'g'), 8) IN (SELECT cnpj_basico FROM g_company_nodes)
""")(lambda I: G.project_edges(I.funding("direct"), G.company_nodes(I.companies, I.partners))[0])
register("project_nodes", """
SELECT 'direct-' || f_contract || '-' || f_ref AS id, f_title AS titulo, f_instrument AS instrumento, f_status AS status, f_approved AS valor_aprovado FROM fbase
WHERE l_returnflag = 'R' AND f_instrument IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f_contract, f_ref ORDER BY l_partkey) = 1
""")(lambda I: G.project_nodes(I.funding("direct")))

# every third project is executed by the company of another one of its contract
_EXECUTED = """
WITH p AS (SELECT id, left(regexp_replace(COALESCE(cnpj_proponente, ''), '[^0-9]', '', 'g'), 8) AS prop, contrato::BIGINT AS c FROM f_direct),
x AS (SELECT id, prop, CASE WHEN c % 3 = 0 THEN lpad((c % 1500)::VARCHAR, 8, '0') WHEN c % 3 = 1 THEN prop ELSE 'x1' END AS exec FROM p)
SELECT DISTINCT id, regexp_replace(exec, '[^0-9]', '', 'g') AS cnpj_basico FROM x
WHERE length(regexp_replace(exec, '[^0-9]', '', 'g')) = 8 AND exec <> prop AND exec IN (SELECT cnpj_basico FROM g_company_nodes)
"""


def _with_executors(I):
    c = F.col("contrato").cast("bigint")
    other = F.concat(F.lpad((c % 1500).cast("string"), 8, "0"), F.lit("/0001-00"))
    return I.funding("direct").withColumn("cnpj_executor", F.when(c % 3 == 0, other).when(c % 3 == 1, F.col("cnpj_proponente")).otherwise(F.lit("x1")))


register("executed_edges", _EXECUTED)(lambda I: G.project_edges(_with_executors(I), G.company_nodes(I.companies, I.partners))[1])
register("gq_intermediaries", f"""
SELECT e.cnpj_basico, count(DISTINCT e.id) AS projects FROM ({_EXECUTED}) e
WHERE e.cnpj_basico NOT IN (SELECT left(regexp_replace(COALESCE(cnpj_proponente, ''), '[^0-9]', '', 'g'), 8) FROM f_direct) GROUP BY e.cnpj_basico
""")(lambda I: _intermediaries(I))


def _intermediaries(I):
    """GRA-18: companies that execute projects and propose none."""
    proposed, executed = G.project_edges(_with_executors(I), G.company_nodes(I.companies, I.partners))
    return executed.join(proposed.select("cnpj_basico").distinct(), "cnpj_basico", "left_anti").groupBy("cnpj_basico").agg(F.count_distinct("id").alias("projects"))


# maintenance ------------------------------------------------------------------

REPAIR_SQL = """
WITH legacy AS (
  SELECT md5(cpf_cnpj_socio || '|' || nome_socio_razao_social) AS pessoa_id, cpf_cnpj_socio, identificador_socio,
         cnpj_basico, reference_month
  FROM socio WHERE cpf_cnpj_socio IS NOT NULL AND nome_socio_razao_social IS NOT NULL)
SELECT DISTINCT left(regexp_replace(l.cpf_cnpj_socio, '[^0-9]', '', 'g'), 8) AS cnpj_socio_basico, l.cnpj_basico,
       l.reference_month
FROM legacy l WHERE l.identificador_socio = 1 AND length(regexp_replace(l.cpf_cnpj_socio, '[^0-9]', '', 'g')) >= 14
  AND left(regexp_replace(l.cpf_cnpj_socio, '[^0-9]', '', 'g'), 8) IN (SELECT cnpj_basico FROM g_company_nodes)
"""


def _repair(I):
    """Legacy graph: every partner with an id became a person node; the
    repair turns kind-1 persons into company edges."""
    p = I.partners.filter(F.col("cpf_cnpj_socio").isNotNull() & F.col("nome_socio_razao_social").isNotNull())
    p = p.withColumn("pessoa_id", F.md5(F.concat_ws("|", "cpf_cnpj_socio", "nome_socio_razao_social")))
    nodes = p.groupBy("pessoa_id").agg(F.first("cpf_cnpj_socio").alias("cpf_cnpj_socio"),
                                       F.first("identificador_socio").alias("identificador_socio"))
    edges = p.select("pessoa_id", "cnpj_basico", "reference_month").distinct()
    new_edges, _kept = G.repair_company_persons(nodes, edges, G.company_nodes(I.companies, I.partners))
    return new_edges


register("repair_company_persons", REPAIR_SQL)(_repair)

register("drop_label", """
SELECT 'C:' || cnpj_basico AS id, 'Empresa' AS label FROM g_company_nodes
UNION ALL SELECT 'P:' || pessoa_id, 'Pessoa' FROM g_person_nodes
""")(lambda I: G.drop_label(
    G.company_nodes(I.companies, I.partners).select(F.concat(F.lit("C:"), "cnpj_basico").alias("id"),
                                                    F.lit("Empresa").alias("label"))
    .unionByName(G.person_nodes(I.partners).select(F.concat(F.lit("P:"), "pessoa_id").alias("id"),
                                                   F.lit("Pessoa").alias("label")))
    .unionByName(G.establishment_nodes(I.establishments).select(F.concat(F.lit("E:"), "cnpj_14").alias("id"),
                                                                F.lit("Estabelecimento").alias("label"))),
    G.ownership_edges(I.partners), "Estabelecimento")[0])

register("drop_label_edges", "SELECT * FROM g_edges WHERE starts_with(src, 'C:') AND starts_with(dst, 'C:')")(lambda I: G.drop_label(
    G.company_nodes(I.companies, I.partners).select(F.concat(F.lit("C:"), "cnpj_basico").alias("id"), F.lit("Empresa").alias("label"))
    .unionByName(G.person_nodes(I.partners).select(F.concat(F.lit("P:"), "pessoa_id").alias("id"), F.lit("Pessoa").alias("label"))),
    G.ownership_edges(I.partners), "Pessoa")[1].select("type", "src", "dst", "reference_month"))

# documented graph queries --------------------------------------------------------

AGE_BAND_SQL = """
WITH paths AS (
  SELECT s.seed, e1.src AS p FROM g_all_companies s JOIN g_edges e1 ON e1.dst = s.seed
  UNION ALL
  SELECT s.seed, e2.src FROM g_all_companies s JOIN g_edges e1 ON e1.dst = s.seed JOIN g_edges e2 ON e2.dst = e1.src)
SELECT p.seed, n.nome, n.faixa_etaria, COUNT(*) AS empresas_vinculadas
FROM paths p JOIN g_person_nodes n ON p.p = 'P:' || n.pessoa_id WHERE n.faixa_etaria >= 8
GROUP BY p.seed, n.pessoa_id, n.nome, n.faixa_etaria
"""


def _age_band(I):
    e = G.ownership_edges(I.partners).select("src", "dst")
    seeds = G.company_nodes(I.companies, I.partners).select(F.concat(F.lit("C:"), "cnpj_basico").alias("seed"))
    one = seeds.join(e, e.dst == seeds.seed).select("seed", F.col("src").alias("p"), F.col("src").alias("mid"))
    two = one.join(e.withColumnRenamed("src", "p2").withColumnRenamed("dst", "mid"), "mid").select(
        "seed", F.col("p2").alias("p"))
    paths = one.select("seed", "p").unionByName(two)
    pn = G.person_nodes(I.partners).select(F.concat(F.lit("P:"), "pessoa_id").alias("p"), "pessoa_id", "nome",
                                           "faixa_etaria").filter(F.col("faixa_etaria") >= 8)
    return paths.join(pn, "p").groupBy("seed", "pessoa_id", "nome", "faixa_etaria").agg(
        F.count(F.lit(1)).alias("empresas_vinculadas")).drop("pessoa_id")


register("gq_age_band", AGE_BAND_SQL)(_age_band)

register("gq_holdings", """
SELECT h.razao_social AS holding, c.razao_social AS empresa, e.qualificacao_socio, e.reference_month
FROM g_company_edges e JOIN g_company_nodes h ON h.cnpj_basico = e.cnpj_socio_basico
JOIN g_company_nodes c ON c.cnpj_basico = e.cnpj_basico
""")(lambda I: G.company_edges(I.partners).alias("e")
     .join(G.company_nodes(I.companies, I.partners).select(F.col("cnpj_basico").alias("cnpj_socio_basico"),
                                                            F.col("razao_social").alias("holding")),
           "cnpj_socio_basico")
     .join(G.company_nodes(I.companies, I.partners).select("cnpj_basico", F.col("razao_social").alias("empresa")),
           "cnpj_basico")
     .select("holding", "empresa", "qualificacao_socio", "reference_month"))

register("gq_company_patents", """
SELECT f.cnpj_basico, b.numero_inpi, c.titulo, b.tipo_patente, b.data_deposito
FROM (SELECT DISTINCT cnpj_basico_resolved AS cnpj_basico, codigo_interno FROM pt_depositors
      WHERE cnpj_basico_resolved IN (SELECT cnpj_basico FROM g_company_nodes)) f
JOIN pt_bib b ON b.codigo_interno = f.codigo_interno LEFT JOIN pt_content c ON c.codigo_interno = f.codigo_interno
""")(lambda I: G.company_filed_edges(I.patent_part("depositantes"), G.company_nodes(I.companies, I.partners))
     .join(G.patent_nodes(I.patents, I.patent_part("conteudo")), "codigo_interno")
     .select("cnpj_basico", "numero_inpi", "titulo", "tipo_patente", "data_deposito"))

register("gq_ipc_overlap", """
SELECT i.grupo, f.cnpj_basico, COUNT(*) AS patents
FROM (SELECT DISTINCT cnpj_basico_resolved AS cnpj_basico, codigo_interno FROM pt_depositors
      WHERE cnpj_basico_resolved IN (SELECT cnpj_basico FROM g_company_nodes)) f
JOIN (SELECT DISTINCT codigo_interno, left(simbolo, 4) AS grupo FROM pt_ipc WHERE simbolo IS NOT NULL) i
  ON i.codigo_interno = f.codigo_interno
GROUP BY i.grupo, f.cnpj_basico
""")(lambda I: G.company_filed_edges(I.patent_part("depositantes"), G.company_nodes(I.companies, I.partners))
     .join(G.classified_edges(I.patent_part("ipc")), "codigo_interno")
     .groupBy("grupo", "cnpj_basico").agg(F.count(F.lit(1)).alias("patents")))


_LINK_CHAIN = """
WITH RECURSIVE link AS (SELECT DISTINCT codigo_interno AS a, codigo_interno_vinculado AS b FROM pt_links),
walk AS (SELECT a AS start, b AS origem, 1 AS hops, [a, b] AS path, [a || '>' || b] AS used FROM link
  UNION ALL SELECT start, link.b, hops + 1, list_append(path, link.b), list_append(used, a || '>' || link.b)
  FROM walk JOIN link ON link.a = origem WHERE hops < 5 AND NOT list_contains(used, a || '>' || link.b))
SELECT start, origem, hops, path FROM walk
"""


def _link_chain(I, max_hops: int = 5):
    """Patent derivation chains of 1..5 links, none of them twice: one join
    per extra hop, the path kept as an array."""
    links = G.patent_link_edges(I.patent_part("vinculos"), I.patents).select(
        F.col("codigo_interno").alias("a"), F.col("codigo_interno_vinculado").alias("b")).distinct()
    cur = links.select(F.col("a").alias("start"), F.col("b").alias("origem"), F.lit(1).alias("hops"),
                       F.array("a", "b").alias("path"))
    out = cur
    for h in range(2, max_hops + 1):
        # a path takes a link once: the step (origem, b) must not be on it yet
        steps = F.zip_with(F.slice("path", 1, h - 1), F.slice("path", 2, h - 1), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
        cur = cur.join(links, cur.origem == links.a).filter(
            ~F.array_contains(steps, F.struct(F.col("origem").alias("a"), F.col("b").alias("b")))).select(
            "start", F.col("b").alias("origem"), F.lit(h).alias("hops"), F.concat("path", F.array("b")).alias("path"))
        out = out.unionByName(cur)
    return out


register("gq_link_chain", _LINK_CHAIN)(_link_chain)
