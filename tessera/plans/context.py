"""Lazily built input tables for the registered queries.

``Inputs(spark, sf_dir)`` exposes the proxy inputs and the cleaned tables as
DataFrames. Nothing is computed until a query runs an action; each property
returns the same lazy plan every time it is asked for.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import registry as R
from tessera.operators.common import with_month
from tessera.sources import proxies as P


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str, month: str = P.DEFAULT_MONTH):
        self.spark = spark
        self.sf_dir = sf_dir
        self.month = month

    def table(self, name: str) -> DataFrame:
        return P.table(self.spark, self.sf_dir, name)

    # registry ----------------------------------------------------------
    @cached_property
    def companies(self) -> DataFrame:
        return with_month(R.clean_companies(P.raw_company(self.spark, self.sf_dir)), self.month)

    @cached_property
    def establishments(self) -> DataFrame:
        return with_month(R.clean_establishments(P.raw_estab(self.spark, self.sf_dir)), self.month)

    @cached_property
    def partners(self) -> DataFrame:
        return with_month(R.clean_partners(P.raw_partner(self.spark, self.sf_dir)), self.month)

    @cached_property
    def tax(self) -> DataFrame:
        return R.clean_tax_regime(P.raw_tax(self.spark, self.sf_dir))

    def lookup(self, kind: str) -> DataFrame:
        return R.clean_lookup(P.raw_lookup(self.spark, self.sf_dir, kind), kind)

    @cached_property
    def cnaes(self) -> DataFrame:
        return self.lookup("cnaes")

    @cached_property
    def motivos(self) -> DataFrame:
        return self.lookup("motivos")

    @cached_property
    def municipios(self) -> DataFrame:
        return self.lookup("municipios")

    @cached_property
    def naturezas(self) -> DataFrame:
        return self.lookup("naturezas")

    @cached_property
    def paises(self) -> DataFrame:
        return self.lookup("paises")

    @cached_property
    def qualificacoes(self) -> DataFrame:
        return self.lookup("qualificacoes")

    @cached_property
    def active_view(self) -> DataFrame:
        return R.search_view_active(self.companies, self.establishments, self.municipios,
                                    self.cnaes, self.naturezas)

    @cached_property
    def inactive_view(self) -> DataFrame:
        return R.search_view_inactive(self.companies, self.establishments, self.municipios,
                                      self.cnaes, self.naturezas)

    def stored_view(self, kind: str) -> DataFrame:
        """SNK-9: a view (``active``, ``inactive``, ``patents`` or the enriched
        funding ``records``) as a stored table, built by the first request and
        read by the others until an input changes; ``refresh_views`` builds
        it anew beside the served version."""
        return self._stored(kind).read(lambda: self._view(kind))

    def refresh_views(self, *kinds: str) -> None:
        """Replace stored views by what the tables hold now."""
        for kind in kinds or ("active", "inactive", "patents"):
            self._stored(kind).refresh(self._view(kind))

    def _view(self, kind: str) -> DataFrame:
        from tessera.session import stage_table
        if kind == "records":
            return self._enriched()
        if kind == "patents":
            return self.patent_view
        build = R.search_view_active if kind == "active" else R.search_view_inactive
        view = stage_table(build(self.companies, self._head_offices(), self.municipios, self.cnaes, self.naturezas), kind)
        # ordered by id, so that an id or prefix reads few files and row groups;
        # staged, as dealing rows out by range makes them twice
        return view.repartitionByRange("cnpj_14").sortWithinPartitions("cnpj_14")

    def _head_offices(self) -> DataFrame:
        """The establishments that the views are made of, written once for a
        version of the inputs."""
        from tessera.sources.stored import StoredTable
        store = StoredTable(self.spark, f"{self._stored_root}/head_offices")
        return store.read(lambda: self.establishments.filter("identificador_matriz_filial = 1").select(
            "cnpj_basico", "cnpj_ordem", "cnpj_dv", "identificador_matriz_filial", "nome_fantasia", "situacao_cadastral",
            "codigo_municipio", "uf", "cnae_fiscal_principal", "data_inicio_atividade", "correio_eletronico"))

    @cached_property
    def staged_partners(self) -> DataFrame:
        """The partner columns that the graph is made of, written once for the
        tables that read them."""
        from tessera.session import stage_table
        return stage_table(self.partners.select(
            "cnpj_basico", "identificador_socio", "nome_socio_razao_social", "cpf_cnpj_socio", "qualificacao_socio",
            "data_entrada_sociedade", "faixa_etaria", "reference_month"), "partners")

    @cached_property
    def _stored_root(self) -> str:
        """Where tables derived from these inputs are kept: by application,
        month, and the files of the inputs as they are now."""
        from tessera.session import ensure_checkpoint_dir
        from tessera.sources.stored import input_version
        tables = [f"{self.sf_dir}/{t}.parquet" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")]
        version = input_version(self.spark, tables)
        key = hashlib.sha1(f"{self.spark.sparkContext.applicationId}|{self.sf_dir}|{self.month}|{version}".encode()).hexdigest()[:16]
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/stored/{key}"

    def _stored(self, kind: str):
        from tessera.sources.stored import StoredTable
        return StoredTable(self.spark, f"{self._stored_root}/{kind}")

    @property
    def graph(self):
        """SNK-11: the ownership graph as stored tables, built by the first
        request."""
        from tessera.operators import graph as G
        from tessera.operators.graph_store import GraphStore
        store = GraphStore(self.spark, f"{self._stored_root}/graph")
        if not store.ready():
            partners = self.staged_partners
            store.write(G.ownership_edges(partners), G.company_nodes(self.companies, partners), G.person_nodes(partners))
        return store

    # funding -----------------------------------------------------------
    def funding(self, source: str) -> DataFrame:
        from tessera.operators import funding as FU
        return FU.read_funding_sheet(P.raw_funding(self.spark, self.sf_dir, source), source)

    def disbursements(self, source: str) -> DataFrame:
        from tessera.operators import funding as FU
        return FU.read_disbursements(P.raw_disbursement(self.spark, self.sf_dir, source), source)

    @property
    def records(self) -> DataFrame:
        """SET-1 + JOIN-7: enriched project records, stored: a request reads
        the columns it needs."""
        return self.stored_view("records")

    def _enriched(self) -> DataFrame:
        from tessera.operators import funding as FU
        from tessera.session import stage_table
        recs = FU.project_records(self.funding("direct"), self.funding("credit"),
                                  self.funding("equity"), self.funding("audiovisual"))
        # staged: the lookup reads their ids, the join reads the rows
        return FU.enrich_records(stage_table(recs, "projects"), self.stored_view("active"), self.stored_view("inactive"))

    @cached_property
    def tiered_view(self) -> DataFrame:
        return R.search_view_tiered(self.companies, self.establishments, self.municipios,
                                    self.cnaes, self.naturezas)

    @cached_property
    def geo_muni(self) -> DataFrame:
        return P.geo_muni(self.spark, self.sf_dir)

    @cached_property
    def geo_state(self) -> DataFrame:
        return P.geo_state(self.spark, self.sf_dir)

    # patents -----------------------------------------------------------
    SNAPSHOT = "2024-01-31"

    def raw_patent(self, name: str) -> DataFrame:
        return P.raw_patent(self.spark, self.sf_dir, name)

    @cached_property
    def patents(self) -> DataFrame:
        from tessera.operators import patents as PT
        return PT.clean_patents(self.raw_patent("bibliografia"), self.SNAPSHOT)

    def patent_part(self, name: str) -> DataFrame:
        from tessera.operators import patents as PT
        fn = {"conteudo": PT.clean_patent_content, "inventores": PT.clean_inventors,
              "depositantes": PT.clean_depositors, "ipc": PT.clean_ipc, "despachos": PT.clean_dispatches,
              "procuradores": PT.clean_attorneys, "prioridades": PT.clean_priorities,
              "vinculos": PT.clean_links, "renumeracoes": PT.clean_renumberings}[name]
        return fn(self.raw_patent(name), self.patents)

    @cached_property
    def ipc_dim(self) -> DataFrame:
        return P.raw_ipc_dim(self.spark, self.sf_dir)

    @cached_property
    def patent_view(self) -> DataFrame:
        from tessera.operators import patents as PT
        return PT.patent_search_view(self.patents, self.patent_part("conteudo"), self.patent_part("inventores"),
                                     self.patent_part("depositantes"), self.patent_part("ipc"))

    @cached_property
    def by_municipality(self) -> DataFrame:
        from tessera.operators import funding as FU
        return FU.funding_by_municipality(self.records, self.geo_muni)
