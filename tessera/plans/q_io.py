"""Source, sink and stream round trips through files; what comes back is
checked against the tables that went in. Scratch data lives under the session's checkpoint directory, the
shared folder a cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import registry as R
from tessera.plans.catalog import register
from tessera.sources import proxies as P
from tessera.sources import readers as RD
from tessera.sources import sinks as S


def scratch(spark, name: str) -> str:
    from tessera.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-io/{name}-{uuid.uuid4().hex[:12]}"


def _dump_round_trip(I, raw, kind: str, clean):
    path = RD.write_dump(raw, scratch(I.spark, kind))
    return clean(RD.read_dump(I.spark, path, kind))


register("src_company_csv", "SELECT * EXCLUDE (reference_month) FROM empresa")(lambda I: _dump_round_trip(I, P.raw_company(I.spark, I.sf_dir), "empresas",
                                                       R.clean_companies))
register("src_establishment_csv", "SELECT * EXCLUDE (reference_month) FROM estab")(lambda I: _dump_round_trip(I, P.raw_estab(I.spark, I.sf_dir), "estabelecimentos",
                                                             R.clean_establishments))
register("src_partner_csv", "SELECT * EXCLUDE (reference_month) FROM socio")(lambda I: _dump_round_trip(I, P.raw_partner(I.spark, I.sf_dir), "socios",
                                                       R.clean_partners))
register("src_tax_csv", "SELECT * FROM simples")(lambda I: _dump_round_trip(I, P.raw_tax(I.spark, I.sf_dir), "simples", R.clean_tax_regime))

for _key, _kind, _table in [("src_lookup_csv", "municipios", "lk_municipio"), ("src_lookup_csv_cnaes", "cnaes", "lk_cnae"),
                            ("src_lookup_csv_motivos", "motivos", "lk_motivo"), ("src_lookup_csv_naturezas", "naturezas", "lk_natureza"),
                            ("src_lookup_csv_paises", "paises", "lk_pais"), ("src_lookup_csv_qualificacoes", "qualificacoes", "lk_qualificacao")]:
    register(_key, f"SELECT * FROM {_table}")((lambda kind: lambda I: _dump_round_trip(
        I, P.raw_lookup(I.spark, I.sf_dir, kind), "lookup", lambda d: R.clean_lookup(d, kind)))(_kind))


def _patent_csv(I):
    raw = P.raw_patent(I.spark, I.sf_dir, "bibliografia").drop("_row")
    raw = raw.toDF(*[f" {c.upper()} " for c in raw.columns])
    path = scratch(I.spark, "patentes")
    raw.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)
    return RD.read_patent_csv(I.spark, path)


register("src_patent_csv", "SELECT nullif(COLUMNS(* EXCLUDE (_row)), '') FROM raw_pt_bib")(_patent_csv)


def _actors(I):
    """The platform's payloads written as documents of nine arrays, and read."""
    from tessera.sources import org_payload as OP
    from tessera.sources.proxies_orgs import raw_actors, raw_orgs
    path = OP.write_org_payload(raw_actors(raw_orgs(I.spark, I.sf_dir)), scratch(I.spark, "orgs"))
    return OP.read_org_payload(I.spark, path)


register("src_org_json", """
SELECT manifest_id, collection, rid::VARCHAR AS id, CASE WHEN org_named.id % 9 > 0 THEN cidade END AS city, CASE WHEN org_named.id % 9 > 0 THEN uf END AS uf,
  CASE WHEN org_named.id % 9 > 0 THEN latitude END AS latitude FROM org_named WHERE collection <> 'others'
""")(lambda I: _actors(I).select(
    "manifest_id", "collection", "actor.id", F.col("actor.address.city.name").alias("city"), F.col("actor.address.city.state.uf").alias("uf"),
    F.col("actor.address.latitude").cast("double").alias("latitude")))


def _flatten(I):
    from tessera.operators.orgs import organization_rows
    rows = organization_rows(_actors(I))
    # the payload by what it must hold: JSON texts of two engines differ in numbers
    return rows.select("*", F.get_json_object("raw_payload", "$.api").alias("api"), F.get_json_object("raw_payload", "$.address.city.state.uf").alias("payload_uf")).drop("raw_payload")


register("flatten_orgs", """
SELECT manifest_id, collection AS source_collection, rid::BIGINT AS source_record_id,
  CASE WHEN collection LIKE '%Companies' THEN 'company' WHEN collection LIKE '%Parks' THEN 'park' ELSE rtrim(collection, 's') END AS entity_kind,
  nullif(rid % 9, 0)::INT AS category_id,
  MAP {'incubators': 'Incubadora', 'accelerators': 'Aceleradora', 'operationParks': 'Parque em Operacao', 'implantationParks': 'Parque em Implantacao',
       'planningParks': 'Parque em Planejamento', 'incubatedCompanies': 'Empresa Incubada', 'acceleratedCompanies': 'Empresa Acelerada',
       'graduatedCompanies': 'Empresa Graduada', 'residentCompanies': 'Empresa Residente'}[collection] AS category_label,
  linkable_type AS source_linkable_type, linkable_id::BIGINT AS source_linkable_id,
  CASE WHEN rid % 10 = 0 THEN 'source-record-' || rid ELSE nome END AS name, sigla AS acronym, nullif(razao_social, '') AS corporate_name,
  CASE WHEN rid % 7 > 0 THEN regexp_replace(cnpj, '[^0-9]', '', 'g') END AS cnpj, '55' || rid AS telephone, rid || '@org.br' AS email,
  CASE WHEN rid % 2 = 1 THEN 'https://org.br/' END AS site, CASE WHEN rid % 3 = 0 THEN 'a' END AS instagram, 'in' AS linkedin, 'logo.png' AS logo_path,
  CASE WHEN rid % 2 = 0 THEN 'UFX' END AS institution, [true, true, false, NULL, false][rid % 5 + 1] AS active, (rid % 7)::INT AS company_status_id,
  [12, NULL, 7, NULL][rid % 4 + 1] AS cnae_id, rid % 2 = 0 AS graduated, (1990 + rid % 30)::SMALLINT AS founding_year,
  [DATE '2019-03-05', DATE '2020-02-29', NULL, NULL][rid % 4 + 1] AS founding_date, (CASE WHEN rid % 2 = 0 THEN 2021 END)::SMALLINT AS termination_year,
  (2000 + rid % 9)::SMALLINT AS pre_acceleration_year, (CASE WHEN rid % 2 = 0 THEN 2001 END)::SMALLINT AS acceleration_year,
  (CASE WHEN rid % 2 = 1 THEN 2002 END)::SMALLINT AS pre_incubation_year, 2003::SMALLINT AS start_incubation_year, NULL::SMALLINT AS end_incubation_year,
  rid % 4 = 1 AS spin_off, CASE WHEN rid % 8 > 0 THEN ['tech', areas[3]] ELSE [] END AS expertise_area_codes,
  CASE WHEN rid % 2 = 0 THEN '[{"id":' || (rid % 5) || '}]' ELSE '[]' END AS affiliated_societies_cities, '[]' AS motivations_for_opening,
  CASE WHEN rid % 3 = 1 THEN '["a"]' ELSE '[]' END AS main_participation_aspects, (rid % 3)::INT AS meet_way_id,
  CASE WHEN here THEN lpad((rid % 99999) || '00', 8, '0') END AS postcode, CASE WHEN here THEN 'Rua ' || (rid % 300) END AS street,
  CASE WHEN here THEN (rid % 2000)::VARCHAR END AS street_number, CASE WHEN here AND rid % 3 > 0 THEN 'Sala 1' END AS complement,
  CASE WHEN here THEN 'Centro' END AS neighborhood, CASE WHEN here THEN (1000000 + rid)::VARCHAR END AS city_ibge_code, CASE WHEN here THEN trim(cidade) END AS city_name,
  CASE WHEN here THEN lpad((rid % 90)::VARCHAR, 2, '0') END AS state_ibge_code, CASE WHEN here THEN estado END AS state_name, CASE WHEN here THEN uf END AS state_abbrev,
  CASE WHEN here THEN latitude::DECIMAL(10, 7) END AS latitude, CASE WHEN here AND rid % 17 > 0 THEN longitude::DECIMAL(10, 7) END AS longitude,
  date_trunc('second', collected_at) AS source_created_at, CASE WHEN rid % 6 > 0 THEN date_trunc('second', collected_at) END AS source_updated_at,
  CASE WHEN id % 50 = 0 THEN '[REDACTED]' END AS api, CASE WHEN here THEN uf END AS payload_uf
FROM (SELECT *, id % 9 > 0 AS here FROM org_named) WHERE collection <> 'others'
""")(_flatten)
register("src_geography", "SELECT codigo, nome, uf, 5 AS points, x0, y0 FROM geo_muni")(lambda I: RD.read_geography(
    I.geo_muni.select(F.col("codigo").alias("CD_MUN"), F.col("nome").alias("NM_MUN"), F.col("uf").alias("SIGLA_UF"),
                      "rings")).select("codigo", "nome", "uf", F.size(F.col("rings")[0]).alias("points"), F.col("rings")[0][0]["x"].alias("x0"),
                                       F.col("rings")[0][0]["y"].alias("y0")))


def _sink_parquet(I):
    path = scratch(I.spark, "stage")
    S.write_stage(I.companies, path, I.month)
    S.write_stage(I.companies, path, I.month)  # re-run replaces the month, no duplicates
    return S.read_stage(I.spark, path, I.month)


register("sink_parquet", "SELECT * FROM empresa")(_sink_parquet)
register("scan_month", "SELECT * FROM empresa")(lambda I: _sink_parquet(I).filter(F.col("reference_month") == I.month))


def _list_months(I):
    path = scratch(I.spark, "months")
    S.write_stage(I.companies.withColumn("reference_month", F.lit("2024-01")), path, "2024-01")
    S.write_stage(I.companies.withColumn("reference_month", F.lit("2024-02")), path, "2024-02")
    return S.list_months(I.spark, path)


register("list_months", "SELECT unnest(['2024-01', '2024-02']) AS reference_month FROM (SELECT 1) WHERE EXISTS (FROM empresa)")(_list_months)


def _append_month(I):
    path = scratch(I.spark, "append")
    first = S.append_month(I.tax, path, I.month)
    second = S.append_month(I.tax, path, I.month)  # skipped: the month is loaded
    assert first and not second
    return S.read_stage(I.spark, path)


register("append_month", "SELECT *, '2024-01' AS reference_month FROM simples")(_append_month)


def _lookup_once(I):
    path = scratch(I.spark, "lookup")
    S.load_lookup_once(I.cnaes, path)
    S.load_lookup_once(I.cnaes, path)
    return I.spark.read.parquet(path)


register("load_lookup_once", "SELECT * FROM lk_cnae")(_lookup_once)


def _ensure_stage(I):
    from tessera.sources.sinks import ensure_stage
    path = scratch(I.spark, "ensure")
    return ensure_stage(I.spark, path, lambda: I.tax)


register("ensure_stage", "SELECT * FROM simples")(_ensure_stage)
def _table_scan(I):
    """SRC-14: parameterised SELECT over a registered view."""
    I.companies.createOrReplaceTempView("empresa")
    return I.spark.sql("SELECT * FROM empresa WHERE porte_empresa = :p", args={"p": "01"})


register("table_scan", "SELECT * FROM empresa WHERE porte_empresa = '01'")(_table_scan)


def _stream_dumps(I):
    from tessera.streaming.streams import stream_dumps
    raw = P.raw_estab(I.spark, I.sf_dir)
    src = scratch(I.spark, "arrivals")
    for part in range(3):  # three files arrive
        RD.write_dump(raw.filter(F.col("c1").cast("int") % 3 == part), f"{src}/f{part}")
    out, ck = scratch(I.spark, "stream-out"), scratch(I.spark, "stream-ck")
    stream_dumps(I.spark, f"{src}/*", RD.dump_schema(30), R.clean_establishments, out, ck, I.month)
    return I.spark.read.parquet(out).drop("batch_id")


register("stream_dumps", "SELECT * FROM estab")(_stream_dumps)


def _stream_manifest(I):
    from tessera.sources.proxies_quality import manifest_events
    from tessera.streaming.streams import read_upserted, stream_keyed_latest
    ev = manifest_events(I.spark, I.sf_dir)
    src = scratch(I.spark, "manifest-events")
    ev.write.mode("overwrite").parquet(src)
    tbl, ck = scratch(I.spark, "manifest"), scratch(I.spark, "manifest-ck")
    keys, order = ["reference_month", "file_name"], [F.col("updated_at").desc(), F.col("id").desc()]
    stream_keyed_latest(I.spark, src, ev.schema, keys, order, tbl, ck)
    return read_upserted(I.spark, tbl, ev.schema, keys, order)


register("stream_manifest", "SELECT * FROM manifest")(_stream_manifest)


def _stream_latest_orgs(I):
    from tessera.operators.orgs import flatten_orgs
    from tessera.sources.proxies_orgs import raw_orgs
    from tessera.streaming.streams import read_upserted, stream_keyed_latest
    orgs = flatten_orgs(raw_orgs(I.spark, I.sf_dir)).drop("areas")
    src = scratch(I.spark, "org-snapshots")
    orgs.write.mode("overwrite").partitionBy("manifest_id").parquet(src)
    snap = I.spark.read.parquet(src)
    tbl, ck = scratch(I.spark, "orgs-latest"), scratch(I.spark, "orgs-ck")
    keys, order = ["collection", "record_id"], [F.col("collected_at").desc(), F.col("id").desc()]
    stream_keyed_latest(I.spark, src, snap.schema, keys, order, tbl, ck)
    return read_upserted(I.spark, tbl, snap.schema, keys, order).withColumn("manifest_id", F.col("manifest_id").cast("string"))


register("stream_latest_orgs", "SELECT * EXCLUDE (areas) FROM orgs_latest")(_stream_latest_orgs)
