"""Data-quality, manifest and load-semantics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import quality as Q
from tessera.operators.common import first_by
from tessera.plans.catalog import register
from tessera.plans.oracle_base import CTES, MATERIALIZE
from tessera.sources import proxies_quality as PQ
from tessera.sources import sinks as S
from tessera.sources.proxies_quality import FILE_FAMILY

_FAM = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in FILE_FAMILY.items()) + " END"

CTES["mf_events"] = f"""
SELECT id, reference_month, file_name, lower(regexp_replace(file_name, '[0-9]+[.]zip$', '')) AS file_type,
  file_size_bytes, download_date, extracted_at, transformed_at, loaded_postgres_at, loaded_neo4j_at,
  CASE WHEN id % 7 = 0 THEN 'failed' WHEN loaded_postgres_at IS NOT NULL THEN 'loaded' ELSE 'pending' END AS processing_status,
  rows_transformed, CASE WHEN loaded_postgres_at IS NOT NULL THEN rows_transformed END AS rows_loaded_postgres,
  processing_duration_seconds, updated_at
FROM (SELECT event_id AS id, '2024-' || LPAD(CAST(user_id % 12 + 1 AS VARCHAR), 2, '0') AS reference_month,
        {_FAM} || CAST(user_id % 10 AS VARCHAR) || '.zip' AS file_name,
        CAST(floor(value * 1000000) AS BIGINT) AS file_size_bytes, ts AS download_date,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR END AS extracted_at,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + INTERVAL 2 HOUR END AS transformed_at,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 3 HOUR END AS loaded_postgres_at,
        CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts + INTERVAL 4 HOUR END AS loaded_neo4j_at,
        user_id * 100 AS rows_transformed, value AS processing_duration_seconds, ts AS updated_at
      FROM events) t
"""

CTES["manifest"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY reference_month, file_name
  ORDER BY updated_at DESC, id DESC) AS rn FROM mf_events) t WHERE rn = 1
"""

CTES["downloads"] = """
SELECT event_type AS dataset, event_id AS id, ts AS downloaded_at, md5(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS checksum,
  'W/' || md5(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS etag, date_trunc('day', ts) AS last_modified,
  CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'success' END AS status FROM events
"""

CTES["remote"] = """
SELECT event_type AS dataset, CASE WHEN event_type IN ('view', 'click') THEN 'W/new' END AS etag,
  CASE WHEN event_type = 'signup' THEN max(date_trunc('day', ts)) + INTERVAL 1 DAY ELSE max(date_trunc('day', ts)) END AS last_modified
FROM events GROUP BY event_type
"""

MATERIALIZE.update({"manifest"})


def _manifest(I):
    ev = PQ.manifest_events(I.spark, I.sf_dir)
    return Q.mark_stage(ev.filter(F.col("id") % 2 == 0), ev.filter(F.col("id") % 2 == 1))


register("mark_stage", "SELECT * FROM manifest")(_manifest)
register("register_files", "SELECT reference_month, file_name, file_type FROM manifest")(
    lambda I: _manifest(I).select("reference_month", "file_name", "file_type"))
register("manifest_scan", "SELECT COUNT(*) AS n, COUNT(DISTINCT reference_month) AS months FROM manifest")(
    lambda I: _manifest(I).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("reference_month").alias("months")))
register("fn_file_type", "SELECT DISTINCT file_name, file_type FROM mf_events")(
    lambda I: PQ.manifest_events(I.spark, I.sf_dir).select("file_name", "file_type").distinct())

# measures per (month, type) from one row a file and state
register("download_progress", """
WITH marked AS (SELECT *, CASE processing_status WHEN 'loaded' THEN 1 ELSE 0 END AS l, CASE processing_status WHEN 'failed' THEN 1 ELSE 0 END AS f,
                       CASE processing_status WHEN 'pending' THEN 1 ELSE 0 END AS p FROM manifest)
SELECT reference_month, file_type, count() AS total_files, sum(l) AS completed, sum(f) AS failed, sum(p) AS pending,
       count(extracted_at) AS extracted, count(transformed_at) AS transformed, count(loaded_postgres_at) AS loaded_postgres,
       count(loaded_neo4j_at) AS loaded_neo4j, round(sum(file_size_bytes) / pow(2.0, 30), 6) AS total_size_gb,
       sum(rows_transformed) AS total_rows_transformed, sum(rows_loaded_postgres) AS total_rows_loaded_postgres,
       round(avg(processing_duration_seconds), 6) AS avg_processing_seconds, max(download_date) AS last_download, max(updated_at) AS last_update
FROM marked GROUP BY ALL
""")(lambda I: Q.download_progress(_manifest(I)))

register("incomplete_months", """
WITH month AS (
  SELECT reference_month, list(struct_pack(n := file_name, s := processing_status, d := download_date IS NOT NULL,
                                           t := transformed_at IS NULL, l := loaded_postgres_at IS NULL) ORDER BY file_name) AS fs
  FROM manifest GROUP BY reference_month),
told AS (
  SELECT reference_month, len(fs) AS files_found, 37 - len(fs) AS files_missing, len(list_filter(fs, lambda x: x.s <> 'loaded')) AS files_pending,
         len(list_filter(fs, lambda x: x.t)) AS files_not_transformed, len(list_filter(fs, lambda x: x.l)) AS files_not_loaded_postgres,
         nullif(array_to_string(list_transform(list_filter(fs, lambda x: x.s = 'failed'), lambda x: x.n), ', '), '') AS failed_files,
         nullif(array_to_string(list_transform(list_filter(fs, lambda x: x.d AND x.t), lambda x: x.n), ', '), '') AS pending_transform_files
  FROM month)
FROM told WHERE files_missing > 0 OR files_pending > 0
""")(lambda I: Q.incomplete_months(_manifest(I)))

register("files_ready", """
WITH todo AS (
  SELECT *, list_filter([CASE WHEN extracted_at IS NULL THEN 'needs_extraction' END, CASE WHEN transformed_at IS NULL THEN 'needs_transformation' END,
                         CASE WHEN loaded_postgres_at IS NULL THEN 'needs_postgres_load' END], lambda x: x IS NOT NULL) AS steps FROM manifest)
SELECT id, reference_month, file_name, file_type, round(file_size_bytes / pow(2.0, 20), 6) AS file_size_mb, download_date, steps[1] AS next_stage
FROM todo WHERE len(steps) > 0 AND download_date IS NOT NULL AND processing_status IS NOT NULL AND NOT list_contains(['failed', 'loaded'], processing_status)
""")(lambda I: Q.files_ready(_manifest(I)))

register("fn_month_from_path", """
SELECT concat('/dados/', reference_month, '/', file_name) AS raw, reference_month AS v FROM manifest
UNION ALL SELECT file_name, nullif(regexp_extract(file_name, '[0-9]{4}-[0-9]{2}'), '') FROM manifest
""")(lambda I: _manifest(I).select(F.explode(F.array(F.concat(F.lit("/dados/"), "reference_month", F.lit("/"), "file_name"), F.col("file_name"))).alias("raw"))
     .withColumn("v", C.month_from_path("raw")))

register("files_to_process", """
SELECT * FROM manifest WHERE download_date IS NOT NULL AND processing_status <> 'loaded' AND transformed_at IS NULL
  AND reference_month = '2024-03' AND file_type = 'empresas'
UNION ALL SELECT * FROM manifest WHERE processing_status <> 'loaded' AND loaded_postgres_at IS NULL
""")(lambda I: Q.files_to_process(_manifest(I), month="2024-03", file_type="empresas").unionByName(Q.files_to_process(_manifest(I), stage="loaded")))
register("files_to_reprocess", "SELECT * FROM manifest WHERE processing_status <> 'loaded' AND file_type = 'socios'")(
    lambda I: Q.files_to_process(_manifest(I), file_type="socios", reprocess=True))

register("is_processed", "SELECT reference_month, file_name, loaded_postgres_at IS NOT NULL AS processed FROM manifest")(
    lambda I: Q.is_processed(_manifest(I), "loaded"))

register("processing_summary", """
SELECT reference_month, COUNT(*) AS files, COUNT(*) FILTER (WHERE processing_status = 'loaded') AS loaded,
  COUNT(*) FILTER (WHERE processing_status = 'failed') AS failed,
  COUNT(*) FILTER (WHERE processing_status = 'pending') AS pending, SUM(rows_loaded_postgres) AS rows_loaded
FROM manifest GROUP BY reference_month
""")(lambda I: Q.processing_summary(_manifest(I)))

# over stage events: a month has one row a file and event
register("backfill_months", """
SELECT * FROM (SELECT reference_month,
  COUNT(*) FILTER (WHERE file_type = 'empresas') AS empresas,
  COUNT(*) FILTER (WHERE file_type = 'estabelecimentos') AS estabelecimentos
FROM mf_events WHERE processing_status = 'pending' GROUP BY reference_month) t
WHERE empresas >= 10 AND estabelecimentos >= 10
""")(lambda I: Q.backfill_months(PQ.manifest_events(I.spark, I.sf_dir)))

register("live_status", """
SELECT reference_month, file_type, count(*) AS total, count(extracted_at) AS extracted, count(transformed_at) AS transformed, count(loaded_postgres_at) AS loaded_pg,
  count(loaded_neo4j_at) AS loaded_neo4j, count(*) FILTER (processing_status = 'failed') AS failed, coalesce(sum(rows_transformed), 0) AS rows_transformed,
  coalesce(sum(rows_loaded_postgres), 0) AS rows_pg
FROM manifest WHERE file_type IN ('empresas', 'estabelecimentos') GROUP BY ALL
""")(lambda I: Q.live_status(_manifest(I)))

register("size_report", """
SELECT coalesce(reference_month, 'total') AS reference_month, count(*) AS file_count, coalesce(sum(file_size_bytes), 0) AS total_bytes,
  round(coalesce(sum(file_size_bytes), 0) / pow(1024.0, 3), 2) AS total_gb FROM manifest GROUP BY ROLLUP (reference_month)
""")(lambda I: Q.size_report(_manifest(I)))

register("latest_downloads", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY downloaded_at DESC, id DESC) AS rn
FROM downloads WHERE status = 'success') t WHERE rn = 1
""")(lambda I: Q.latest_downloads(PQ.downloads(I.spark, I.sf_dir), "success"))
register("latest_downloads_any", """
SELECT * FROM downloads QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY downloaded_at DESC, id DESC) = 1
""")(lambda I: Q.latest_downloads(PQ.downloads(I.spark, I.sf_dir)))
register("latest_downloads_failed", """
SELECT d.* FROM downloads d WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM downloads x WHERE x.status = 'failed' AND x.dataset = d.dataset
  AND (x.downloaded_at > d.downloaded_at OR (x.downloaded_at = d.downloaded_at AND x.id > d.id)))
""")(lambda I: Q.latest_downloads(PQ.downloads(I.spark, I.sf_dir), "failed"))

register("change_history", """
SELECT dataset, id, downloaded_at, checksum, lag(checksum) OVER w AS previous_checksum,
  checksum IS DISTINCT FROM lag(checksum) OVER w AS changed
FROM downloads WINDOW w AS (PARTITION BY dataset ORDER BY downloaded_at, id)
""")(lambda I: Q.change_history(PQ.downloads(I.spark, I.sf_dir)))

register("detect_changes", """
WITH last AS (SELECT * FROM (SELECT dataset, etag AS last_etag, last_modified AS last_last_modified,
  row_number() OVER (PARTITION BY dataset ORDER BY downloaded_at DESC, id DESC) AS rn FROM downloads
  WHERE status = 'success') t WHERE rn = 1)
SELECT r.dataset, r.etag, r.last_modified,
  CASE WHEN l.last_etag IS NULL AND l.last_last_modified IS NULL THEN TRUE
       WHEN r.etag IS NOT NULL AND l.last_etag IS NOT NULL THEN r.etag <> l.last_etag
       WHEN r.last_modified IS NOT NULL AND l.last_last_modified IS NOT NULL THEN r.last_modified > l.last_last_modified
       ELSE TRUE END AS changed
FROM remote r LEFT JOIN last l ON l.dataset = r.dataset
""")(lambda I: Q.detect_changes(PQ.remote_listing(I.spark, I.sf_dir), PQ.downloads(I.spark, I.sf_dir)))

register("new_months", """
SELECT DISTINCT reference_month FROM mf_events
WHERE reference_month NOT IN (SELECT reference_month FROM manifest GROUP BY reference_month
                              HAVING COUNT(*) FILTER (WHERE processing_status = 'failed') = 0)
""")(lambda I: Q.new_months(PQ.manifest_events(I.spark, I.sf_dir),
                            Q.processing_summary(_manifest(I)).filter(F.col("failed") == 0)))

RECONCILE_SQL = """
WITH e AS (SELECT reference_month, file_name, MAX(file_size_bytes) AS expected_size FROM mf_events GROUP BY 1, 2
           UNION ALL SELECT DISTINCT reference_month, 'Paises.zip', 1000 FROM mf_events),
j AS (SELECT COALESCE(e.reference_month, m.reference_month) AS reference_month, e.expected_size,
             m.file_size_bytes AS landed_size FROM e FULL OUTER JOIN manifest m
      ON e.reference_month = m.reference_month AND e.file_name = m.file_name)
SELECT reference_month, COUNT(expected_size) AS expected, COUNT(landed_size) AS landed,
  COUNT(*) FILTER (WHERE landed_size IS NULL) AS missing,
  COUNT(*) FILTER (WHERE landed_size IS NOT NULL AND expected_size IS NOT NULL AND landed_size <> expected_size) AS size_mismatch,
  NOT bool_or(landed_size IS NULL OR (landed_size IS NOT NULL AND expected_size IS NOT NULL AND landed_size <> expected_size)) AS complete
FROM j GROUP BY reference_month
"""


def _reconcile(I):
    ev = PQ.manifest_events(I.spark, I.sf_dir)
    exp = (ev.groupBy("reference_month", "file_name").agg(F.max("file_size_bytes").alias("size_bytes"))
           .unionByName(ev.select("reference_month").distinct().select(
               "reference_month", F.lit("Paises.zip").alias("file_name"), F.lit(1000).cast("bigint").alias("size_bytes"))))
    return Q.reconcile_month(exp, _manifest(I))


register("reconcile_month", RECONCILE_SQL)(_reconcile)

register("with_duplicate_count", """
SELECT cnpj_basico, cpf_cnpj_socio, COUNT(*) OVER (PARTITION BY reference_month, cnpj_basico, cpf_cnpj_socio) AS duplicate_count
FROM socio
""")(lambda I: Q.with_duplicate_count(I.partners).select("cnpj_basico", "cpf_cnpj_socio", "duplicate_count"))

register("audit_companies", """
SELECT cnpj_basico, list_filter([CASE WHEN cnpj_basico IS NULL THEN 'cnpj_basico ausente' END,
  CASE WHEN razao_social IS NULL OR razao_social = '' THEN 'razao_social ausente' END,
  CASE WHEN length(cnpj_basico) <> 8 THEN 'cnpj_basico deve ter 8 digitos' END,
  CASE WHEN capital_social < 0 THEN 'capital_social negativo' END], lambda x: x IS NOT NULL) AS errors,
  len(list_filter([CASE WHEN cnpj_basico IS NULL THEN 'x' END, CASE WHEN razao_social IS NULL OR razao_social = '' THEN 'x' END,
  CASE WHEN length(cnpj_basico) <> 8 THEN 'x' END, CASE WHEN capital_social < 0 THEN 'x' END], lambda x: x IS NOT NULL)) = 0 AS valid
FROM empresa
""")(lambda I: Q.audit_companies(I.companies))

register("audit_check_digits", """
SELECT uf, COUNT(*) FILTER (WHERE v) AS valid, COUNT(*) FILTER (WHERE NOT v) AS invalid FROM (
  SELECT uf, COALESCE(length(f) = 14 AND NOT regexp_full_match(f, '(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)')
    AND substr(f, 13, 2) = {dv}, FALSE) AS v
  FROM (SELECT uf, cnpj_basico || cnpj_ordem || cnpj_dv AS f FROM estab) a) b GROUP BY uf
""".replace("{dv}", __import__("tessera.plans.oracle_base", fromlist=["x"]).dv_sql("substr(f, 1, 12)")))(
    lambda I: Q.audit_check_digits(I.establishments))

register("audit_establishments", """
SELECT cnpj_basico, cnpj_ordem, cnpj_dv, COALESCE(length(f) = 14 AND NOT regexp_full_match(f, '(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)')
    AND substr(f, 13, 2) = {dv}, FALSE) AS valid
FROM (SELECT *, cnpj_basico || cnpj_ordem || cnpj_dv AS f FROM estab) a
""".replace("{dv}", __import__("tessera.plans.oracle_base", fromlist=["x"]).dv_sql("substr(f, 1, 12)")))(
    lambda I: Q.audit_establishments(I.establishments).select("cnpj_basico", "cnpj_ordem", "cnpj_dv", "valid"))

# load semantics as plans ------------------------------------------------------------

register("upsert_keyed", """
WITH staged AS (SELECT cnpj_basico, razao_social || ' V2' AS razao_social, natureza_juridica, qualificacao_responsavel,
                       capital_social, porte_empresa, ente_federativo_responsavel, reference_month
                FROM empresa WHERE CAST(cnpj_basico AS BIGINT) % 3 = 0)
SELECT * FROM empresa WHERE cnpj_basico NOT IN (SELECT cnpj_basico FROM staged) UNION ALL SELECT * FROM staged
""")(lambda I: S.upsert(I.companies, I.companies.filter(F.col("cnpj_basico").cast("bigint") % 3 == 0)
                        .withColumn("razao_social", F.concat("razao_social", F.lit(" V2"))), ["cnpj_basico"]))

UPSERT_ORGS_SQL = """
SELECT * FROM orgs WHERE id NOT IN (SELECT max(id) FROM orgs GROUP BY collection, record_id)
UNION ALL SELECT * FROM orgs_latest
"""
register("replace_month", """
SELECT cnpj_basico, reference_month FROM socio WHERE reference_month <> '2024-01'
UNION ALL SELECT cnpj_basico, '2024-01' FROM socio WHERE identificador_socio = 2
""")(lambda I: S.replace_partition(I.partners.select("cnpj_basico", "reference_month"),
                                   I.partners.filter(F.col("identificador_socio") == 2).select("cnpj_basico"),
                                   "reference_month", "2024-01"))
REPLACE_MANIFEST_SQL = """
SELECT id, manifest_id FROM orgs WHERE manifest_id <> '2024-01-05'
UNION ALL SELECT id, '2024-01-05' FROM orgs WHERE manifest_id = '2024-01-05' AND collection = 'empresas'
"""
register("reload_snapshot", "SELECT codigo_interno, numero_inpi FROM pt_bib")(
    lambda I: S.reload_snapshot(I.raw_patent("bibliografia").select(
        "_row", F.col("codigo_interno").cast("bigint").alias("codigo_interno"), "numero_inpi"),
        ["codigo_interno"], "_row").drop("_row"))
register("finish_manifest", """
SELECT manifest_id, CASE WHEN max(id) % 2 = 0 THEN 'loaded' ELSE 'failed' END AS status,
  CASE WHEN max(id) % 2 = 0 THEN NULL ELSE repeat('erro ', 1000) END AS error_message
FROM orgs GROUP BY manifest_id
""")(lambda I: Q.finish_manifest(
    __import__("tessera.plans.q_geo", fromlist=["x"])._orgs(I).groupBy("manifest_id").agg(F.max("id").alias("mx"))
    .select("manifest_id", F.when(F.col("mx") % 2 == 1, F.repeat(F.lit("erro "), 1000)).alias("error"))))


def _upsert_orgs(I):
    orgs = __import__("tessera.plans.q_geo", fromlist=["x"])._orgs(I)
    latest = first_by(orgs, ["collection", "record_id"], [F.col("id").desc()])
    older = orgs.join(latest.select("id"), "id", "left_anti")
    return S.upsert(older, latest, ["id"])


def _replace_manifest(I):
    orgs = __import__("tessera.plans.q_geo", fromlist=["x"])._orgs(I)
    return S.replace_partition(orgs.select("id", "manifest_id"),
                               orgs.filter((F.col("manifest_id") == "2024-01-05") & (F.col("collection") == "empresas"))
                               .select("id"), "manifest_id", "2024-01-05")


register("upsert_orgs", UPSERT_ORGS_SQL)(_upsert_orgs)
register("replace_manifest", REPLACE_MANIFEST_SQL)(_replace_manifest)


# manifests of the other domains ------------------------------------------------------

_HTTP = """CASE WHEN event_id % 4 > 0 THEN date_trunc('day', ts)::TIMESTAMP END AS http_last_modified, CASE WHEN event_id % 3 > 0 THEN 'W/' || (user_id % 9) END AS http_etag"""
_STATUS = "CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE '{good}' END AS processing_status, CASE WHEN event_id % 7 = 0 THEN 'timeout' END AS error_message"
_SIZE, _SHA = "floor(value * 1000)::BIGINT", "sha256(floor(value)::BIGINT::VARCHAR)"


def _domain(I, domain: str):
    from tessera.plans.q_io import scratch
    from tessera.sources.manifests import read_manifest
    path = scratch(I.spark, f"manifest-{domain}")
    PQ.domain_manifest(I.spark, I.sf_dir, domain).write.parquet(path)
    return read_manifest(I.spark, path, domain)


register("manifest_funding", f"""
SELECT event_id AS id, event_type || '.csv' AS file_name, 'https://x/' || event_type AS source_url, CASE WHEN event_id % 2 = 0 THEN 'contratacao' ELSE 'liberacao' END AS dataset_type,
  ts AS download_date, {_SIZE} AS file_size_bytes, {_SHA} AS file_checksum_sha256, '/d' AS local_path, {_HTTP}, {_SIZE} AS http_content_length, event_id % 7 > 0 AS is_valid,
  (user_id % 50)::INT AS rows_count, ['a', event_type] AS sheet_names, {_STATUS.format(good='validated')}, ts AS created_at, ts AS updated_at FROM events
""")(lambda I: _domain(I, "funding"))
register("manifest_patents", f"""
SELECT event_id AS id, event_type || '.csv' AS file_name, 'https://x/' || event_type AS source_url, 'patentes_' || event_type AS dataset_name, 'inpi/' || event_id AS minio_key,
  'raw' AS minio_bucket, ts::DATE AS snapshot_date, ts AS download_date, {_SIZE} AS file_size_bytes, {_SHA} AS file_checksum_sha256, {_HTTP}, {_SIZE} AS http_content_length,
  event_id % 7 > 0 AS is_valid, user_id % 50 AS row_count, ['c', event_type] AS column_names, {_STATUS.format(good='downloaded')}, ts AS created_at, ts AS updated_at FROM events
""")(lambda I: _domain(I, "patents"))
register("manifest_organizations", f"""
SELECT event_id AS id, 'inovalink' AS source_name, NULL::VARCHAR AS component_id, ts AS collected_at, NULL::DATE AS snapshot_date, 200 AS response_status_code, {_SIZE} AS response_size_bytes,
  {_HTTP}, event_type AS collection, user_id % 50 AS n, user_id % 50 AS records_total, {_STATUS.format(good='loaded')} FROM events
""")(lambda I: _domain(I, "organizations").select(
    "id", "source_name", "component_id", "collected_at", "snapshot_date", "response_status_code", "response_size_bytes", "http_last_modified", "http_etag",
    F.map_keys("collection_counts")[0].alias("collection"), F.map_values("collection_counts")[0].alias("n"), "records_total", "processing_status", "error_message"))
register("latest_downloads_patents", f"""
SELECT 'patentes_' || event_type AS dataset, event_id AS id, ts AS downloaded_at, {_SHA} AS checksum, CASE WHEN event_id % 3 > 0 THEN 'W/' || (user_id % 9) END AS etag,
  CASE WHEN event_id % 4 > 0 THEN date_trunc('day', ts)::TIMESTAMP END AS last_modified, 'success' AS status
FROM events WHERE event_id % 7 > 0 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1
""")(lambda I: Q.latest_downloads(_downloads_of(I, "patents"), "success"))


def _downloads_of(I, domain: str):
    from tessera.sources.manifests import as_downloads
    return as_downloads(_domain(I, domain), domain)
