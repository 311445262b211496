"""Data quality and ingestion state: manifest views, stage updates, change
detection, month reconciliation and record audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.common import first_by

EXPECTED_FILES_PER_MONTH = 37


def mark_stage(manifest: DataFrame, events: DataFrame, keys=("reference_month", "file_name"),
               order: str = "updated_at") -> DataFrame:
    """DQ-4 / DQ-5: upsert stage events into the manifest: per key the
    newest row (by ``order``, then id) wins."""
    both = manifest.unionByName(events.select(*manifest.columns))
    return first_by(both, list(keys), [F.col(order).desc(), F.col("id").desc()])


def download_progress(m: DataFrame) -> DataFrame:
    """AGG-12: per (month, type) progress measures, size in GiB."""
    return m.groupBy("reference_month", "file_type").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("processing_status") == "loaded").alias("completed"),
        F.count_if(F.col("processing_status") == "failed").alias("failed"),
        F.count_if(F.col("processing_status") == "pending").alias("pending"),
        F.count("extracted_at").alias("extracted"), F.count("transformed_at").alias("transformed"),
        F.count("loaded_postgres_at").alias("loaded_postgres"), F.count("loaded_neo4j_at").alias("loaded_neo4j"),
        F.round(F.sum("file_size_bytes") / 1024.0 / 1024.0 / 1024.0, 6).alias("total_size_gb"),
        F.sum("rows_transformed").alias("total_rows_transformed"),
        F.sum("rows_loaded_postgres").alias("total_rows_loaded_postgres"),
        F.round(F.avg("processing_duration_seconds"), 6).alias("avg_processing_seconds"),
        F.max("download_date").alias("last_download"), F.max("updated_at").alias("last_update"))


def incomplete_months(m: DataFrame, expected: int = EXPECTED_FILES_PER_MONTH) -> DataFrame:
    """AGG-13 + NST-7: months missing files or with files not loaded; the
    failed / pending-transform file lists sorted by name."""
    g = m.groupBy("reference_month").agg(
        F.count(F.lit(1)).alias("files_found"),
        (F.lit(expected) - F.count(F.lit(1))).alias("files_missing"),
        F.count_if(F.col("processing_status") != "loaded").alias("files_pending"),
        F.count_if(F.col("transformed_at").isNull()).alias("files_not_transformed"),
        F.count_if(F.col("loaded_postgres_at").isNull()).alias("files_not_loaded_postgres"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("processing_status") == "failed",
                                                        F.col("file_name")))), ", ").alias("failed_files"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("download_date").isNotNull()
                                                        & F.col("transformed_at").isNull(), F.col("file_name")))),
                     ", ").alias("pending_transform_files"))
    return g.filter((F.col("files_found") < expected) | (F.col("files_pending") > 0)).withColumn(
        "failed_files", F.nullif("failed_files", F.lit(""))).withColumn(
        "pending_transform_files", F.nullif("pending_transform_files", F.lit("")))


def next_stage(m: DataFrame) -> DataFrame:
    return m.withColumn("next_stage", F.when(F.col("extracted_at").isNull(), "needs_extraction")
                        .when(F.col("transformed_at").isNull(), "needs_transformation")
                        .when(F.col("loaded_postgres_at").isNull(), "needs_postgres_load")
                        .when(F.col("loaded_neo4j_at").isNull(), "needs_neo4j_load").otherwise("completed"))


def files_ready(m: DataFrame) -> DataFrame:
    """AGG-14: downloaded files not failed/loaded with a stage to run."""
    f = m.filter(F.col("download_date").isNotNull() & ~F.col("processing_status").isin("failed", "loaded")
                 & (F.col("extracted_at").isNull() | F.col("transformed_at").isNull()
                    | F.col("loaded_postgres_at").isNull()))
    return next_stage(f).select("id", "reference_month", "file_name", "file_type",
                                F.round(F.col("file_size_bytes") / 1024.0 / 1024.0, 6).alias("file_size_mb"),
                                "download_date", "next_stage")


# fixed values: stage -> timestamp column
STAGES = {"extracted": "extracted_at", "transformed": "transformed_at", "loaded": "loaded_postgres_at",
          "graph_loaded": "loaded_neo4j_at"}


def files_to_process(m: DataFrame, month: str | None = None, file_type: str | None = None,
                     stage: str = "transformed", reprocess: bool = False) -> DataFrame:
    """FLT-13: downloaded, stage not done (unless reprocessing), not loaded."""
    cond = F.col("download_date").isNotNull() & (F.col("processing_status") != "loaded")
    if not reprocess:
        cond = cond & F.col(STAGES[stage]).isNull()
    if month:
        cond = cond & (F.col("reference_month") == month)
    if file_type:
        cond = cond & (F.col("file_type") == file_type)
    return m.filter(cond)


def is_processed(m: DataFrame, stage: str) -> DataFrame:
    """FLT-14: per file, whether it is past a stage."""
    return m.select("reference_month", "file_name", F.col(STAGES[stage]).isNotNull().alias("processed"))


def processing_summary(m: DataFrame) -> DataFrame:
    """AGG-15: per month status counts and rows."""
    return m.groupBy("reference_month").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("processing_status") == "loaded").alias("loaded"),
        F.count_if(F.col("processing_status") == "failed").alias("failed"),
        F.count_if(F.col("processing_status") == "pending").alias("pending"),
        F.sum("rows_loaded_postgres").alias("rows_loaded"))


def live_status(m: DataFrame, month: str | None = None) -> DataFrame:
    """AGG-15: per month and type of the two big files, how far they are."""
    f = m.filter(F.col("file_type").isin("empresas", "estabelecimentos"))
    f = f.filter(F.col("reference_month") == month) if month else f
    return f.groupBy("reference_month", "file_type").agg(
        F.count(F.lit(1)).alias("total"), F.count("extracted_at").alias("extracted"), F.count("transformed_at").alias("transformed"),
        F.count("loaded_postgres_at").alias("loaded_pg"), F.count("loaded_neo4j_at").alias("loaded_neo4j"),
        F.count_if(F.col("processing_status") == "failed").alias("failed"), F.coalesce(F.sum("rows_transformed"), F.lit(0)).alias("rows_transformed"),
        F.coalesce(F.sum("rows_loaded_postgres"), F.lit(0)).alias("rows_pg"))


def size_report(m: DataFrame) -> DataFrame:
    """AGG-15: files and bytes per month, and in total."""
    size = F.coalesce(F.sum("file_size_bytes"), F.lit(0))
    return m.rollup("reference_month").agg(F.count(F.lit(1)).alias("file_count"), size.alias("total_bytes"), F.round(size / 1024.0 ** 3, 2).alias("total_gb")).select(
        F.coalesce("reference_month", F.lit("total")).alias("reference_month"), "file_count", "total_bytes", "total_gb")


def backfill_months(m: DataFrame, min_files: int = 10) -> DataFrame:
    """AGG-16: months with at least ``min_files`` company and establishment
    files pending (pivot by type)."""
    p = (m.filter(F.col("processing_status") == "pending").groupBy("reference_month")
         .pivot("file_type", ["empresas", "estabelecimentos"]).agg(F.count(F.lit(1))).na.fill(0))
    return p.filter((F.col("empresas") >= min_files) & (F.col("estabelecimentos") >= min_files))


def latest_downloads(downloads: DataFrame, status: str | None = None) -> DataFrame:
    """WIN-4: latest download per dataset (optionally only one status)."""
    d = downloads if status is None else downloads.filter(F.col("status") == status)
    return first_by(d, ["dataset"], [F.col("downloaded_at").desc(), F.col("id").desc()])


def change_history(downloads: DataFrame) -> DataFrame:
    """WIN-2: per dataset, whether the checksum differs from the previous
    download (null-safe). A dataset is worked off month by month; the first
    download of a month is compared with the last one of the months before
    (one summary row a dataset and month)."""
    d = downloads.select("dataset", "id", "downloaded_at", "checksum", F.trunc("downloaded_at", "month").alias("_m"))
    order = F.struct("downloaded_at", "id")
    last = d.groupBy("dataset", "_m").agg(F.max_by(F.struct("checksum"), order).alias("_last"))
    before = last.select(F.col("dataset").alias("_d"), F.col("_m").alias("_n"),
                         F.lag("_last").over(Window.partitionBy("dataset").orderBy("_m")).alias("_before"))
    w = Window.partitionBy("dataset", "_m").orderBy("downloaded_at", "id")
    d = d.withColumn("_here", F.lag(F.struct("checksum")).over(w))
    d = d.join(before, F.col("dataset").eqNullSafe(F.col("_d")) & F.col("_m").eqNullSafe(F.col("_n")), "left")
    prev = F.coalesce("_here", "_before")["checksum"]
    return d.select("dataset", "id", "downloaded_at", "checksum", prev.alias("previous_checksum"),
                    (~F.col("checksum").eqNullSafe(prev)).alias("changed"))


def detect_changes(remote: DataFrame, downloads: DataFrame) -> DataFrame:
    """DQ-6: changed when the ETag differs, else when Last-Modified is newer,
    else (no history / nothing to compare) changed."""
    last = latest_downloads(downloads, "success").select(
        "dataset", F.col("etag").alias("last_etag"), F.col("last_modified").alias("last_last_modified"))
    j = remote.join(last, "dataset", "left")
    changed = (F.when(F.col("last_etag").isNull() & F.col("last_last_modified").isNull(), True)
               .when(F.col("etag").isNotNull() & F.col("last_etag").isNotNull(), F.col("etag") != F.col("last_etag"))
               .when(F.col("last_modified").isNotNull() & F.col("last_last_modified").isNotNull(),
                     F.col("last_modified") > F.col("last_last_modified"))
               .otherwise(True))
    return j.select("dataset", "etag", "last_modified", changed.alias("changed"))


def new_months(available: DataFrame, loaded: DataFrame) -> DataFrame:
    """SET-4: months available remotely and not loaded."""
    return available.select("reference_month").distinct().join(
        loaded.select("reference_month").distinct(), "reference_month", "left_anti")


def reconcile_month(expected: DataFrame, landed: DataFrame) -> DataFrame:
    """SET-5: expected vs landed files per month (full outer join on name):
    missing, size mismatch, and a per-month complete flag."""
    e = expected.select("reference_month", "file_name", F.col("size_bytes").alias("expected_size"))
    lnd = landed.select("reference_month", "file_name", F.col("file_size_bytes").alias("landed_size"))
    j = e.join(lnd, ["reference_month", "file_name"], "full_outer")
    j = j.withColumn("missing", F.col("landed_size").isNull()).withColumn(
        "size_mismatch", F.col("landed_size").isNotNull() & F.col("expected_size").isNotNull()
        & (F.col("landed_size") != F.col("expected_size")))
    return j.groupBy("reference_month").agg(
        F.count("expected_size").alias("expected"), F.count("landed_size").alias("landed"),
        F.count_if("missing").alias("missing"), F.count_if("size_mismatch").alias("size_mismatch"),
        (~F.max(F.col("missing") | F.col("size_mismatch"))).alias("complete"))


def with_duplicate_count(partners: DataFrame) -> DataFrame:
    """WIN-1: rows per (company, partner id) over the whole month."""
    w = Window.partitionBy("reference_month", "cnpj_basico", "cpf_cnpj_socio")
    return partners.withColumn("duplicate_count", F.count(F.lit(1)).over(w))


def audit_companies(companies: DataFrame) -> DataFrame:
    """DQ-1: per company, the list of failed checks."""
    errs = F.array_compact(F.array(
        F.when(F.col("cnpj_basico").isNull(), F.lit("cnpj_basico ausente")),
        F.when(F.col("razao_social").isNull() | (F.col("razao_social") == ""), F.lit("razao_social ausente")),
        F.when(F.length("cnpj_basico") != 8, F.lit("cnpj_basico deve ter 8 digitos")),
        F.when(F.col("capital_social") < 0, F.lit("capital_social negativo"))))
    return companies.select("cnpj_basico", errs.alias("errors")).withColumn("valid", F.size("errors") == 0)


def audit_establishments(est: DataFrame) -> DataFrame:
    """DQ-2: parts present and check digits right."""
    full = F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv")
    errs = F.array_compact(F.array(
        F.when(F.col("cnpj_basico").isNull(), F.lit("cnpj_basico ausente")),
        F.when(F.col("cnpj_ordem").isNull(), F.lit("cnpj_ordem ausente")),
        F.when(F.col("cnpj_dv").isNull(), F.lit("cnpj_dv ausente")),
        F.when(~C.valid_id(full), F.lit("digito verificador invalido"))))
    return est.select("cnpj_basico", "cnpj_ordem", "cnpj_dv", errs.alias("errors")).withColumn(
        "valid", F.size("errors") == 0)


def audit_check_digits(est: DataFrame) -> DataFrame:
    """DQ-3: valid / invalid ids per state."""
    v = C.valid_id(F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv"))
    return est.groupBy("uf").agg(F.count_if(v).alias("valid"), F.count_if(~v).alias("invalid"))


def finish_manifest(runs: DataFrame) -> DataFrame:
    """DQ-8: collected -> loaded / failed, with the whole error message."""
    return runs.select("manifest_id", F.when(F.col("error").isNull(), "loaded").otherwise("failed").alias("status"),
                       F.col("error").alias("error_message"))
