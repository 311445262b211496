"""Manifest and download-listing stand-ins shaped from ``events``: one event
is one stage event of a registry file, or one download of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import file_type
from tessera.sources.proxies import _s, table

# fixed values: registry file family per event type
FILE_FAMILY = {"view": "Empresas", "click": "Estabelecimentos", "signup": "Socios", "purchase": "Simples",
               "error": "Cnaes"}


def _hours(n: int):
    return F.expr(f"INTERVAL {n} HOUR")


def manifest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    e, u, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    fam = None
    for k, v in FILE_FAMILY.items():
        fam = F.when(F.col("event_type") == k, F.lit(v)) if fam is None else fam.when(F.col("event_type") == k, F.lit(v))
    name = F.concat(fam, _s(u % 10), F.lit(".zip"))
    loaded = F.when(e % 5 == 0, F.lit(None).cast("timestamp")).otherwise(ts + _hours(3))
    return ev.select(
        e.alias("id"), F.concat(F.lit("2024-"), F.lpad(_s(u % 12 + 1), 2, "0")).alias("reference_month"),
        name.alias("file_name"), file_type(name).alias("file_type"),
        F.floor(F.col("value") * 1000000).cast("bigint").alias("file_size_bytes"),
        ts.alias("download_date"),
        F.when(e % 3 == 0, F.lit(None).cast("timestamp")).otherwise(ts + _hours(1)).alias("extracted_at"),
        F.when(e % 4 == 0, F.lit(None).cast("timestamp")).otherwise(ts + _hours(2)).alias("transformed_at"),
        loaded.alias("loaded_postgres_at"),
        F.when(e % 6 == 0, F.lit(None).cast("timestamp")).otherwise(ts + _hours(4)).alias("loaded_neo4j_at"),
        F.when(e % 7 == 0, F.lit("failed")).when(loaded.isNotNull(), F.lit("loaded")).otherwise(F.lit("pending"))
         .alias("processing_status"),
        (u * 100).alias("rows_transformed"),
        F.when(loaded.isNotNull(), u * 100).alias("rows_loaded_postgres"),
        F.col("value").alias("processing_duration_seconds"), ts.alias("updated_at"))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    chk = F.md5(_s(F.floor(F.col("value"))))
    return ev.select(F.col("event_type").alias("dataset"), F.col("event_id").alias("id"),
                     F.col("ts").alias("downloaded_at"), chk.alias("checksum"),
                     F.concat(F.lit("W/"), chk).alias("etag"), F.date_trunc("day", "ts").alias("last_modified"),
                     F.when(F.col("event_id") % 10 == 0, F.lit("failed")).otherwise(F.lit("success")).alias("status"))


def remote_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    g = ev.groupBy("event_type").agg(F.max(F.date_trunc("day", "ts")).alias("lm"))
    return g.select(
        F.col("event_type").alias("dataset"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("W/new")).alias("etag"),
        F.when(F.col("event_type") == "signup", F.col("lm") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("lm"))
         .alias("last_modified"))


def domain_manifest(spark: SparkSession, sf_dir: str, domain: str) -> DataFrame:
    """Manifest rows of the funding, patent or organization domain: an event is
    one download or collection."""
    ev = table(spark, sf_dir, "events")
    e, u, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    size = F.floor(F.col("value") * 1000).cast("bigint")
    mark = F.sha2(_s(F.floor(F.col("value"))), 256)
    etag, modified = F.when(e % 3 > 0, F.concat(F.lit("W/"), _s(u % 9))), F.when(e % 4 > 0, F.date_trunc("day", "ts"))
    error = F.when(e % 7 == 0, F.lit("timeout"))

    def state(good: str):
        return [F.when(e % 7 == 0, F.lit("failed")).otherwise(F.lit(good)).alias("processing_status"), error.alias("error_message"), ts.alias("created_at"), ts.alias("updated_at")]

    http = [modified.alias("http_last_modified"), etag.alias("http_etag"), size.alias("http_content_length"), (e % 7 > 0).alias("is_valid")]
    file = [e.alias("id"), F.concat("event_type", F.lit(".csv")).alias("file_name"), F.concat(F.lit("https://x/"), "event_type").alias("source_url")]
    if domain == "funding":
        return ev.select(*file, F.when(e % 2 == 0, F.lit("contratacao")).otherwise(F.lit("liberacao")).alias("dataset_type"), ts.alias("download_date"), size.alias("file_size_bytes"),
                         mark.alias("file_checksum_sha256"), F.lit("/d").alias("local_path"), *http, (u % 50).cast("int").alias("rows_count"),
                         F.array(F.lit("a"), F.col("event_type")).alias("sheet_names"), *state("validated"))
    if domain == "patents":
        return ev.select(*file, F.concat(F.lit("patentes_"), "event_type").alias("dataset_name"), F.concat(F.lit("inpi/"), _s(e)).alias("minio_key"), F.lit("raw").alias("minio_bucket"),
                         F.to_date("ts").alias("snapshot_date"), ts.alias("download_date"), size.alias("file_size_bytes"), mark.alias("file_checksum_sha256"), *http,
                         (u % 50).alias("row_count"), F.array(F.lit("c"), F.col("event_type")).alias("column_names"), *state("downloaded"))
    return ev.select(e.alias("id"), F.lit("inovalink").alias("source_name"), F.lit("https://x/").alias("entrypoint_url"), F.lit("https://x/u").alias("request_url"),
                     F.lit("POST").alias("request_method"), ts.alias("collected_at"), F.lit(200).alias("response_status_code"), size.alias("response_size_bytes"),
                     mark.alias("response_checksum_sha256"), etag.alias("http_etag"), modified.alias("http_last_modified"),
                     F.create_map(F.col("event_type"), u % 50).alias("collection_counts"), (u % 50).alias("records_total"), *state("loaded"))
