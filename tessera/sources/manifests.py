"""Download and collection manifests in the four dialects of the platform's
domains (SRC-13): read with a fixed schema each, and told apart by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the manifest columns of each domain
_FILE = "id bigint, file_name string, source_url string"
_HTTP = "http_last_modified timestamp, http_etag string, http_content_length bigint, is_valid boolean"
_STATE = "processing_status string, error_message string, created_at timestamp, updated_at timestamp"
SCHEMAS = {
    "registry": "id bigint, reference_month string, file_name string, file_type string, file_size_bytes bigint, download_date timestamp, extracted_at timestamp, "
                "transformed_at timestamp, loaded_postgres_at timestamp, loaded_neo4j_at timestamp, processing_status string, rows_transformed bigint, "
                "rows_loaded_postgres bigint, processing_duration_seconds double, updated_at timestamp",
    "funding": f"{_FILE}, dataset_type string, download_date timestamp, file_size_bytes bigint, file_checksum_sha256 string, local_path string, {_HTTP}, "
               f"rows_count int, sheet_names array<string>, {_STATE}",
    "patents": f"{_FILE}, dataset_name string, minio_key string, minio_bucket string, snapshot_date date, download_date timestamp, file_size_bytes bigint, "
               f"file_checksum_sha256 string, {_HTTP}, row_count bigint, column_names array<string>, {_STATE}",
    "organizations": "id bigint, source_name string, entrypoint_url string, request_url string, endpoint_path string, request_method string, component_name string, "
                     "component_id string, collected_at timestamp, snapshot_date date, response_status_code int, response_content_type string, "
                     "response_content_encoding string, response_size_bytes bigint, response_checksum_sha256 string, http_etag string, http_last_modified timestamp, "
                     f"collection_counts map<string, bigint>, records_total bigint, raw_request_path string, raw_response_path string, {_STATE}",
}
#: what a dialect's rows are about, when they were fetched, and which state is good
ROLES = {"registry": ("file_type", "download_date", "loaded"), "funding": ("dataset_type", "download_date", "validated"),
         "patents": ("dataset_name", "download_date", "downloaded"), "organizations": ("source_name", "collected_at", "loaded")}


def read_manifest(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """A domain's manifest; columns the files lack are null."""
    return spark.read.schema(SCHEMAS[domain]).parquet(path)


def as_downloads(manifest: DataFrame, domain: str) -> DataFrame:
    """Any dialect as ``dataset, id, downloaded_at, checksum, etag,
    last_modified, status`` (success or failed), for the download queries."""
    dataset, at, good = ROLES[domain]
    names = manifest.columns

    def first(*options: str):
        return next((F.col(c) for c in options if c in names), F.lit(None).cast("string"))

    return manifest.select(F.col(dataset).alias("dataset"), "id", F.col(at).alias("downloaded_at"), first("file_checksum_sha256", "response_checksum_sha256").alias("checksum"),
                           first("http_etag").alias("etag"), first("http_last_modified").cast("timestamp").alias("last_modified"),
                           F.when(F.col("processing_status") == good, F.lit("success")).otherwise(F.lit("failed")).alias("status"))
