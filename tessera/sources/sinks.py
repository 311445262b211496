"""Sinks and load semantics: month-partitioned ZSTD Parquet, idempotent
appends and replaces, keyed upserts without MERGE.

Every write goes to a path the caller names (on a cluster: shared storage);
replaces use dynamic partition overwrite so only the touched partitions are
rewritten, and upserts write a new version directory instead of
overwriting a path that is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.common import with_month
from tessera.session import path_exists


def write_stage(df: DataFrame, path: str, month: str, partition_col: str = "reference_month") -> str:
    """SNK-1: cleaned table as ZSTD Parquet partitioned by month, written
    with dynamic partition overwrite, so re-running a month replaces
    exactly that month. No shuffle: every task writes its own files into
    the month directory (a month is one partition value, so repartitioning
    by it would funnel the whole month through one task)."""
    out = df if partition_col in df.columns else with_month(df, month)
    (out.sortWithinPartitions(partition_col)
     .write.mode("overwrite").option("compression", "zstd")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))
    return path


def read_stage(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """SRC-6: stage table, optionally one month (partition pruning)."""
    df = spark.read.parquet(path)
    return df.filter(F.col("reference_month") == month) if month else df


def list_months(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: months that have data (partition discovery)."""
    return spark.read.parquet(path).select("reference_month").distinct()


def month_loaded(spark: SparkSession, path: str, month: str) -> bool:
    """Existence probe for SNK-2/3: does the month have any row? A missing
    month folder is none; a read error rises, so that it never looks like one."""
    if not path_exists(spark, f"{path}/reference_month={month}"):
        return False
    return not read_stage(spark, path, month).isEmpty()


def append_month(df: DataFrame, path: str, month: str) -> bool:
    """SNK-2: month-tagged append, skipped when the month is loaded."""
    if month_loaded(df.sparkSession, path, month):
        return False
    write_stage(df, path, month)
    return True


def load_lookup_once(df: DataFrame, path: str) -> bool:
    """SNK-3: load a lookup only when the table has no row."""
    spark = df.sparkSession
    if _complete(spark, path) and not spark.read.parquet(path).isEmpty():
        return False
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return True


def upsert(target: DataFrame, staged: DataFrame, keys: list[str], created_col: str | None = None) -> DataFrame:
    """SNK-4: keyed upsert as a plan: staged rows replace target rows with the
    same key (all columns overwritten, ``created_col`` kept from the target),
    other target rows stay. The caller writes the result to a new version
    directory."""
    t = target.alias("t")
    s = staged.alias("s")
    kept = t.join(s.select(*keys), keys, "left_anti")
    if created_col and created_col in target.columns:
        created = target.select(*keys, F.col(created_col).alias("_old_created"))
        staged = (staged.join(created, keys, "left")
                  .withColumn(created_col, F.coalesce(F.col("_old_created"), F.col(created_col)))
                  .drop("_old_created"))
    return kept.unionByName(staged.select(*target.columns))


def replace_partition(target: DataFrame, rows: DataFrame, col: str, value) -> DataFrame:
    """SNK-5 / SNK-6: delete the rows of one month / manifest, insert the
    new ones (as a plan; on disk: dynamic partition overwrite)."""
    return target.filter(F.col(col) != F.lit(value)).unionByName(
        rows.withColumn(col, F.lit(value).cast(target.schema[col].dataType)).select(*target.columns))


def ensure_stage(spark: SparkSession, path: str, build) -> DataFrame:
    """SNK-10: reuse a stage output whose write was finished (``_SUCCESS`` is
    there); build and write it where it is missing or unfinished. An error
    while reading a finished output rises: it is not overwritten."""
    if not _complete(spark, path):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


def reload_snapshot(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SNK-7: full-snapshot reload; duplicate keys keep the first row."""
    from tessera.operators.common import first_by
    return first_by(df, keys, [F.col(order)])
