"""Map output: one GeoJSON FeatureCollection of all municipalities with their
funding totals, written by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import attach_scalars
from tessera.operators.geo import geojson_of

_TOTALS = ["total_empresas", "total_projetos", "total_aprovado_finep", "total_liberado"]


def municipality_features(summary: DataFrame, geo: DataFrame, uf: str | None = None) -> DataFrame:
    """SNK-12: one row a polygon (of a state, if given): its name, state and
    GeoJSON geometry, with the totals of ``summary`` (by national code) or
    zeros. A summary's coordinates win over the polygon's point."""
    g = geo.filter(F.col("uf") == uf.strip().upper()) if uf and uf.strip() else geo
    g = g.select(F.col("codigo").alias("municipality_ibge_code"), F.col("nome").alias("municipio_nome"), "uf", F.col("latitude").alias("g_lat"),
                 F.col("longitude").alias("g_lon"), geojson_of(g).alias("geometry"))
    # of several groups with one code, the last by (approved, projects) descending counts
    order = F.struct(-F.col("total_aprovado_finep"), -F.col("total_projetos"), F.col("municipio_nome"))
    s = (summary.filter(F.col("municipality_ibge_code").isNotNull()).groupBy("municipality_ibge_code")
         .agg(F.max_by(F.struct("latitude", "longitude", *_TOTALS, "fontes"), order).alias("s")))
    j = g.join(s, "municipality_ibge_code", "left")
    zero = {"total_empresas": "bigint", "total_projetos": "bigint", "total_aprovado_finep": "double", "total_liberado": "double"}
    found = F.col("s").isNotNull()
    return j.select("municipality_ibge_code", "municipio_nome", "uf", F.when(found, F.col("s.latitude")).otherwise(F.col("g_lat")).alias("latitude"),
                    F.when(found, F.col("s.longitude")).otherwise(F.col("g_lon")).alias("longitude"),
                    *[F.coalesce(F.col(f"s.{c}").cast(t), F.lit(0).cast(t)).alias(c) for c, t in zero.items()],
                    F.coalesce("s.fontes", F.array().cast("array<string>")).alias("fontes"), "geometry")


def feature_metadata(features: DataFrame) -> DataFrame:
    """One row: features, those with an approved total, the largest total."""
    return features.agg(F.count(F.lit(1)).alias("feature_count"), F.count_if(F.col("total_aprovado_finep") > 0).alias("municipalities_with_value"),
                        F.coalesce(F.max("total_aprovado_finep"), F.lit(0.0)).alias("max_total_aprovado_finep"), F.lit(0.0).alias("simplify_tolerance"))


def feature_text(features: DataFrame):
    """A row as a GeoJSON Feature; its geometry is JSON already."""
    names = ["municipality_ibge_code", "municipio_nome", "uf", "latitude", "longitude", *_TOTALS, "fontes"]
    properties = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array("municipality_ibge_code")).substr(F.lit(2), F.length(F.to_json(F.array("municipality_ibge_code"))) - 2),
                    F.lit(',"geometry":'), F.coalesce("geometry", F.lit("null")), F.lit(',"properties":'), properties, F.lit("}"))


def write_feature_collection(features: DataFrame, path: str) -> str:
    """The part files below ``path``, put one after the other in the order of
    their names, are one FeatureCollection, ordered by municipality name. Every
    task writes its own range of features; the head, with the metadata, is the
    first line, the tail the last, and every feature but the first brings its
    comma. Nothing is collected."""
    from tessera.session import stage_table
    f = stage_table(features.select("*", feature_text(features).alias("value")), "features")
    first = f.agg(F.min(F.struct("municipio_nome", "municipality_ibge_code")).alias("first"))
    lines = attach_scalars(f.select("municipio_nome", "municipality_ibge_code", "value"), first)
    same = F.struct("municipio_nome", "municipality_ibge_code") == F.col("first")
    body = lines.select(F.lit(1).alias("place"), "municipio_nome", "municipality_ibge_code", F.concat(F.when(same, F.lit("")).otherwise(F.lit(",")), "value").alias("value"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("municipio_nome", "municipality_ibge_code")]
    meta = F.to_json(F.struct("feature_count", "municipalities_with_value", "max_total_aprovado_finep", "simplify_tolerance"))
    head = feature_metadata(f).select(F.lit(0).alias("place"), *nothing, F.concat(F.lit('{"type":"FeatureCollection","metadata":'), meta, F.lit(',"features":[')).alias("value"))
    tail = features.sparkSession.range(1).select(F.lit(2).alias("place"), *nothing, F.lit("]}").alias("value"))
    order = ["place", "municipio_nome", "municipality_ibge_code"]
    every = head.unionByName(body).unionByName(tail)
    every.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
    return path
