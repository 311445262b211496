"""The organization platform's payload: one JSON object of nine named arrays of
actors, each with a nested address, city and state.

The reader's schema is given, never inferred: the nine arrays are read as
arrays of JSON texts, so an actor keeps every field it came with beside the
typed ones, and one ``explode`` over all arrays gives one row an actor. A run's
payload may come as any number of such objects, one a line (``multi_line`` for
a pretty-printed file); what is not a payload object is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: collection -> kind and category label
COLLECTIONS = {
    "incubators": ("incubator", "Incubadora"),
    "accelerators": ("accelerator", "Aceleradora"),
    "operationParks": ("park", "Parque em Operacao"),
    "implantationParks": ("park", "Parque em Implantacao"),
    "planningParks": ("park", "Parque em Planejamento"),
    "incubatedCompanies": ("company", "Empresa Incubada"),
    "acceleratedCompanies": ("company", "Empresa Acelerada"),
    "graduatedCompanies": ("company", "Empresa Graduada"),
    "residentCompanies": ("company", "Empresa Residente"),
}

# fixed values: an actor's fields; scalars of any JSON kind are read as text
ACTOR = """
id string, category_id string, linkable_type string, linkable_id string, name string, acronym string, corporate_name string, cnpj string,
telephone string, email string, site string, instagram string, linkedin string, logo_path string, institution string, active string,
company_status_id string, cnae_id string, graduated string, founding_year string, founding_date string, termination_year string,
pre_acceleration_year string, acceleration_year string, pre_incubation_year string, start_incubation_year string, end_incubation_year string,
spin_off string, expertise_areas array<string>, affiliated_societies_cities string, motivations_for_opening string,
main_participation_aspects string, meet_way_id string,
address struct<postcode: string, street: string, number: string, complement: string, neighborhood: string, latitude: string, longitude: string,
  city: struct<id: string, name: string, state: struct<id: string, name: string, uf: string>>>,
created_at string, updated_at string"""


def payload_schema() -> T.StructType:
    return T.StructType([T.StructField("manifest_id", T.StringType())] + [T.StructField(c, T.ArrayType(T.StringType())) for c in COLLECTIONS])


def read_org_payload(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC-10 + NST-4: ``manifest_id, collection, actor, raw`` of every actor
    of the payloads below ``path`` (folders ``manifest_id=...``); ``raw`` is
    the actor's own JSON text."""
    doc = spark.read.schema(payload_schema()).option("mode", "FAILFAST").option("multiLine", str(multi_line).lower()).json(path)

    def items(c: str):
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda a: F.struct(F.lit(c).alias("collection"), a.alias("raw")))

    actors = doc.select("manifest_id", F.inline(F.concat(*[items(c) for c in COLLECTIONS])))
    return actors.select("manifest_id", "collection", F.from_json("raw", ACTOR).alias("actor"), "raw")


def write_org_payload(actors: DataFrame, path: str, per_document: int = 500) -> str:
    """The inverse: ``manifest_id, collection, raw`` rows as payload objects of
    about ``per_document`` actors, one a line, in folders by run."""
    part = F.pmod(F.xxhash64("manifest_id", "raw"), F.lit(1 << 30))
    sizes = actors.groupBy("manifest_id").agg(F.ceil(F.count(F.lit(1)) / per_document).alias("parts"))
    dealt = actors.join(sizes, "manifest_id").withColumn("part", part % F.col("parts"))
    arrays = [F.concat(F.lit(f'"{c}":['), F.array_join(F.sort_array(F.collect_list(F.when(F.col("collection") == c, F.col("raw")))), ","), F.lit("]")) for c in COLLECTIONS]
    docs = dealt.groupBy("manifest_id", "part").agg(F.concat(F.lit("{"), F.concat_ws(",", *arrays), F.lit("}")).alias("value"))
    docs.select("manifest_id", "value").write.mode("overwrite").partitionBy("manifest_id").text(path)
    return path
