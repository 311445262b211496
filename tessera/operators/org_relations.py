"""Organization parent resolution (JOIN-14) and the resolved relationship
and match views (JOIN-15, JOIN-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import first_by

# fixed values: parent model -> candidate parent collections, in order
PARENT_COLLECTIONS = {
    "App\\Models\\Incubator": ["incubators"],
    "App\\Models\\Accelerator": ["accelerators"],
    "App\\Models\\Park": ["operationParks", "implantationParks", "planningParks"],
}
# fixed values: child collection -> relationship type
RELATIONSHIP_TYPE = {
    "incubatedCompanies": "incubated_by",
    "acceleratedCompanies": "accelerated_by",
    "graduatedCompanies": "graduated_from",
    "residentCompanies": "resident_in",
}


def org_relationships(orgs: DataFrame) -> DataFrame:
    """JOIN-14: for each snapshot row with a parent link, the parent row of
    the same manifest found in the first candidate collection that has it;
    unresolved links keep a NULL parent. The link is the input's
    ``linkable_type`` and ``linkable_id``; candidates come from the fixed
    (model, collection, order) table: one equi join, then ``row_number`` by
    candidate order."""
    spark = orgs.sparkSession
    cand = spark.createDataFrame([(m, c, i) for m, cs in PARENT_COLLECTIONS.items() for i, c in enumerate(cs)],
                                 "linkable_type string, parent_collection string, cand_order int")
    rel = None
    for k, v in RELATIONSHIP_TYPE.items():
        rel = F.when(F.col("collection") == k, F.lit(v)) if rel is None else rel.when(F.col("collection") == k, v)
    child = orgs.filter((F.col("linkable_type") != "") & F.col("linkable_id").isNotNull()).select(
        "manifest_id", F.col("id").alias("child_organization_id"), F.col("collection").alias("child_collection"),
        rel.otherwise(F.lit("linked_to")).alias("relationship_type"), "linkable_type", "linkable_id")
    parents = orgs.groupBy("manifest_id", F.col("collection").alias("parent_collection"),
                           F.col("record_id").alias("linkable_id")).agg(F.max("id").alias("parent_organization_id"))
    hit = (child.join(F.broadcast(cand), "linkable_type")
           .join(parents, ["manifest_id", "parent_collection", "linkable_id"]))
    best = first_by(hit, ["child_organization_id", "relationship_type"], [F.col("cand_order")]).select(
        "child_organization_id", "relationship_type", "parent_organization_id")
    return child.join(best, ["child_organization_id", "relationship_type"], "left").select(
        "manifest_id", "child_organization_id", "relationship_type", F.col("linkable_type").alias("parent_model_class"),
        F.col("linkable_id").alias("parent_source_record_id"), "parent_organization_id",
        F.to_json(F.struct(F.col("child_collection").alias("child_source_collection"), "linkable_type",
                           "linkable_id")).alias("relationship_metadata"))


def relationships_resolved(rels: DataFrame, orgs: DataFrame) -> DataFrame:
    """JOIN-15: relationship ⋈ child organization ⟕ parent organization."""
    o = orgs.select("id", "nome", "collection")
    return (rels.join(o.select(F.col("id").alias("child_organization_id"), F.col("nome").alias("child_nome")),
                      "child_organization_id")
            .join(o.select(F.col("id").alias("parent_organization_id"), F.col("nome").alias("parent_nome"),
                           F.col("collection").alias("parent_collection")), "parent_organization_id", "left"))


def matches_resolved(matches: DataFrame, orgs: DataFrame, companies: DataFrame,
                     establishments: DataFrame) -> DataFrame:
    """JOIN-16: match ⋈ organization ⟕ company ⟕ establishment."""
    m = matches.join(orgs.select("collection", "record_id", "nome"), ["collection", "record_id"])
    m = m.withColumn("cnpj_basico", F.left(F.col("cnpj_14"), F.lit(8)))
    comp = companies.select("cnpj_basico", "razao_social")
    est = establishments.select(F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv").alias("cnpj_14"),
                                "situacao_cadastral", "uf")
    return m.join(comp, "cnpj_basico", "left").join(est, "cnpj_14", "left")
