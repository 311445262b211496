"""Innovation-organization snapshots shaped from ``events``: one event is one
collected snapshot of an organization record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.proxies import _s, _uf_of_region, muni_name, table

# fixed values: collection per event type
COLLECTIONS = {"view": "incubadoras", "click": "aceleradoras", "signup": "parques", "purchase": "empresas",
               "error": "coworkings"}


def raw_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.columns import check_digits, format_id
    ev = table(spark, sf_dir, "events")
    n = table(spark, sf_dir, "nation")
    u = F.col("user_id")
    df = ev.withColumn("_k", u % 25).join(F.broadcast(n), F.col("_k") == F.col("n_nationkey"))
    coll = None
    for k, v in COLLECTIONS.items():
        coll = F.when(F.col("event_type") == k, F.lit(v)) if coll is None else coll.when(F.col("event_type") == k, F.lit(v))
    # the formatted id is a per-organization value: computed once per id on
    # the distinct ids and joined back (keeps the per-event stage small)
    ids = ev.select((u % 1500).alias("_idk")).distinct()
    base = F.concat(F.lpad(_s(F.col("_idk")), 8, "0"), F.lit("0001"))
    ids = ids.select("_idk", format_id(F.concat(base, check_digits(base))).alias("_fmt"))
    df = df.withColumn("_idk", u % 1500).join(ids, "_idk")
    cnpj = F.when(u % 7 == 0, F.lit("")).otherwise(F.col("_fmt"))
    city = muni_name(F.col("n_nationkey"), F.initcap(F.col("n_name")))
    city = F.when(u % 5 == 0, F.translate(city, "ãíÃÍ", "aiAI")).otherwise(city)
    uf = _uf_of_region(F.col("n_regionkey"))
    uf = F.when(u % 11 == 0, _uf_of_region((F.col("n_regionkey") + 1) % 5)).otherwise(uf)
    k_pt = F.when(u % 6 == 0, (u + 1) % 25).otherwise(u % 25)
    v = F.col("value")
    lon = (k_pt * 2 - 70).cast("double") + F.pmod(v, F.lit(2.0))
    lat = (F.col("n_regionkey") * 4 - 30).cast("double") + F.pmod(v, F.lit(4.0))
    nocoord = F.col("event_id") % 9 == 0
    return df.select(
        F.col("event_id").alias("id"),
        F.date_format("ts", "yyyy-MM-dd").alias("manifest_id"),
        coll.alias("collection"), _s(u).alias("record_id"),
        F.concat(F.lit("Org "), _s(u)).alias("nome"),
        F.concat(F.lit("ORG"), _s(u % 100)).alias("sigla"),
        F.when(u % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Instituto "), _s(u % 50), F.lit(" S.A."))).alias("razao_social"),
        F.when(u % 3 == 0, F.lit(" Organization ")).otherwise(F.lit("COMPANY")).alias("tipo"),
        F.concat(F.lit("Categoria "), F.initcap(F.col("event_type"))).alias("categoria"),
        F.concat(F.lit("Estado de "), F.initcap(F.col("n_name"))).alias("estado"),
        cnpj.alias("cnpj"),
        F.concat(F.lit(" "), city, F.lit(" ")).alias("cidade"), uf.alias("uf"),
        F.when(nocoord, F.lit(None).cast("double")).otherwise(F.round(lat, 6)).alias("latitude"),
        F.when(nocoord, F.lit(None).cast("double")).otherwise(F.round(lon, 6)).alias("longitude"),
        F.col("ts").alias("collected_at"),
        # every 50th payload holds an API key
        F.when(F.col("event_id") % 50 == 0, F.concat(F.col("props"), F.lit(" key=AIza"), F.lpad(_s(F.col("event_id")), 35, "x"), F.lit("&z")))
         .otherwise(F.col("props")).alias("payload"),
        F.array(F.lit(" tech "), F.lit(""), F.col("event_type")).alias("areas"),
    )


def linked_orgs(orgs: DataFrame) -> DataFrame:
    """Snapshot rows under the platform's collection names, with a parent
    link: three parent models by record id, every fourth record without."""
    rid = F.col("record_id").cast("int")

    def turn(*names):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (rid % len(names) + 1).cast("int"))

    name = (F.when(F.col("collection") == "incubadoras", F.lit("incubators")).when(F.col("collection") == "aceleradoras", F.lit("accelerators"))
            .when(F.col("collection") == "parques", turn("operationParks", "implantationParks", "planningParks"))
            .when(F.col("collection") == "empresas", turn("incubatedCompanies", "graduatedCompanies"))
            .otherwise(turn("residentCompanies", "acceleratedCompanies", "others")))
    model = (F.when(rid % 4 == 0, F.lit("App\\Models\\Incubator")).when(rid % 4 == 1, F.lit("App\\Models\\Accelerator"))
             .when(rid % 4 == 2, F.lit("App\\Models\\Park")))
    return orgs.withColumns({"collection": name, "linkable_type": model, "linkable_id": F.when(model.isNotNull(), ((rid + 1) % 150).cast("string"))})


def raw_actors(orgs: DataFrame) -> DataFrame:
    """``manifest_id, collection, raw``: the platform's actors as JSON texts,
    from ``raw_orgs`` rows: nested address, city and state, numbers as numbers
    or texts, blanks, a foreign collection, and a key in every 50th."""
    o = linked_orgs(orgs)
    u, e = F.col("record_id").cast("int"), F.col("id")
    iso = F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss.000000'Z'")
    state = F.struct((u % 90).alias("id"), F.col("estado").alias("name"), F.col("uf"))
    city = F.struct((F.lit(1_000_000) + u).alias("id"), F.col("cidade").alias("name"), state.alias("state"))
    address = F.struct(F.concat(_s(u % 99_999), F.lit("-00")).alias("postcode"), F.concat(F.lit(" Rua "), _s(u % 300)).alias("street"), (u % 2000).alias("number"),
                       F.when(u % 3 == 0, F.lit("  ")).otherwise(F.lit("Sala 1")).alias("complement"), F.lit("Centro").alias("neighborhood"),
                       _s(F.col("latitude")).alias("latitude"), F.when(u % 17 == 0, F.lit("west")).otherwise(_s(F.col("longitude"))).alias("longitude"), city.alias("city"))

    def turn(*values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (u % len(values) + 1).cast("int"))

    actor = F.struct(
        u.alias("id"), F.when(u % 9 > 0, u % 9).alias("category_id"), F.col("linkable_type"), F.col("linkable_id"),
        F.when(u % 10 == 0, F.lit("  ")).otherwise(F.col("nome")).alias("name"), F.col("sigla").alias("acronym"), F.col("razao_social").alias("corporate_name"), F.col("cnpj"),
        F.concat(F.lit("55"), _s(u)).alias("telephone"), F.concat(_s(u), F.lit("@org.br ")).alias("email"), turn("", "https://org.br/").alias("site"),
        turn("a", None, "\t").alias("instagram"), F.lit("in").alias("linkedin"), F.lit("logo.png").alias("logo_path"), turn("UFX", None).alias("institution"),
        turn("true", "sim", "não", "x", "0").alias("active"), (u % 7).alias("company_status_id"), turn("12", "12.5", " 7 ", "").alias("cnae_id"),
        (u % 2 == 0).alias("graduated"), (F.lit(1990) + u % 30).alias("founding_year"), turn("05/03/2019", "2020-02-29", "2019-02-29", "").alias("founding_date"),
        turn("2021", None).alias("termination_year"), (F.lit(2000) + u % 9).alias("pre_acceleration_year"), turn("2001", "n/a").alias("acceleration_year"),
        turn(None, "2002").alias("pre_incubation_year"), F.lit("2003").alias("start_incubation_year"), F.lit("99999").alias("end_incubation_year"), (u % 4 == 1).alias("spin_off"),
        F.when(u % 8 > 0, F.col("areas")).alias("expertise_areas"), F.when(u % 2 == 0, F.array(F.struct((u % 5).alias("id")))).alias("affiliated_societies_cities"),
        F.array().cast("array<string>").alias("motivations_for_opening"), F.when(u % 3 == 1, F.array(F.lit("a"))).alias("main_participation_aspects"), (u % 3).alias("meet_way_id"),
        F.when(e % 9 > 0, address).alias("address"), iso.alias("created_at"), F.when(u % 6 > 0, iso).alias("updated_at"),
        # a field that no column is made for
        F.when(e % 50 == 0, F.concat(F.lit("AIza"), F.lpad(_s(e), 35, "x"))).alias("api"))
    return o.select("manifest_id", "collection", F.to_json(actor).alias("raw"))
