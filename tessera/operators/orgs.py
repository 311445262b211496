"""Innovation organizations: snapshot flattening, latest snapshot per
record, searches, municipality validation against polygons, and the exact
registry match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import geo as GEO
from tessera.operators.common import first_by

# fixed values: the API-key shape redacted from stored payloads
API_KEY_PATTERN = r"AIza[0-9A-Za-z\-_]{35}"


def flatten_orgs(raw: DataFrame) -> DataFrame:
    """PRJ-24 + NST-1 + NST-8: typed organization rows with the raw payload
    beside them; arrays cleaned (items trimmed, blanks dropped); name falls
    back to the acronym."""
    return raw.select(
        "id", "manifest_id", "collection", "record_id",
        F.coalesce(C.norm("nome"), C.norm("sigla")).alias("nome"), C.norm("sigla").alias("sigla"),
        C.norm("razao_social").alias("razao_social"), F.lower(C.norm("tipo")).alias("tipo"), C.norm("categoria").alias("categoria"),
        C.norm("cnpj").alias("cnpj"), C.norm("cidade").alias("cidade"), C.norm("estado").alias("estado"), C.norm("uf").alias("uf"),
        "latitude", "longitude", "collected_at",
        clean_array(F.col("areas")).alias("areas"),
        redact_secrets(F.col("payload")).alias("payload"))


# fixed values: words of the platform's flags
_YES, _NO = ["1", "true", "t", "yes", "y", "sim"], ["0", "false", "f", "no", "n", "nao", "não"]


#: blanks of any kind: the space separators and the control blanks
_BLANKS = C.ZS_CHARS + "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"


def _text(c):
    """Trimmed of blanks of any kind; nothing left is NULL."""
    return F.nullif(F.trim(c, F.lit(_BLANKS)), F.lit(""))


def _flag(c):
    t = F.lower(_text(c))
    return F.when(t.isin(_YES), True).when(t.isin(_NO), False)


def _whole(c, typ: str = "int"):
    """Whole numbers only ('12.0' and 'true' are none)."""
    t = _text(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast(typ))


def _json_or_empty(c):
    """A JSON value as text; one that is missing or empty counts as no items."""
    return F.when(c.isNull() | c.isin("", "{}", "[]", "0", "false", '""'), F.lit("[]")).otherwise(c)


def organization_rows(actors: DataFrame) -> DataFrame:
    """PRJ-24 + NST-1 + NST-8: the 52 columns of an organization snapshot, from
    the nested actors of ``read_org_payload``."""
    from tessera.sources.org_payload import COLLECTIONS

    def of_collection(i: int):
        return F.element_at(F.create_map(*[F.lit(x) for c, v in COLLECTIONS.items() for x in (c, v[i])]), F.col("collection"))

    a, address, city, state = (F.col(x) for x in ("actor", "actor.address", "actor.address.city", "actor.address.city.state"))
    text, whole = lambda *names: [_text(a[n]).alias(n) for n in names], lambda *names, typ="smallint": [_whole(a[n], typ).alias(n) for n in names]
    return actors.select(
        "manifest_id", F.col("collection").alias("source_collection"), _whole(a["id"], "bigint").alias("source_record_id"), of_collection(0).alias("entity_kind"),
        *whole("category_id", typ="int"), of_collection(1).alias("category_label"), a["linkable_type"].alias("source_linkable_type"),
        _whole(a["linkable_id"], "bigint").alias("source_linkable_id"),
        F.coalesce(_text(a["name"]), F.concat(F.lit("source-record-"), F.coalesce(a["id"], F.lit("None")))).alias("name"),
        *text("acronym", "corporate_name"), C.digits(a["cnpj"], 14).alias("cnpj"),
        *text("telephone", "email", "site", "instagram", "linkedin", "logo_path", "institution"), _flag(a["active"]).alias("active"),
        *whole("company_status_id", "cnae_id", typ="int"), _flag(a["graduated"]).alias("graduated"), *whole("founding_year"),
        C.parse_date(a["founding_date"]).alias("founding_date"),
        *whole("termination_year", "pre_acceleration_year", "acceleration_year", "pre_incubation_year", "start_incubation_year", "end_incubation_year"),
        _flag(a["spin_off"]).alias("spin_off"), clean_array(F.coalesce(a["expertise_areas"], F.array().cast("array<string>"))).alias("expertise_area_codes"),
        *[_json_or_empty(a[n]).alias(n) for n in ("affiliated_societies_cities", "motivations_for_opening", "main_participation_aspects")],
        *whole("meet_way_id", typ="int"), C.digits(address["postcode"], 8).alias("postcode"), _text(address["street"]).alias("street"),
        _text(address["number"]).alias("street_number"), _text(address["complement"]).alias("complement"),
        _text(address["neighborhood"]).alias("neighborhood"), C.digits(city["id"], 7).alias("city_ibge_code"), _text(city["name"]).alias("city_name"),
        C.digits(state["id"], 2).alias("state_ibge_code"), _text(state["name"]).alias("state_name"), _text(state["uf"]).alias("state_abbrev"),
        _text(address["latitude"]).try_cast("decimal(10,7)").alias("latitude"), _text(address["longitude"]).try_cast("decimal(10,7)").alias("longitude"),
        C.parse_ts(a["created_at"]).alias("source_created_at"), C.parse_ts(a["updated_at"]).alias("source_updated_at"),
        redact_secrets(F.col("raw")).alias("raw_payload"))


def clean_array(c):
    """NST-1: trim items, drop blanks."""
    return F.filter(F.transform(c, lambda x: C.utrim(x)), lambda x: x.isNotNull() & (x != ""))


def redact_secrets(c):
    """PRJ-25: API keys anywhere in a JSON text."""
    return F.regexp_replace(c, API_KEY_PATTERN, "[REDACTED]")


def latest_orgs(orgs: DataFrame) -> DataFrame:
    """WIN-3: latest snapshot per (collection, record): collected_at desc,
    id desc."""
    return first_by(orgs, ["collection", "record_id"], [F.col("collected_at").desc(), F.col("id").desc()])


def _holds(text: str, *names: str):
    """Any of the fields contains the text, whatever its case."""
    cond = F.lit(False)
    for name in names:
        cond = cond | F.coalesce(F.col(name), F.lit("")).ilike(f"%{text.strip()}%")
    return cond


def search_orgs(orgs: DataFrame, q=None, kind=None, category=None, city=None, state=None, uf=None, collection=None) -> DataFrame:
    """FLT-7: text over name, corporate name and acronym; kind and state code
    exact; category, city and state name contained; collection exact."""
    tests = [_holds(q, "nome", "razao_social", "sigla") if q else None, F.col("tipo") == kind.strip().lower() if kind else None,
             _holds(category, "categoria") if category else None, _holds(city, "cidade") if city else None,
             _holds(state, "estado") if state else None, F.col("uf") == uf.strip().upper() if uf else None,
             F.col("collection") == collection if collection else None]
    for test in tests:
        orgs = orgs if test is None else orgs.filter(test)
    return orgs


def scope_orgs(orgs: DataFrame, q=None, kind=None, uf=None) -> DataFrame:
    """FLT-8: rows that a validation looks at: text over name, city, category
    and collection; kind and state code exact."""
    tests = [_holds(q, "nome", "cidade", "categoria", "collection") if q else None,
             F.col("tipo") == kind.strip().lower() if kind else None, F.col("uf") == uf.strip().upper() if uf else None]
    for test in tests:
        orgs = orgs if test is None else orgs.filter(test)
    return orgs


def validation_rows(latest: DataFrame, munis: DataFrame) -> DataFrame:
    """JOIN-17 + FLT-9 + FN-37: each latest organization with the polygon
    that covers its point, the SQL issue flag (lower+trim comparison) and
    the accent-insensitive status label; the two can disagree on purpose
    ('Sao' vs 'São' is an issue row labelled ok)."""
    pts = latest.select(F.struct("collection", "record_id").alias("pid"), F.col("longitude").alias("x"),
                        F.col("latitude").alias("y"), "uf").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    hit = GEO.assign_polygon(pts, munis, pid="pid").select("pid", F.col("codigo").alias("poly_codigo"),
                                                           "poly_nome", "poly_uf")
    j = latest.withColumn("pid", F.struct("collection", "record_id")).join(hit, "pid", "left").drop("pid")
    has_coords = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    has_poly = F.col("poly_codigo").isNotNull()
    state_ok = F.coalesce(F.col("uf"), F.lit("")) == F.coalesce(F.col("poly_uf"), F.lit(""))
    city_sql_ok = (F.lower(F.trim(F.coalesce(F.col("cidade"), F.lit(""))))
                   == F.lower(F.trim(F.coalesce(F.col("poly_nome"), F.lit("")))))
    city_label_ok = C.city_key(F.coalesce(F.col("cidade"), F.lit(""))) == C.city_key(
        F.coalesce(F.col("poly_nome"), F.lit("")))
    return j.withColumn("is_issue", ~has_coords | ~has_poly | ~state_ok | ~city_sql_ok) \
        .withColumn("status", C.validation_status(has_coords, has_poly, state_ok, city_label_ok))


def severity_order(rows: DataFrame) -> DataFrame:
    """SRT-4: missing coords, no polygon, state, city, ok; then name, id."""
    rank = (F.when(F.col("status") == "coordinates_missing", 0).when(F.col("status") == "polygon_not_found", 1)
            .when(F.col("status") == "state_mismatch", 2).when(F.col("status") == "municipality_mismatch", 3)
            .otherwise(4))
    return rows.orderBy(rank, F.col("nome").asc_nulls_last(), F.col("record_id"), F.col("collection"))


def validation_summary(rows: DataFrame) -> DataFrame:
    """AGG-11: total and issue count."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_issue").alias("issues"),
                    F.count_if(F.col("status") == "ok").alias("ok"))


def divergence_pct(summary: DataFrame) -> DataFrame:
    """AGG-19: issues as a percentage of all records, 0 of none."""
    return summary.select("total", "issues", F.when(F.col("total") > 0, F.col("issues") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("divergence_pct"))


def top_cities(rows: DataFrame, col: str, k: int = 10) -> DataFrame:
    """AGG-11: top-k cities by organizations (ties by name)."""
    return rows.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("cidade")) \
        .agg(F.count(F.lit(1)).alias("total")).orderBy(F.col("total").desc(), "cidade").limit(k)


def seed_matches(orgs: DataFrame) -> DataFrame:
    """DQ-7: match seeds: 14-digit id split in three parts -> pending, else
    invalid."""
    d = C.digits_only(F.coalesce("cnpj", F.lit("")))
    ok = F.length(d) == 14
    return orgs.select(
        "collection", "record_id", F.when(ok, d).alias("cnpj_14"),
        F.when(ok, F.left(d, F.lit(8))).alias("cnpj_basico"), F.when(ok, F.substring(d, 9, 4)).alias("cnpj_ordem"),
        F.when(ok, F.substring(d, 13, 2)).alias("cnpj_dv"),
        F.when(ok, F.lit("pending")).otherwise(F.lit("invalid")).alias("status"))


def match_orgs(seeds: DataFrame, establishments: DataFrame, companies: DataFrame) -> DataFrame:
    """JOIN-13: exact match of pending seeds on the 3-part id; matched rows
    carry method, confidence 1.0 and a JSON evidence object."""
    est = establishments.select("cnpj_basico", "cnpj_ordem", "cnpj_dv", F.lit(True).alias("_est"),
                                "situacao_cadastral")
    comp = companies.select("cnpj_basico", "razao_social")
    j = seeds.join(est, ["cnpj_basico", "cnpj_ordem", "cnpj_dv"], "left").join(comp, "cnpj_basico", "left")
    matched = F.col("_est").isNotNull() & (F.col("status") == "pending")
    return j.select(
        "collection", "record_id", "cnpj_14",
        F.when(F.col("status") == "invalid", "invalid").when(matched, "matched").otherwise("unmatched").alias("status"),
        F.when(matched, "exact_cnpj").alias("method"),
        F.when(matched, F.lit(1.0)).alias("confidence"),
        F.when(matched, F.to_json(F.struct(F.col("cnpj_14").alias("cnpj"), "razao_social",
                                           "situacao_cadastral"))).alias("evidence"))
