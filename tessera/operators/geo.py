"""Geography: point-in-polygon join by a multi-level grid, polygon measures,
GeoJSON, geography upserts, state inference and the registry <-> national
municipality crosswalk.

A polygon table has ``rings: array<array<struct<x: double, y: double>>>``
(first ring outer, the rest holes; x = longitude, y = latitude) or, for
multi-polygons, ``parts``, an array of such. Geometry functions are off in
this Spark build, so all of it is stated with plain DataFrame operators.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.common import first_by

EARTH_RADIUS_KM = 6371.0088
CELL_DEG = 1.0
#: grid levels; each cell has 4 x 4 children, so sizes stay exact in doubles
LEVELS = 3
#: points a grid cell and join key hold at most, in the mean
HOT_CELL = 50_000
SRID = 4674


def parts_of(polys: DataFrame) -> Column:
    """A polygon's parts, each an outer ring and its holes."""
    return F.col("parts") if "parts" in polys.columns else F.array("rings")


def _ring_edges(r: Column) -> Column:
    return F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.struct(
        p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def edges_of(parts: Column) -> Column:
    """All edges of all rings."""
    return F.flatten(F.transform(F.flatten(parts), _ring_edges))


def _crossed(x: Column, y: Column):
    """Whether a ray from the point to +x crosses an edge: it straddles the
    point's y and the crossing lies right of the point."""
    def test(e):
        at = e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)
    return test


def _on_edge(x: Column, y: Column):
    def test(e):
        cross = (e["by"] - e["ay"]) * (x - e["ax"]) - (e["bx"] - e["ax"]) * (y - e["ay"])
        return ((cross == 0) & (x >= F.least(e["ax"], e["bx"])) & (x <= F.greatest(e["ax"], e["bx"]))
                & (y >= F.least(e["ay"], e["by"])) & (y <= F.greatest(e["ay"], e["by"])))
    return test


def _touches(x0: Column, y0: Column, x1: Column, y1: Column):
    """Whether an edge meets a box: their extents meet, and the box's corners
    do not all lie on one side of the edge's line."""
    def test(e):
        def side(x, y):
            return (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        sides = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
        return ((F.least(e["ax"], e["bx"]) <= x1) & (F.greatest(e["ax"], e["bx"]) >= x0) & (F.least(e["ay"], e["by"]) <= y1)
                & (F.greatest(e["ay"], e["by"]) >= y0) & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0))
    return test


def bbox(polys: DataFrame, id_col: str = "codigo") -> DataFrame:
    """Per polygon: min/max x and y over all ring points."""
    pts = F.flatten(F.flatten(parts_of(polys)))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return polys.select(id_col, F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def bbox_cells(polys: DataFrame, id_col: str = "codigo", cell: float = CELL_DEG) -> DataFrame:
    """GEO-2: grid cells covered by each polygon's bounding box."""
    b = bbox(polys, id_col)
    cx = F.sequence(F.floor(F.col("x0") / cell).cast("int"), F.floor(F.col("x1") / cell).cast("int"))
    cy = F.sequence(F.floor(F.col("y0") / cell).cast("int"), F.floor(F.col("y1") / cell).cast("int"))
    return (b.select(id_col, "x0", "x1", "y0", "y1", F.explode(cx).alias("cx"))
            .select(id_col, "x0", "x1", "y0", "y1", "cx", F.explode(cy).alias("cy")))


def bbox_candidates(points: DataFrame, polys: DataFrame, pid: str = "pid", id_col: str = "codigo",
                    cell: float = CELL_DEG) -> DataFrame:
    """Point x polygon pairs whose bounding box contains the point: equi join
    on the point's cell, exact box test after. Never a cartesian product."""
    pc = points.select(pid, "x", "y", F.floor(F.col("x") / cell).cast("int").alias("cx"),
                       F.floor(F.col("y") / cell).cast("int").alias("cy"))
    cells = bbox_cells(polys, id_col, cell)
    j = pc.join(cells, ["cx", "cy"])
    return j.filter((F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1"))
                    & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))).select(pid, "x", "y", id_col)


def polygon_cells(polys: DataFrame, id_col: str = "codigo", cell: float = CELL_DEG, levels: int = LEVELS) -> DataFrame:
    """GEO-2, multi-level: ``id_col, level, cx, cy, inner, edges``. A cell that
    no edge meets is dropped or, inside the polygon, kept whole (``inner``);
    one that an edge meets is split in 4 x 4, down to the last level, where it
    keeps the edges that a ray to +x from within it may meet."""
    kind = "array<struct<ax: double, ay: double, bx: double, by: double>>"
    rows = bbox_cells(polys, id_col, cell).select(id_col, "cx", "cy").join(polys.select(id_col, edges_of(parts_of(polys)).alias("edges")), id_col)
    rows = rows.select(id_col, F.lit(0).alias("level"), "cx", "cy", F.lit(False).alias("done"), F.lit(False).alias("inner"), "edges")
    for level in range(levels):
        size = cell / 4 ** level
        x0, y0 = F.col("cx") * size, F.col("cy") * size
        x1, y1 = x0 + size, y0 + size
        near = F.filter("edges", lambda e: (F.greatest(e["ay"], e["by"]) >= y0) & (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ax"], e["bx"]) >= x0))
        rows = rows.withColumn("edges", F.when(F.col("done"), F.col("edges")).otherwise(near))
        met = F.exists("edges", _touches(x0, y0, x1, y1))
        inside = F.size(F.filter("edges", _crossed(x0 + size / 2, y0 + size / 2))) % 2 == 1

        def cells(dx, dy, level_, done, inner, edges):
            return F.struct(F.lit(level_).alias("level"), dx.alias("cx"), dy.alias("cy"), F.lit(done).alias("done"), F.lit(inner).alias("inner"), edges.alias("edges"))

        none = F.array().cast(kind)
        here = F.array(F.struct("level", "cx", "cy", "done", "inner", "edges"))
        whole = F.array(cells(F.col("cx"), F.col("cy"), level, True, True, none))
        if level + 1 < levels:
            part = F.array(*[cells(F.col("cx") * 4 + i, F.col("cy") * 4 + j, level + 1, False, False, F.col("edges")) for i in range(4) for j in range(4)])
        else:
            part = F.array(cells(F.col("cx"), F.col("cy"), level, True, False, F.col("edges")))
        rows = rows.select(id_col, F.inline(F.when(F.col("done"), here).when(met, part).when(inside, whole)))
    return rows.drop("done")


def covers(points: DataFrame, polys: DataFrame, pid: str = "pid", id_col: str = "codigo", cell: float = CELL_DEG, levels: int = LEVELS,
           hot: int = HOT_CELL) -> DataFrame:
    """GEO-1: (point, polygon) pairs where the polygon covers the point
    (boundary counts): an equi join of each point's cells, one a level, with
    the polygons' cells. Inner cells need no test; the others are tested by the
    even-odd rule over the few edges kept with them, and a point on an edge is
    covered outright. A cell of more than ``hot`` points is dealt to several
    join keys, so one big city is many tasks."""
    x, y = F.col("x"), F.col("y")
    at = [F.struct(F.lit(i).alias("level"), F.floor(x / (cell / 4 ** i)).cast("int").alias("cx"), F.floor(y / (cell / 4 ** i)).cast("int").alias("cy")) for i in range(levels)]
    key = ["level", "cx", "cy"]
    placed = points.filter(x.isNotNull() & y.isNotNull()).select(pid, "x", "y", F.inline(F.array(*at)))
    # counted with map-side combine; at most ``levels`` / ``hot`` of the points remain
    crowded = (placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
               .select(*key, F.ceil(F.col("n") / hot).cast("int").alias("deals")))
    placed = placed.join(crowded, key, "left").withColumn("deal", F.when(F.col("deals").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(pid, "x", "y"), F.col("deals")).cast("int"))).drop("deals")
    cells = polygon_cells(polys, id_col, cell, levels).join(crowded, key, "left")
    cells = cells.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    inside = F.col("inner") | (F.size(F.filter("edges", _crossed(x, y))) % 2 == 1) | F.exists("edges", _on_edge(x, y))
    return placed.join(cells, [*key, "deal"]).filter(inside).select(pid, id_col)


def assign_polygon(points: DataFrame, polys: DataFrame, pid: str = "pid", state_col: str = "uf",
                   id_col: str = "codigo") -> DataFrame:
    """JOIN-17 + WIN-6: each point's covering municipality, preferring one
    in the point's declared state, then the lowest code; points covered by
    none keep NULL."""
    hit = covers(points.select(pid, "x", "y"), polys, pid, id_col)
    meta = polys.select(id_col, F.col("uf").alias("poly_uf"), F.col("nome").alias("poly_nome"))
    hit = hit.join(meta, id_col).join(points.select(pid, F.col(state_col).alias("_decl_uf")), pid)
    best = first_by(hit, [pid], [F.when(F.col("poly_uf") == F.col("_decl_uf"), 0).otherwise(1), F.col(id_col)])
    return points.join(best.drop("_decl_uf"), pid, "left")


def _ring_rows(polys: DataFrame, id_col: str, *measures) -> DataFrame:
    """``id_col, part, ring`` and per ring the sums of measures over its edges
    (functions of the edge)."""
    rings = polys.select(id_col, F.posexplode(parts_of(polys)).alias("part", "rs")).select(id_col, "part", F.posexplode("rs").alias("ring", "r"))
    e = rings.select(id_col, "part", "ring", F.explode(_ring_edges(F.col("r"))).alias("e"))
    return e.groupBy(id_col, "part", "ring").agg(*[F.sum(m(F.col("e"))).alias(f"m{i}") for i, m in enumerate(measures)])


def polygon_centroid(polys: DataFrame, id_col: str = "codigo") -> DataFrame:
    """GEO-3: area-weighted centroid over all parts, holes taken off
    (shoelace), whatever way a ring runs."""
    def cross(e):
        return e["ax"] * e["by"] - e["bx"] * e["ay"]

    g = _ring_rows(polys, id_col, cross, lambda e: (e["ax"] + e["bx"]) * cross(e), lambda e: (e["ay"] + e["by"]) * cross(e))
    sign = F.signum("m0") * F.when(F.col("ring") == 0, 1).otherwise(-1)
    total = g.groupBy(id_col).agg(*[F.sum(sign * F.col(m)).alias(m) for m in ("m0", "m1", "m2")])
    return total.select(id_col, F.round(F.col("m1") / (3 * F.col("m0")), 6).alias("longitude"), F.round(F.col("m2") / (3 * F.col("m0")), 6).alias("latitude"))


def polygon_area(polys: DataFrame, id_col: str = "codigo") -> DataFrame:
    """GEO-4: area in km^2 on the sphere (outer rings minus holes):
    |sum over edges of (lon2 - lon1) * (2 + sin lat1 + sin lat2)| * R^2 / 2."""
    rad = math.pi / 180.0
    g = _ring_rows(polys, id_col, lambda e: (e["bx"] - e["ax"]) * rad * (2 + F.sin(e["ay"] * rad) + F.sin(e["by"] * rad)))
    signed = F.when(F.col("ring") == 0, F.abs("m0")).otherwise(-F.abs("m0"))
    return g.groupBy(id_col).agg(F.round(F.sum(signed) * (EARTH_RADIUS_KM ** 2) / 2, 3).alias("area_km2"))


def surface_point(parts: Column) -> Column:
    """GEO-3: a point that surely lies inside, as ``struct<x, y>``: of each
    part the middle of the widest stretch on a level line that passes no
    corner, half way between the corners next to the part's mid height; the
    widest of all parts wins."""
    def of_part(rings):
        ys = F.transform(F.flatten(rings), lambda p: p["y"])
        mid = (F.array_min(ys) + F.array_max(ys)) / 2
        y = (F.array_min(F.filter(ys, lambda v: v > mid)) + F.array_max(F.filter(ys, lambda v: v <= mid))) / 2
        edges = F.flatten(F.transform(rings, _ring_edges))
        xs = F.array_sort(F.transform(F.filter(edges, lambda e: (e["ay"] > y) != (e["by"] > y)),
                                      lambda e: e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))
        ins = F.filter(xs, lambda v, i: i % 2 == 0)
        outs = F.filter(xs, lambda v, i: i % 2 == 1)
        return F.array_max(F.zip_with(ins, outs, lambda a, b: F.struct((b - a).alias("w"), ((a + b) / 2).alias("x"), y.alias("y"))))

    best = F.array_max(F.transform(parts, of_part))
    return F.struct(best["x"].alias("x"), best["y"].alias("y"))


def geojson_of(polys: DataFrame, digits: int = 5) -> Column:
    """GeoJSON text of a row's geometry, coordinates rounded."""
    def points(r):
        return F.transform(r, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))

    if "parts" in polys.columns:
        coords = F.transform("parts", lambda rings: F.transform(rings, points))
        return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform("rings", points).alias("coordinates")))


def to_geojson(polys: DataFrame, id_col: str = "codigo", digits: int = 5) -> DataFrame:
    """GEO-5: GeoJSON geometry with coordinates rounded to 5 dp."""
    return polys.select(id_col, geojson_of(polys, digits).alias("geometry"))


def parse_geojson(c: Column) -> Column:
    """A Polygon or MultiPolygon text as parts (one part for a Polygon); NULL
    for anything else."""
    got = F.from_json(c, "type string, coordinates string")
    one = F.from_json(got["coordinates"], "array<array<array<double>>>")
    many = F.from_json(got["coordinates"], "array<array<array<array<double>>>>")

    def rings(part):
        return F.transform(part, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))

    return F.when(got["type"] == "Polygon", F.array(rings(one))).when(got["type"] == "MultiPolygon", F.transform(many, rings))


# fixed values: accepted column names of the national frames, first match wins
FRAME_COLUMNS = {
    "state": {"state_ibge_code": ["code_state", "code_state_ibge"], "state_abbrev": ["abbrev_state", "state_abbrev"], "state_name": ["name_state", "state_name"]},
    "municipality": {"municipality_ibge_code": ["code_muni", "municipality_ibge_code"], "state_ibge_code": ["code_state", "state_ibge_code"],
                     "state_abbrev": ["abbrev_state", "state_abbrev"], "municipality_name": ["name_muni", "municipality_name"]},
}
CODE_WIDTH = {"state_ibge_code": 2, "municipality_ibge_code": 7}
#: rows of a year from which on a geography counts as loaded
LOADED = {"state": 27, "municipality": 5500}


def _code(c: Column, width: int) -> Column:
    """A geography code: digits of a whole number or text, zeros in front; a
    row without one stops the load."""
    number = c.try_cast("double")
    text = F.when(number.isNotNull() & (number == F.floor(number)), F.floor(number).cast("string")).otherwise(F.regexp_replace(c.cast("string"), r"\D", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))).otherwise(
        F.raise_error(F.lit("a geography row has no code")))


def geography_rows(frame: DataFrame, kind: str, year: int, simplified: bool, source: str) -> DataFrame:
    """A national frame (``geometry``: GeoJSON text) as reference rows: codes
    padded, abbreviations upper case, polygons made multi-polygons, with a
    point inside, the area and the reference system."""
    named = {}
    for target, names in FRAME_COLUMNS[kind].items():
        found = next((n for n in names if n in frame.columns), None)
        if found is None:
            raise ValueError(f"no column {' or '.join(names)} among {', '.join(frame.columns)}")
        c = F.col(found)
        named[target] = _code(c, CODE_WIDTH[target]) if target in CODE_WIDTH else F.upper(F.trim(c)) if target == "state_abbrev" else F.trim(c)
    key = f"{kind}_ibge_code"
    rows = frame.select(*[c.alias(n) for n, c in named.items()], F.lit(year).alias("geobr_year"), F.lit(simplified).alias("is_simplified"),
                        F.lit(source).alias("source_name"), F.lit(None).cast("string").alias("source_version"), parse_geojson(F.col("geometry")).alias("parts"))
    rows = rows.withColumns({"geometry_srid": F.lit(SRID), "point": surface_point(F.col("parts"))})
    rows = rows.withColumns({"latitude": F.col("point.y"), "longitude": F.col("point.x")}).drop("point")
    return rows.join(polygon_area(rows, key), key, "left")


def upsert_geography(target: DataFrame | None, frame: DataFrame, kind: str, year: int = 2020, simplified: bool = True, source: str = "geobr") -> DataFrame:
    """GEO-6: the reference table after a load of ``frame``: rows of a code
    that is there are replaced, others added. A year that counts as loaded
    is left as it is. The caller writes the result to a new version."""
    from tessera.sources.sinks import upsert
    if target is not None:
        held = target.filter((F.col("geobr_year") == year) & (F.col("is_simplified") == simplified)).count()
        if held >= LOADED[kind]:
            return target
    rows = geography_rows(frame, kind, year, simplified, source)
    return rows if target is None else upsert(target, rows, [f"{kind}_ibge_code"])


def infer_state(establishments: DataFrame) -> DataFrame:
    """AGG-17: per registry municipality code, the state if exactly one
    distinct state uses it, else NULL; with the state count."""
    g = establishments.filter(F.col("codigo_municipio").isNotNull() & F.col("uf").isNotNull()) \
        .groupBy("codigo_municipio").agg(F.count_distinct("uf").alias("n_ufs"), F.max("uf").alias("_uf"))
    return g.select("codigo_municipio", F.when(F.col("n_ufs") == 1, F.col("_uf")).alias("uf_inferida"), "n_ufs")


def build_crosswalk(registry_munis: DataFrame, inferred: DataFrame, national: DataFrame) -> DataFrame:
    """JOIN-19: registry municipality -> national code by (inferred state,
    name key). Status: mapped (exactly one candidate), ambiguous (several),
    not_found (none), no_state (state not inferable)."""
    r = registry_munis.select(F.col("codigo").alias("codigo_municipio"), F.col("nome").alias("nome_rf")) \
        .join(inferred, "codigo_municipio", "left").withColumn("k", C.name_key("nome_rf"))
    n = (national.select(F.col("codigo").alias("codigo_ibge"), F.col("uf").alias("n_uf"),
                              C.name_key("nome").alias("k")))
    j = r.join(n, (r.k == n.k) & (r.uf_inferida == n.n_uf), "left").drop(n.k)
    w = Window.partitionBy("codigo_municipio")
    j = j.withColumn("n_cand", F.count("codigo_ibge").over(w))
    status = (F.when(F.col("uf_inferida").isNull(), "no_state").when(F.col("n_cand") == 0, "not_found")
              .when(F.col("n_cand") == 1, "mapped").otherwise("ambiguous"))
    out = j.withColumn("status", status)
    return first_by(out, ["codigo_municipio"], [F.col("codigo_ibge").asc_nulls_last()]).select(
        "codigo_municipio", "nome_rf", "uf_inferida",
        F.when(F.col("status") == "mapped", F.col("codigo_ibge")).alias("codigo_ibge"), "n_cand", "status")


def municipality_geo(crosswalk: DataFrame, national: DataFrame) -> DataFrame:
    """JOIN-20: registry municipality ⟕ crosswalk ⟕ national polygon data."""
    n = national.select(F.col("codigo").alias("codigo_ibge"), F.col("nome").alias("nome_ibge"), "uf",
                        "latitude", "longitude")
    return crosswalk.join(n, "codigo_ibge", "left")


def geo_gate(states: DataFrame, munis: DataFrame, crosswalk: DataFrame, min_states: int = 27,
             min_munis: int = 5500) -> DataFrame:
    """AGG-22: load gate counts and pass flag."""
    s = states.agg(F.count(F.lit(1)).alias("states"))
    m = munis.agg(F.count(F.lit(1)).alias("municipalities"))
    c = crosswalk.agg(F.count_if(F.col("status") == "mapped").alias("mapped"),
                      F.count_if(F.col("status") != "mapped").alias("issues"))
    from tessera.operators.common import attach_scalars
    out = attach_scalars(attach_scalars(s, m), c)
    return out.withColumn("passed", (F.col("states") >= min_states) & (F.col("municipalities") >= min_munis))
