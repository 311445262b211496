"""Operator 11, centroid clustering with geometric drift tightening.

Vectors are turned into integers, so every distance, sum and floor is exact.
A table of bounds is written to the shared folder: each vector with the
cluster ``a`` it had when the table was written, an upper bound ``u`` of its
distance to that centroid and a lower bound ``l`` of its distance to any other.
A round reads that table once and sends back one row a cluster and task. The
bounds are not rewritten every round: all vectors of one ``a`` loosen alike, so
the driver keeps two numbers a cluster. ``u`` grows by the way the own centroid
went. ``l`` shrinks by less than the way another centroid went: the cluster
lies in a sphere, the move of the other centroid and the sphere's centre lie in
a plane, and within it no point of the sphere may come nearer than the move
times the cosine of the least angle between the move and a ray from its middle
into the sphere (``loosening``). A vector whose bounds, or the half distance to
the next centroid, leave no doubt stays; the others are scanned exactly. After
every ``refresh`` rounds the table is written anew with the bounds of the day
and the old one is deleted.

Defined results: a vector that is null, of another length than ``size``, or
holds a null or a non-finite number is left out; a null id is clustered like
others but starts a centroid only where ids run out; repeated rows count and
return as often as they occur; fewer vectors than ``k`` start that many
centroids; an empty table gives an empty result. Integers beyond 2**27 in
size, whose squared distances would not fit a long, are an error. Columns
besides the named ones are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, prepare, stage

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3
#: rounds that one table of bounds serves
REFRESH = 4
#: the largest integer component
LARGEST = 1 << 27
#: up to this size, products in doubles are exact
_SMALL = 1 << 22
#: what rounding may add to a bound, relatively
_SLACK = 1e-9


@dataclass
class Model:
    """``centroids`` after the last round, and per round the vectors read,
    those scanned against all centroids, and the loosening of the lower bounds
    beside the full drift (means over pairs of clusters)."""

    centroids: np.ndarray
    figures: list[dict] = field(default_factory=list)


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: floor(scale * component) of every vector that is kept."""
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce((F.size(v) == size) & F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))), F.lit(False))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("double"))
    return vectors.filter(fine).select(F.col(key).alias("vec_id"), x.alias("x"))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    if not len(x):
        return np.zeros((0, len(centroids)), np.int64)
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < _SMALL:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """``[a, j]``: the most that a point within ``radius[a]`` of ``old[a]`` may
    have come nearer to centroid j by its move from ``old[j]`` to ``new[j]``.

    For a point at the angle t, seen from the move's middle, the distances to
    both ends differ by at most the move times cos t; the sphere is seen from
    there under the angle to its centre, less arcsin(radius / distance)."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    move = new - old
    way = np.sqrt((move ** 2).sum(1))
    ray = old[:, None, :] - ((old + new) / 2)[None, :, :]
    far = np.sqrt((ray ** 2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(np.einsum("ajd,jd->aj", ray, move) / (far * way[None, :]), -1, 1))
        least = angle - np.arcsin(np.clip(radius[:, None] * (1 + _SLACK) / far, 0, 1)) - _SLACK
    inside = ~(far > radius[:, None] * (1 + _SLACK))
    seen = np.where(inside | ~np.isfinite(least), 0.0, np.maximum(least, 0.0))
    return way[None, :] * np.where(seen >= np.pi / 2, 0.0, np.cos(seen)) * (1 + _SLACK)


@dataclass
class _Bounds:
    """How far the bounds of the table have loosened, and the centroids of now."""

    centroids: np.ndarray
    up: np.ndarray
    low: np.ndarray

    def half(self) -> np.ndarray:
        """Half the distance from each centroid to the nearest other."""
        d = np.sqrt(_distances(self.centroids, self.centroids).astype(np.float64))
        np.fill_diagonal(d, np.inf)
        return d.min(1, initial=np.inf) / 2

    def judge(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray, half: np.ndarray):
        """``(cluster, upper, lower, scanned)`` of the vectors of now."""
        near, upper, lower = a.copy(), u + self.up[a], l - self.low[a]
        other = np.maximum(lower, half[a])
        doubt = np.flatnonzero(upper * (1 + _SLACK) >= other)
        own = np.sqrt(((x[doubt] - self.centroids[a[doubt]]) ** 2).sum(1).astype(np.float64))
        upper[doubt] = own * (1 + _SLACK)
        doubt = doubt[own * (1 + 2 * _SLACK) >= other[doubt]]
        if len(doubt):
            d = _distances(x[doubt], self.centroids)
            best = d.argmin(1)  # the first of equals
            first = d[np.arange(len(d)), best]
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            near[doubt], upper[doubt] = best, np.sqrt(first.astype(np.float64)) * (1 + _SLACK)
            lower[doubt] = np.sqrt(d.min(1).astype(np.float64)) * (1 - _SLACK)
        return near, upper, lower, len(doubt)


def _rows(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _start(centroids: np.ndarray):
    """Vectors -> the first table of bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, centroids.shape[1])
                everything = _Bounds(centroids, np.full(len(centroids), np.inf), np.zeros(len(centroids)))
                zero = np.zeros(len(x))
                yield _bound_rows(batch, *everything.judge(x, zero.astype(np.int64), zero, zero, zero[:len(centroids)])[:3])

    return run


def _bound_rows(batch: pa.RecordBatch, a, u, l) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), batch.column(batch.schema.get_field_index("x")),
                                       pa.array(a.astype(np.int32)), pa.array(u), pa.array(l)], ["vec_id", "x", "a", "u", "l"])


def _renew(bounds: _Bounds):
    """The table of bounds -> the table with the bounds of now."""
    half = bounds.half()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, u, l = (_column(batch, c) for c in "aul")
                yield _bound_rows(batch, *bounds.judge(_rows(batch, bounds.centroids.shape[1]), a.astype(np.int64), u, l, half)[:3])

    return run


def _sums(bounds: _Bounds):
    """The table of bounds -> rows, scans and component sums of each cluster,
    one row a cluster and task."""
    half = bounds.half()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = bounds.centroids.shape
        n, scans, total = np.zeros(k, np.int64), 0, np.zeros((k, size), np.int64)
        for batch in batches:
            if batch.num_rows:
                a, u, l = (_column(batch, c) for c in "aul")
                x = _rows(batch, size)
                near, _, _, scanned = bounds.judge(x, a.astype(np.int64), u, l, half)
                n += np.bincount(near, minlength=k)
                scans += scanned
                for c in np.unique(near):
                    total[c] += x[near == c].sum(0)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array([scans] + [0] * (k - 1), pa.int64()),
                                              pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "scans", "total"])

    return run


def _assign(bounds: _Bounds):
    """The table of bounds -> the clusters of now and the exact distances."""
    half = bounds.half()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, u, l = (_column(batch, c) for c in "aul")
                x = _rows(batch, bounds.centroids.shape[1])
                near = bounds.judge(x, a.astype(np.int64), u, l, half)[0]
                exact = ((x - bounds.centroids[near]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), pa.array(near.astype(np.int32)), pa.array(exact)],
                                                 ["vec_id", "cluster", "distance"])

    return run


def first_centroids(points: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of smallest hash; of one id, the smallest vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(name.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([[int(c) for c in r["x"]] for r in rows], dtype=np.int64).reshape(len(rows), -1)


def _table(points: DataFrame, run, name: str) -> DataFrame:
    kind = points.schema["vec_id"].dataType.simpleString()
    return stage(points.mapInArrow(run, f"vec_id {kind}, x array<int>, a int, u double, l double"), name)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE,
            scale: int = SCALE, seed: int = SEED, refresh: int = REFRESH) -> tuple[DataFrame, Model]:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``
    of every kept vector, and the model."""
    spark = prepare(vectors.sparkSession)
    points = integer_vectors(vectors, key, vector, size, scale)
    kind = points.schema["vec_id"].dataType
    largest = points.select(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    if largest is None:
        empty = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
                              T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
        return spark.createDataFrame([], empty), Model(np.zeros((0, size), np.int64))
    if largest > LARGEST:
        raise ValueError(f"a component of {largest} is beyond {LARGEST}: its squared distances do not fit a long")
    points = points.withColumn("x", F.col("x").cast("array<int>"))
    centroids = first_centroids(points, k, seed)
    k = len(centroids)
    model = Model(centroids)
    table = _table(points, _start(centroids), "bounds")
    bounds, widest = _Bounds(centroids, np.zeros(k), np.zeros(k)), _widest(table, k)
    for r in range(1, rounds + 1):
        found = table.mapInArrow(_sums(bounds), "cluster int, n long, scans long, total array<long>")
        rows = found.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("scans").alias("scans"),
                                            F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total")).collect()  # one row a cluster
        moved = bounds.centroids.copy()
        for row in rows:
            if row["n"]:
                moved[row["cluster"]] = [t // row["n"] for t in row["total"]]
        nearer = loosening(bounds.centroids, moved, widest + bounds.up)
        way = np.sqrt(((moved - bounds.centroids).astype(np.float64) ** 2).sum(1))
        others = ~np.eye(k, dtype=bool)
        model.figures.append({"round": r, "vectors": sum(x["n"] for x in rows), "scanned": sum(x["scans"] for x in rows),
                              "loosened": float(nearer[others].mean()) if k > 1 else 0.0, "drift": float(np.broadcast_to(way, (k, k))[others].mean()) if k > 1 else 0.0})
        bounds = _Bounds(moved, bounds.up + way * (1 + _SLACK), bounds.low + np.where(others, nearer, 0).max(1))
        if r % refresh == 0 and r < rounds:
            old, table = table, _table(table, _renew(bounds), "bounds")
            discard(old)
            bounds, widest = _Bounds(moved, np.zeros(k), np.zeros(k)), _widest(table, k)
    model.centroids = bounds.centroids
    placed = stage(table.mapInArrow(_assign(bounds), f"vec_id {kind.simpleString()}, cluster int, distance long"), "clusters")
    discard(table)
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids.tolist()]

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    out = placed.select("vec_id", "cluster", "distance", of_cluster([inertia.get(c, 0) for c in range(k)], "long").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of_cluster(names, "string").alias("centroid_sha256"))
    return out, model


def _widest(table: DataFrame, k: int) -> np.ndarray:
    """The radius of each cluster's sphere around its centroid."""
    out = np.zeros(k)
    for r in table.groupBy("a").agg(F.max("u").alias("u")).collect():  # one row a cluster
        out[r["a"]] = r["u"]
    return out


def _oracle() -> str:
    """The registered query's rows in DuckDB SQL: plain rounds, every vector
    against every centroid."""
    parts = [f"""pts AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * c)::BIGINT for c in embedding::DOUBLE[]] AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len([c for c in embedding::DOUBLE[] if c IS NULL OR NOT isfinite(c)]) = 0)""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster, x FROM pts QUALIFY cluster < {CLUSTERS})"]
    for r in range(ROUNDS + 1):
        parts.append(f"""d{r} AS (SELECT rid, vec_id, p.x, cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, c.x)])::BIGINT AS d FROM pts p CROSS JOIN c{r} c),
a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d := d, cluster := cluster)) AS best FROM d{r} GROUP BY rid)""")
        if r < ROUNDS:
            parts.append(f"""s{r} AS (SELECT best.cluster AS cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}),
m{r} AS (SELECT cluster, list(f ORDER BY i) AS x FROM (SELECT cluster, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f FROM s{r} GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.cluster::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
    (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.best.cluster"""


ORACLE_SQL = _oracle()
