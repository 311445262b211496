"""Connected components of an edge table by alternating large-star and
small-star steps. Every step is a combinable minimum per node and a join, so
no node's neighbours meet in one task; the driver sees one checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stage

MAX_ROUNDS = 60


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``(node, root)`` for every node of ``edges`` that is not a root itself;
    ``root`` is the smallest node of its component. Nodes without an edge, and
    roots, have no row (their root is the node itself). Nulls and self-links
    are ignored; repeated edges count once; an empty table gives none."""
    start = (edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
             .filter("u is not null and v is not null and u <> v").distinct())
    current = stage(start, "edges")
    seen = _checksum(current)
    if seen[0]:
        for _ in range(MAX_ROUNDS):
            before, current = current, stage(_small_star(_large_star(current)), "edges")
            discard(before)
            now = _checksum(current)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
