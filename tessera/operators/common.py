"""Shared DataFrame helpers: first-per-key, paging, totals."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def strip_accents_upper(text: str) -> str:
    """A typed search text as the names are stored: upper case, no accents."""
    parts = unicodedata.normalize("NFD", text.strip().upper())
    return "".join(ch for ch in parts if unicodedata.category(ch) != "Mn")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key under a total order (``DISTINCT ON``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def page(df: DataFrame, order: Sequence[Column], page_no: int = 1, size: int = 20,
         max_size: int = 100) -> DataFrame:
    """SRT-1: one page after a total order. A page number below 1 or a size
    outside 1 to ``max_size`` is an error, never changed silently."""
    if page_no < 1 or not 1 <= size <= max_size:
        raise ValueError(f"page {page_no} of {size} rows: pages start at 1 and hold 1 to {max_size} rows")
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """WIN-5: ``COUNT(*) OVER ()`` as an aggregate attached to every row (no
    unpartitioned window), over rows that are made once."""
    from tessera.session import stage_table
    df = stage_table(df, "counted")
    total = df.agg(F.count(F.lit(1)).alias(name))
    return attach_scalars(df, total)


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    Each column becomes a scalar subquery (evaluated once, merged with its
    siblings by the optimizer, its value inlined into the projection): no
    join of any kind and no single-partition window."""
    out = df
    for c in one_row.columns:
        out = out.withColumn(c, one_row.select(c).scalar())
    return out


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """SRT-3: ``orderBy.limit`` -> TakeOrderedAndProject (per-partition top-k
    then merge, never a full sort)."""
    return df.orderBy(*order).limit(k)


def with_month(df: DataFrame, month: str) -> DataFrame:
    return df.withColumn("reference_month", F.lit(month))
