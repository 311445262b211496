"""A keyed table on disk in which the newest row of a key wins (SNK-4, STR-2/3),
safe against a writer that dies anywhere.

Nothing is rewritten in place. A batch is a slice, a folder of its own, in key
buckets; replaying the batch replaces its own slice only. A reader merges the
finished slices with the newest finished base and takes each key's newest row.
``compact`` writes that merge as a new base with the list of the slices it
holds; a base counts once both are written to their end. Slices and bases are
deleted only when a base before the newest holds them, so readers that began
with it finish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.common import first_by
from tessera.sources.stored import StoredTable, drop_folder, finished, folder_names

#: key buckets, and slices after which a writer compacts
BUCKETS = 64
SLICES = 16


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, schema, keys: list[str], order: list[Column], buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys, self.order, self.buckets = spark, root.rstrip("/"), schema, keys, order, buckets

    # --- what is there -------------------------------------------------------

    def _bases(self) -> list[str]:
        return [b for b in folder_names(self.spark, f"{self.root}/base") if all(finished(self.spark, f"{self.root}/base/{b}/{t}") for t in ("rows", "slices"))]

    def _held_by(self, base: str) -> set[str]:
        return {r["value"] for r in self.spark.read.text(f"{self.root}/base/{base}/slices").collect()}  # slice names, bounded by compaction

    def slices(self) -> list[str]:
        """Finished slices that the newest base does not hold."""
        held = self._held_by(self._bases()[-1]) if self._bases() else set()
        return [s for s in folder_names(self.spark, f"{self.root}/slices") if s not in held and finished(self.spark, f"{self.root}/slices/{s}")]

    def exists(self) -> bool:
        return bool(self._bases() or self.slices())

    def _parts(self) -> list[DataFrame]:
        paths = [f"{self.root}/base/{b}/rows" for b in self._bases()[-1:]] + [f"{self.root}/slices/{s}" for s in self.slices()]
        return [self.spark.read.schema(f"{self._ddl()}, bucket int").parquet(p) for p in paths]

    def _ddl(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)

    def read(self) -> DataFrame:
        """The newest row of every key."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return first_by(rows, self.keys, self.order).drop("bucket")

    # --- writing -------------------------------------------------------------

    def put(self, df: DataFrame, name: str) -> None:
        """Write a batch as the slice ``name``: the newest row of each key."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = first_by(df.select(*[f.name for f in self.schema.fields]), self.keys, self.order)
        rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/slices/{name}")
        if len(self.slices()) > SLICES:
            self.compact()

    def compact(self) -> None:
        names, bases = self.slices(), self._bases()
        if not names:
            return
        held = sorted((self._held_by(bases[-1]) if bases else set()) | set(names))
        path = StoredTable(self.spark, f"{self.root}/base").next_path()
        rows = self.read().withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
        self.spark.createDataFrame([(h,) for h in held], "value string").coalesce(1).write.text(f"{path}/slices")
        # what the base before this one holds has no reader left
        if bases:
            old = self._held_by(bases[-1])
            for s in folder_names(self.spark, f"{self.root}/slices"):
                if s in old:
                    drop_folder(self.spark, f"{self.root}/slices/{s}")
            for b in bases[:-1]:
                drop_folder(self.spark, f"{self.root}/base/{b}")
