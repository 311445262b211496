"""Stored tables that are replaced while they are read (SNK-9).

A stored table is a folder of versions. A refresh writes a new version beside
the served one; the newest version that was written to its end is served, so a
reader either sees the old rows or the new ones, and one that was opened
before a refresh finishes with its old files. Older versions are dropped once
``KEEP`` newer ones are there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: finished versions that stay: the served one and the one before it
KEEP = 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names below ``path``, in order; none where it is missing."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def finished(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def input_version(spark: SparkSession, paths: list[str]) -> str:
    """Names, lengths and times of the files of ``paths``, as one text: it
    changes whenever a table does."""
    out = []
    for path in paths:
        fs, p = _fs(spark, path)
        stack = [fs.getFileStatus(p)]
        while stack:
            s = stack.pop()
            if s.isDirectory():
                stack += list(fs.listStatus(s.getPath()))
            else:
                out.append(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}")
    return "|".join(sorted(out))


class StoredTable:
    """``tables``: names of the tables that a version consists of, all of
    which must be written to their end (none: the version is one table)."""

    def __init__(self, spark: SparkSession, root: str, tables: tuple[str, ...] = ()):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def versions(self) -> list[str]:
        parts = [f"/{t}" for t in self.tables] or [""]
        return [v for v in folder_names(self.spark, self.root) if all(finished(self.spark, f"{self.root}/{v}{t}") for t in parts)]

    def path(self) -> str | None:
        """The folder that is served now."""
        found = self.versions()
        return f"{self.root}/{found[-1]}" if found else None

    def next_path(self) -> str:
        """A folder for the next version; two refreshes at a time take two."""
        every = folder_names(self.spark, self.root)
        return f"{self.root}/{int(every[-1].split('-')[0]) + 1 if every else 1:010d}-{uuid.uuid4().hex[:8]}"

    def tidy(self) -> None:
        """Drop finished versions but the last ``KEEP``."""
        for old in self.versions()[:-KEEP]:
            drop_folder(self.spark, f"{self.root}/{old}")

    def refresh(self, df: DataFrame) -> str:
        path = self.next_path()
        df.write.option("compression", "zstd").parquet(path)
        self.tidy()
        return path

    def read(self, build) -> DataFrame:
        """The served version; the first request builds it."""
        return self.spark.read.parquet(self.path() or self.refresh(build()))
