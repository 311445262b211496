"""File sources: positional registry dumps, header patent CSVs, geography
tables (organization payloads: ``org_payload``). All text is read as STRING with an
explicit schema (never inferred) and typed by the cleaning jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: column count per registry dump
DUMP_COLUMNS = {"empresas": 7, "estabelecimentos": 30, "socios": 11, "simples": 7, "lookup": 2}


def dump_schema(n: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])


def read_dump(spark: SparkSession, path: str, kind: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """SRC-1..5: ``;``-separated, quoted, no header, Latin-1; rows with the
    wrong number of fields are dropped (needs CSV column pruning off, which
    the session sets)."""
    return (spark.read.schema(dump_schema(DUMP_COLUMNS[kind])).option("sep", ";").option("quote", '"')
            .option("escape", '"').option("header", "false").option("encoding", encoding)
            .option("mode", "DROPMALFORMED").csv(path))


def write_dump(df: DataFrame, path: str, encoding: str = "ISO-8859-1") -> str:
    """Inverse of ``read_dump`` (for round trips and fixtures)."""
    (df.write.mode("overwrite").option("sep", ";").option("quote", '"').option("escape", '"')
     .option("encoding", encoding).option("header", "false").csv(path))
    return path


def latin_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: ``file`` of every file under ``path`` that is not valid UTF-8.
    Every line of every file is tested, on the executors."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    return lines.groupBy("file").agg(F.min("ok").alias("ok")).filter("not ok").select("file")


def read_patent_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """SRC-8: header CSV, all text, quoted fields may hold line breaks; column
    names trimmed, lower-cased and stripped of a byte-order mark. Without an
    ``encoding`` each file is read as UTF-8 if all of it is, else as Latin-1."""
    def read(paths, enc: str) -> DataFrame:
        df = (spark.read.option("header", "true").option("inferSchema", "false").option("encoding", enc)
              .option("multiLine", "true").option("quote", '"').option("escape", '"').csv(paths))
        return df.toDF(*[c.replace("\ufeff", "").replace("ï»¿", "").strip().lower() for c in df.columns])

    if encoding:
        return read(path, encoding)
    latin = sorted(r["file"] for r in latin_files(spark, path).collect())  # file names, as many as files
    if not latin:
        return read(path, "UTF-8")
    every = {r["file"] for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    rest = sorted(every - set(latin))
    out = read(latin, "ISO-8859-1")
    return out.unionByName(read(rest, "UTF-8"), allowMissingColumns=True) if rest else out


# fixed values: accepted column names for geography inputs, first match wins
GEO_FALLBACKS = {"codigo": ["codigo", "code", "cd_mun", "cd_uf", "id"],
                 "nome": ["nome", "name", "nm_mun", "nm_uf"],
                 "uf": ["uf", "sigla_uf", "abbrev", "sg_uf"]}


def read_geography(df: DataFrame) -> DataFrame:
    """SRC-11: normalise a states / municipalities table to (codigo, nome,
    uf, rings) whatever its column naming."""
    cols = {c.lower(): c for c in df.columns}
    sel = []
    for target, names in GEO_FALLBACKS.items():
        src = next((cols[n] for n in names if n in cols), None)
        sel.append((F.col(src) if src else F.lit(None).cast("string")).cast("string").alias(target))
    sel.append(F.col(cols["rings"]).alias("rings") if "rings" in cols else F.lit(None).alias("rings"))
    return df.select(*sel)
