"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches to Python workers: rows and bytes at most, so that very long
#: texts do not pile up in one batch.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Python workers find this package as the driver does
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), _ROOT)))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local
    master (tests) may go without it and gets a scratch folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="tessera-llm-")
    sc.setCheckpointDir(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(staged: DataFrame) -> None:
    """Delete the folder of a table that ``stage`` wrote and nothing reads any
    more: what came of it must have been written before."""
    path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged.stage_path)
    path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint for a side whose counted ``rows`` stay under
    ``max_rows``; beyond it the join is left to the shuffle joins and AQE."""
    return F.broadcast(df) if rows <= max_rows else df


def small_broadcast(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast hint for a table whose measured bytes (texts and arrays by
    their length, other values as 16) stay under ``max_bytes``; beyond it the
    join is left to the shuffle joins and AQE. ``df`` is a written table or
    little work upon one."""
    def width(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(c)
        if isinstance(field.dataType, T.ArrayType):
            return F.octet_length(F.to_json(F.struct(c)))
        return F.lit(16)

    total = F.lit(0)
    for field in df.schema.fields:
        total = total + F.coalesce(width(field), F.lit(0)) + 8
    size = df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind as it takes to be unlike any
    column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str) -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def in_fold(column: str, modulus: int, value: int) -> Column:
    """Whether the id's remainder is ``value`` (false for a null id)."""
    return F.coalesce(remainder(column, modulus) == F.lit(value), F.lit(False))


def text_udf(make: Callable[[], Callable[[Iterator[str]], list[dict]]], returns: T.DataType):
    """An Arrow UDF over one text column. ``make`` is called once a task and
    gives a function from a batch's texts (an iterator, null as ``""``) to one
    dict of the result struct's fields a row."""
    fields = pa.struct([(f.name, _arrow(f.dataType)) for f in returns.fields])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = make()
        for batch in batches:
            rows = step(v.as_py() or "" for v in batch)
            yield pa.array(rows, type=fields)

    return array_udf(run, returns)


def array_udf(run, returns: T.DataType):
    """An Arrow UDF over the batches of one column, evaluated once a row."""
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns).asNondeterministic()


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
            "boolean": pa.bool_(), "binary": pa.binary()}[t.simpleString()]
