"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster sets it; a temporary folder only where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="cubeloom-"))
    return _local[0]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages reread files instead of recomputing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Types whose values Arrow takes as Python has them (times depend on a zone, nested ones on the kind of row).
_PLAIN = (T.IntegralType, T.FractionalType, T.StringType, T.BinaryType, T.BooleanType, T.DateType)


def local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows of the driver as a table. They go as Arrow: a plain list is unpickled by Python workers of another kind than the operators' (an RDD's,
    with a daemon of their own), which stay in the executors beside those."""
    if not all(isinstance(f.dataType, _PLAIN) for f in schema):
        return spark.createDataFrame(rows, schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=schema.names), schema)


def replaced(df: DataFrame, *names: str) -> list[str]:
    """Columns of df other than names, compared without case as Spark does: an input column named like an output gives way."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
