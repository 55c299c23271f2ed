"""Reading and writing tables, with what keeps large ones cheap."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """A table, of which only the given columns are read; text formats need a schema, so that no pass infers one."""
    if kind not in FORMATS:
        raise ValueError(f"{kind!r} is none of {', '.join(FORMATS)}")
    if kind in ("json", "csv") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    return df if columns is None else df.select(*columns)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Iterable[str] = (), mode: str = "error") -> None:
    """Writes the rows; with partition columns, rows of one partition are brought together first, split if they are many."""
    if kind not in FORMATS:
        raise ValueError(f"{kind!r} is none of {', '.join(FORMATS)}")
    keys = list(partition_by)
    if keys:
        df = df.hint("rebalance", *keys)
    writer = df.write.format(kind).mode(mode)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*keys) if keys else writer).save(path)
