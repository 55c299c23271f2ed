"""Helpers shared by the corpus operators: column picking, table access and shared storage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the given new names: ``pick(df, key="doc_id")``.

    Columns are found by exact name and position, so other columns whose names differ only in
    case, or occur twice, do no harm (the first of equal names counts).
    """
    places = {new: df.columns.index(old) for new, old in wanted.items()}
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__c{i}").alias(new) for new, i in places.items()])


def values(column: Any) -> Iterator[Any]:
    """The Python values of an Arrow array, one at a time, so that a batch's texts are not all held twice."""
    return (x.as_py() for x in column)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before each one, memory that this worker has freed goes back to the system.

    Workers are used again by later stages, and would else keep the most that any stage has needed.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    for b in batches:
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)
        yield b
        del b
    if trim:
        trim(0)


#: Bytes for each core below which a table is dealt out again.
SMALL = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables.

    A small one may lie in a single row group, which one task would read and work on; its rows are
    dealt to all cores. Others are left as the files have them.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL * cores
    return df.repartition(cores) if small else df


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of partitions that the session deals out in shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is unset (a local
    session, as in tests) a temporary folder of this machine is used. All paths of an application
    lie in one folder with its id, which can be deleted when the application has ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir() + "/loomwright"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again, which cuts the lineage."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys (8 to 16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows of one key that a single task may get in a join.
KEY_ROWS = 5_000


def sized(keys: DataFrame) -> DataFrame:
    """Rows of a few short columns, marked to be broadcast if they have been counted and are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """The inner join on a long ``key`` that is unique in ``table``, with the rows of frequent keys dealt to several tasks.

    Keys with more than KEY_ROWS rows, and more than the mean of a partition, are frequent; there are
    fewer of them than partitions. Each gets so many salts that none has much more than that, and
    its row of ``table`` is repeated for every salt. Both inputs should be stored; ``total`` is the
    number of ``rows``, if it is known.
    """
    total = rows.count() if total is None else total
    parts = shuffle_partitions(rows.sparkSession)
    share = max(total // parts, KEY_ROWS)
    if total <= share:
        return rows.join(table, key)
    # Fewer than ``parts`` keys can each have more than total / parts rows, so the limit loses none of them.
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = [(r[key], 1 + 2 * r["__n"] // share) for r in counts.where(F.col("__n") > share).limit(parts).collect()]
    if not hot:
        return rows.join(table, key)
    listed = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} long, __salts int"))
    left = rows.join(listed, key, "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    right = table.join(listed, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def held_out(key: Column) -> Column:
    """True for the fifth of the documents that models never learn from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
