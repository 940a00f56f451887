"""Helpers that several operators share: tables, shared storage, Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

V = TypeVar("V")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores where the scan has tasks for less than half of them, as for a single small file.

    Tables of a size that matters have more tasks than that and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, as a URI.

    Only where the session names none, and everything runs on this machine,
    a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}" if base.startswith("/") else base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in one shared folder that go when their user is done, or one by one."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.base, self.paths = spark, shared_dir(spark, purpose), {}

    def write(self, df: DataFrame, purpose: str) -> DataFrame:
        """As ``materialize``; a table of the same purpose written before stays."""
        path = f"{self.base}/{len(self.paths)}-{purpose}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(self.paths[id(t)][1])

    def clear(self) -> None:
        self._remove(self.base)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def utf8(column: str):
    """The column's text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows and few bytes, so that what Python makes of them stays small.

    A row over ``size`` bytes is a part of its own.
    """
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


_kept: dict[tuple, object] = {}


def kept(key: tuple, build: Callable[[], V]) -> V:
    """What ``build`` makes, once for each Python worker in a row of tasks.

    A worker keeps the last key's value only: the next operator's tables
    replace these, so that workers that live on do not gather state.
    """
    if key not in _kept:
        release()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    """Drops what an operator before has left in this worker, and gives the memory back; for tasks that keep nothing themselves."""
    if _kept:
        _kept.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)
    pa.default_memory_pool().release_unused()


def hash_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, the first by a hash of the key.

    A share of the rows, by the same hash, is taken first: else every task
    would send as many rows as are wanted in all.
    """
    size = 1 << 30
    share = min(size, size * 4 * limit // max(1, df.count()))
    place = F.pmod(F.xxhash64(key), F.lit(size))
    return df.where(place < share).orderBy(place, key).limit(limit)


def join_counted(rows: DataFrame, named: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of the rows with ``named``, which has one row for each key and, in ``n``, how many rows have it.

    Keys with more than one row in ``share`` of ``total``, of which there are
    fewer than ``share``, are broadcast, so that no task gets all rows of one;
    the others shuffle.
    """
    often = F.col("n") * share > total
    hot, rest = F.broadcast(named.where(often).drop("n")), named.where(~often).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key))


def arrow_type(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema])


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
