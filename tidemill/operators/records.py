"""Whole records: defaults, validation, shortening, encoding, and small tables kept by hand."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.text import first_filled
from tidemill.operators.batch import with_index
from tidemill.operators.quota import ranked_within
from tidemill.operators.selection import permuted


def coalesced(df: DataFrame, fields: Mapping[str, Sequence[str]], default: str = "") -> DataFrame:
    """Each field from the first of its columns that is there and filled, else the default."""
    return df.select(*((F.coalesce(first_filled(*(F.col(c) for c in names if c in df.columns)), F.lit(default)) if any(c in df.columns for c in names) else F.lit(default)).alias(f) for f, names in fields.items()))


def opening_question(turns: Column, speaker: str = "human") -> Column:
    """The first value that the speaker has in a list of turns with ``from`` and ``value``."""
    return F.get(F.filter(turns, lambda x: x["from"] == speaker), F.lit(0))["value"]


def validated(df: DataFrame, defaults: Mapping[str, str], allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Missing or empty fields get their default, and so do values that are not allowed."""
    out = df
    for name, default in defaults.items():
        value = first_filled(F.col(name)) if name in df.columns else F.lit(None).cast("string")
        if name in allowed:
            value = F.when(value.isin(*allowed[name]), value)
        out = out.withColumn(name, F.coalesce(value, F.lit(default)))
    return out


def shortened(df: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    return df.withColumns({c: F.substring(c, 1, n) for c, n in lengths.items()})


def encoded(df: DataFrame) -> DataFrame:
    """Binary fields as base64 text, however deep they lie."""

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.BinaryType):
            return F.base64(value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*(walk(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return value

    return df.select(*(walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))


def until_successes(rows: DataFrame, order: list[str], success: str, n: int) -> DataFrame:
    """The rows in order up to the n-th success; all, if there are fewer."""
    good = ranked_within(rows.where(F.col(success)).withColumn("__all", F.lit(1)), "__all", order, "__k")
    last = good.where(F.col("__k") == n).select(F.struct(*order).alias("__last"))
    return rows.join(F.broadcast(last.limit(1)), how="left").where(F.col("__last").isNull() | (F.struct(*order) <= F.col("__last"))).drop("__last")


def attempts(tried: DataFrame, valid: str, key: str = "sample_id", attempt: str = "attempt", max_retries: int = 2) -> DataFrame:
    """For each sample the first of its valid attempts, of which ``max_retries`` may follow the first one; adds ``tries``, those up to it.

    Samples without a valid attempt have no row; of rows of one attempt the least counts.
    """
    rest = [c for c in tried.columns if c not in (key, attempt)]
    good = tried.where((F.col(attempt) <= max_retries) & F.col(valid))
    first = good.groupBy(key).agg(F.min(F.struct(attempt, *rest)).alias("__b")).select(key, "__b.*")
    return first.select(*tried.columns, (F.col(attempt) + 1).alias("tries"))


def mini_batches(rows: DataFrame, key: str, size: int, epochs: int = 1, seed: int = 42, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """(epoch, batch, idx) for each row, in a seeded order of its own for every epoch, from a batch of an epoch on.

    Rows get their number by the key once; each epoch's order is a
    permutation of the numbers that is worked out row by row, so that no epoch
    sorts anything, and a run goes on from any batch.
    """
    numbered = with_index(rows, [key], "__number")
    n = rows.count()
    each = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(start[0]), F.lit(epochs - 1)))) if epochs > start[0] else numbered.withColumn("epoch", F.lit(0)).limit(0)
    place = F.lit(None).cast("long")
    for epoch in range(start[0], epochs):
        place = F.when(F.col("epoch") == epoch, permuted(F.col("__number"), n, seed + epoch)).otherwise(place)
    placed = each.withColumn("idx", place).withColumn("batch", F.floor(F.col("idx") / size)).drop("__number")
    return placed.where((F.col("epoch") > start[0]) | (F.col("batch") >= start[1]))


def shuffled_by_text(rows: DataFrame, text: str, n: int, seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, with their ``idx``, of the rows sorted by a text and then shuffled by the seed: the same ones however they lie."""
    numbered = with_index(rows, [text, *ties], "__number")
    return numbered.withColumn("idx", permuted(F.col("__number"), rows.count(), seed)).where(F.col("idx") < n).drop("__number")


def removed(table: DataFrame, key: Mapping[str, str]) -> DataFrame:
    """A small table without the rows of this key."""
    same = F.lit(True)
    for c, v in key.items():
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return table.where(~same)


def updated(table: DataFrame, key: Mapping[str, str], values: Mapping[str, object]) -> DataFrame:
    """A small table with new values in the rows of this key."""
    same = F.lit(True)
    for c, v in key.items():
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return table.withColumns({c: F.when(same, F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})
