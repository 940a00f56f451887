"""Batch algebra: unions by key, repetition, padding, chunks, permutations, collation and resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.quota import ranked_within


def with_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """0, 1, ... by the order, whose first column is a number or a time, without a task that sees all rows."""
    return ranked_within(df.withColumn("__one", F.lit(1)), "__one", list(order), name).withColumn(name, F.col(name) - 1).drop("__one")


def sliced(df: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None, index: str = "idx") -> DataFrame:
    """The rows that a slice of the index takes, numbered anew in its order; negative numbers count from the end."""
    n = df.count()
    first, last, step = slice(start, stop, step).indices(n)
    place = (F.col(index) - first) / step
    taken = len(range(first, last, step))
    return df.where((place == F.floor(place)) & place.between(0, taken - 1)).withColumn(index, F.call_function("div", F.col(index) - first, F.lit(step)))


def item(df: DataFrame, at: int, index: str = "idx") -> DataFrame:
    """One row by its index, from the end if that is negative; an error beyond the rows."""
    n = df.count()
    if not -n <= at < n:
        raise IndexError(f"row {at} of {n}")
    return df.where(F.col(index) == at % n)


def select_and_rest(df: DataFrame, columns: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The columns taken out, and what is left; both keep the key."""
    taken = [c for c in columns if c != key]
    return df.select(key, *taken), df.drop(*taken)


def rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def column_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of both by key. A shared column must be equal in both, else the query fails."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    both = left.join(right.withColumnsRenamed({c: f"__r_{c}" for c in shared}), key)
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        both = both.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs")).cast(left.schema[c].dataType)))
    return both.drop(*(f"__r_{c}" for c in shared))


def repeat(df: DataFrame, n: int, index: str = "idx", interleave: bool = True, size: Column | None = None) -> DataFrame:
    """n copies of each row with ``copy`` and ``position``: aabb if interleaved, else abab, for which the number of rows is needed."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return copies.withColumn("position", F.col(index) * n + F.col("copy"))
    rows = F.lit(df.count()) if size is None else size
    return copies.withColumn("position", F.col("copy") * rows + F.col(index))


def pad_to_divisor(df: DataFrame, divisor: int, index: str = "idx") -> DataFrame:
    """Rows from the start again until the divisor goes into their number; adds is_pad."""
    n = df.count()
    missing = -n % divisor if n else 0
    base = df.withColumn("is_pad", F.lit(False))
    if not missing:
        return base
    # a row comes again for each multiple of n that its index fits in
    again = df.where(F.col(index) < missing).withColumn("__k", F.explode(F.sequence(F.lit(0), F.floor((F.lit(missing) - 1 - F.col(index)) / n).cast("int"))))
    return base.unionByName(again.withColumn(index, F.col(index) + n * (F.col("__k") + 1)).drop("__k").withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.where("not is_pad").drop("is_pad")


def equal_chunk(index: Column, n: int, chunks: int) -> Column:
    if n % chunks:
        raise ValueError(f"{n} rows can't be cut into {chunks} equal chunks")
    return F.floor(index / (n // chunks))


def ceil_chunk(index: Column, n: int, chunks: int) -> Column:
    """Chunks of the same size, rounded up; the last may be short."""
    return F.floor(index / -(-n // chunks))


def near_equal_chunk(index: Column, n: int, chunks: int) -> Column:
    """Sizes differ by one at most, the longer ones first."""
    size, more = divmod(n, chunks)
    border = more * (size + 1)
    return F.when(index < border, F.floor(index / (size + 1))).otherwise(more + F.floor((index - border) / max(size, 1)))


def reorder(df: DataFrame, permutation: DataFrame, index: str = "idx") -> DataFrame:
    """Rows under their new index; ``permutation`` has the old index of each new one."""
    return df.join(permutation, df[index] == permutation["old_idx"]).drop(index, "old_idx").withColumnRenamed("new_idx", index)


def inverse(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("old_idx").alias("new_idx"), F.col("new_idx").alias("old_idx"))


def without_processed(df: DataFrame, *processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in none of the tables of what is done."""
    done = processed[0].select(key)
    for more in processed[1:]:
        done = done.union(more.select(key))
    return df.join(done.distinct(), key, "left_anti")


def batches(df: DataFrame, size: int, index: str = "idx", drop_last: bool = True) -> DataFrame:
    """Adds ``batch``; a short last one goes on demand. -1 makes one batch of all."""
    if size == -1:
        return df.withColumn("batch", F.lit(0).cast("long"))
    numbered = df.withColumn("batch", F.floor(F.col(index) / size))
    if not drop_last:
        return numbered
    full = df.count() // size
    return numbered.where(F.col("batch") < full)


def collate(df: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """A row for each group, with the columns as lists in order."""
    rows = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("__r"))
    part = lambda c: F.transform("__r", lambda x: x[c]).alias(c)
    return rows.select(group, *map(part, columns))


def members(df: DataFrame, group: str, order: Sequence[str], name: str = "place") -> DataFrame:
    """The rows of each group with their place in it, from 0: what ``collate`` gathers, as rows, for groups too large for one list."""
    return ranked_within(df, group, list(order), name).withColumn(name, F.col(name) - 1)


def fold(df: DataFrame, width: int, index: str, *columns: str) -> DataFrame:
    """Groups of ``width`` neighbours as lists."""
    return collate(df.withColumn("fold", F.floor(F.col(index) / width)), "fold", index, *columns)


def group_ids(df: DataFrame, *key: str, name: str = "uid") -> DataFrame:
    """An id for each prompt, the same in every run: of its key, and before rows are repeated."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256))


def unflatten_columns(df: DataFrame, separator: str = "/") -> DataFrame:
    """Columns named by paths as nested fields, in the order that they come in."""
    tree: dict = {}
    for c in df.columns:
        *path, last = c.split(separator)
        at = tree
        for name in path:
            at = at.setdefault(name, {})
        at[last] = c

    def walk(name: str, node) -> Column:
        return (F.col(f"`{node}`") if isinstance(node, str) else F.struct(*(walk(n, x) for n, x in node.items()))).alias(name)

    return df.select(*(walk(n, x) for n, x in tree.items()))


def flatten_columns(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested fields as columns named by their path."""
    from pyspark.sql import types as T

    def walk(schema, path):
        for f in schema.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, at)
            else:
                column = F.col(at[0])
                for name in at[1:]:
                    column = column[name]
                yield column.alias(separator.join(at))

    return df.select(*walk(df.schema, []))
