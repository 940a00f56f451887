"""Quotas: allocation from weights, progress, admission in arrival order, gaps, and variants that fill them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLEXIBLE = "__flexible__"


def allocate(weights: DataFrame, total: int, category: str = "category") -> DataFrame:
    """category, weight and quota, cut to whole numbers; what is left over is one more row, the flexible pool.

    Categories with nothing have no row; with no weight at all there are no
    rows, and quotas are off.
    """
    everything = weights.agg(F.sum("weight").alias("__all"))
    shares = weights.join(F.broadcast(everything)).where("__all > 0")
    quota = F.floor(F.lit(total) * F.col("weight") / F.col("__all")).cast("long")
    typed = shares.select(category, "weight", quota.alias("quota")).where("quota > 0")
    pool = shares.agg(F.count("*").alias("n"), F.coalesce(F.sum(quota), F.lit(0)).alias("q")).where("n > 0").select(F.lit(FLEXIBLE).alias(category), F.lit(None).cast("double").alias("weight"), (F.lit(total) - F.col("q")).cast("long").alias("quota"))
    return typed.unionByName(pool)


def progress(quotas: DataFrame, counts: DataFrame, category: str = "category") -> DataFrame:
    """Quota, current count, what remains and the percentage of each typed quota."""
    joined = quotas.where(F.col(category) != FLEXIBLE).join(counts.select(category, F.col("count").alias("current")), category, "left")
    current = F.coalesce("current", F.lit(0)).cast("long")
    return joined.select(category, "quota", current.alias("current"), F.greatest(F.col("quota") - current, F.lit(0)).cast("long").alias("remaining"), (current * 100.0 / F.col("quota")).alias("percentage"))


def admit(arrivals: DataFrame, quotas: DataFrame, order: list[str], category: str = "category") -> DataFrame:
    """Adds arrival_rank and admitted: within its quota, or, for a category without one, within the flexible pool.

    Ranks are worked out in two steps, so that a category with a large part
    of the rows is not sorted in one task.
    """
    typed = quotas.where(F.col(category) != FLEXIBLE).select(category, "quota")
    pool = quotas.where(F.col(category) == FLEXIBLE).select(F.col("quota").alias("__pool"))
    known = arrivals.join(typed, category, "left").join(F.broadcast(pool.agg(F.max("__pool").alias("__pool"))))
    line = F.when(F.col("quota").isNotNull(), F.col(category)).otherwise(FLEXIBLE)
    ranked = ranked_within(known.withColumn("__line", line), "__line", order, "arrival_rank")
    limit = F.coalesce("quota", "__pool", F.lit(0))
    return ranked.withColumn("admitted", F.col("arrival_rank") <= limit).drop("quota", "__pool", "__line")


#: Rows in a range, about, and rows looked at for each border between ranges.
RANGE_ROWS, LOOKED_AT = 200_000, 20


def _free(taken: list[str], *names: str) -> list[str]:
    """The names, with as many underscores ahead as it takes for none to be taken."""
    ahead, low = "__", {c.lower() for c in taken}
    while any(f"{ahead}{n}" in low for n in names):
        ahead += "_"
    return [f"{ahead}{n}" for n in names]


def _range_of(rows: DataFrame, order: list[str], n: int, total: int, part: str, held: str) -> DataFrame | None:
    """Adds ``part``, the number of the range, of ``n``, that a row's place in the order lies in; None without a border. Neither ``part`` nor ``held`` is a column of the rows.

    Borders over all order columns come from a sample, some twenty rows for
    each, and are constants from then on. They are searched in two steps.
    """
    row = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(order)))
    sample = rows.select(row.alias("r")).sample(min(1.0, LOOKED_AT * n / total), seed=42)
    looked = sample.agg(F.sort_array(F.collect_list("r")).alias("r")).first().r
    borders = [looked[len(looked) * k // n] for k in range(1, n)] if looked else []
    if not borders:
        return None
    kind = T.StructType([T.StructField(held, T.ArrayType(T.StructType([T.StructField(f"c{k}", rows.schema[c].dataType) for k, c in enumerate(order)])))])
    one = F.broadcast(rows.sparkSession.createDataFrame([(borders,)], kind))
    wide = math.isqrt(len(borders) - 1) + 1
    below = lambda some: F.size(F.filter(some, lambda b: b < row))
    blocks = F.transform(F.sequence(F.lit(1), F.lit(len(borders)), F.lit(wide)), lambda at: F.get(F.col(held), at - 1))
    with_block = rows.join(one).withColumn(part, below(blocks))
    fine = below(F.slice(held, F.greatest((F.col(part) - 1) * wide + 1, F.lit(1)), F.lit(wide)))
    return with_block.withColumn(part, F.when(F.col(part) == 0, 0).otherwise((F.col(part) - 1) * wide + fine)).drop(held)


def ranked_within(rows: DataFrame, group: str, order: list[str], name: str, range_rows: int | None = None) -> DataFrame:
    """1, 2, ... within each group by the order, without gathering a group: counts of its earlier ranges plus the place in its own.

    There are as many ranges, over all rows, as their number asks for. Rows
    without a group are one; rows equal in all order columns share a range.
    Columns of any name come through.
    """
    total, range_rows = rows.count(), range_rows or RANGE_ROWS
    part, held, g, p, n, before = _free([*rows.columns, name], "part", "held", "g", "p", "n", "before")
    parted = _range_of(rows, order, -(-total // range_rows), total, part, held) if total > range_rows else None
    if parted is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    sizes = parted.groupBy(F.col(group).alias(g), F.col(part).alias(p)).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(g).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(g, p, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    joined = parted.join(ahead, F.col(group).eqNullSafe(F.col(g)) & (F.col(part) == F.col(p)))
    place = F.row_number().over(Window.partitionBy(group, part).orderBy(*order))
    return joined.withColumn(name, (F.col(before) + place).cast("long")).drop(part, before, g, p)


def is_complete(progress_rows: DataFrame, flexible_quota: int, flexible_used: int) -> bool:
    """Only when every typed quota and the flexible pool are full."""
    return flexible_used >= flexible_quota and progress_rows.where("remaining > 0").limit(1).count() == 0


def gaps(quotas: DataFrame, counts: DataFrame, category: str = "category") -> DataFrame:
    """Categories that lack rows, and how many."""
    return progress(quotas, counts, category).select(category, F.col("remaining").alias("gap")).where("gap > 0")


def variants(gap: DataFrame, sources: DataFrame, category: str = "category", source: str = "source_id") -> DataFrame:
    """A row for each one to make: category, source, variant_index (from 0) and total_variants of the source.

    With n sources each gets gap div n, the first gap mod n one more; without
    sources the gap is filled by rows without one.
    """
    known = sources.select(F.col(category).alias("__c"), source).where(F.col(source).isNotNull()).join(gap.select(F.col(category).alias("__c")), "__c", "left_semi")
    counts = known.groupBy("__c").agg(F.count("*").alias("__n"))
    joined = gap.join(counts, F.col(category) == F.col("__c"), "left").drop("__c").withColumn("__n", F.coalesce("__n", F.lit(0)))
    none = joined.where("__n = 0").select(category, F.lit(None).cast(sources.schema[source].dataType).alias(source), F.col("gap").alias("total_variants"))
    ranked = ranked_within(known, "__c", [source], "__r").join(joined.where("__n > 0"), F.col("__c") == F.col(category))
    share = (F.floor(F.col("gap") / F.nullif("__n", F.lit(0))) + F.when(F.col("__r") <= F.col("gap") % F.nullif("__n", F.lit(0)), 1).otherwise(0)).cast("long")
    counted = none.unionByName(ranked.select(category, source, share.alias("total_variants"))).where("total_variants > 0")
    return counted.select(category, source, F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_variants") - 1)).alias("variant_index"), "total_variants")


def expected_and_actual(weights: DataFrame, counts: DataFrame, total: int, category: str = "category") -> DataFrame:
    """Expected rows from the weights beside those that are there, for categories of either."""
    joined = weights.select(category, "weight").join(counts.select(category, "count"), category, "full_outer")
    expected = F.coalesce(F.floor(F.col("weight") * total), F.lit(0)).cast("long")
    actual = F.coalesce("count", F.lit(0)).cast("long")
    return joined.select(category, expected.alias("expected"), actual.alias("actual"), (actual - expected).alias("diff"))


def changed_quotas(old: DataFrame, new: DataFrame, category: str = "category") -> DataFrame:
    """Categories whose quota differs, with null where there was or is none."""
    joined = old.select(category, F.col("quota").alias("old_quota")).join(new.select(category, F.col("quota").alias("new_quota")), category, "full_outer")
    return joined.where(~F.col("old_quota").eqNullSafe(F.col("new_quota")))


def snapshot(quotas: DataFrame, counts: DataFrame, category: str = "category") -> DataFrame:
    """(category, quota, count): the state to write down, with the flexible pool's row and its use."""
    joined = quotas.select(category, "quota").join(counts.select(category, "count"), category, "full_outer")
    return joined.select(category, "quota", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def restore(state: DataFrame, quotas: DataFrame, category: str = "category") -> tuple[DataFrame, DataFrame]:
    """The state under new quotas, with the counts of the old one, and the changes to warn of."""
    counts = state.select(category, "count")
    typed = lambda q: q.where(F.col("quota").isNotNull() & (F.col(category) != FLEXIBLE))
    return snapshot(quotas, counts, category), changed_quotas(typed(state), typed(quotas), category)
