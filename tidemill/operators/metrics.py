"""Metrics of a training step from its batch, of time, throughput and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.quota import ranked_within

# Peak operations a second by device.
PEAK_FLOPS = {"H100": 989e12, "H800": 989e12, "A100": 312e12, "A800": 312e12, "L40": 181.05e12, "L20": 119.5e12, "H20": 148e12, "910B": 354e12}
UNITS = {"B": 1e9, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _three(name: str, value: Column) -> list[Column]:
    return [F.avg(value).alias(f"{name}_mean"), F.max(value).alias(f"{name}_max"), F.min(value).alias(f"{name}_min")]


def batch_metrics(rows: DataFrame, scores: str, advantages: str, returns: str, mask: str, values: str | None = None, max_length: int | None = None) -> DataFrame:
    """One row: scores summed over tokens; advantages and returns of valid tokens; response lengths; explained variance with values."""
    m = F.col(mask)
    length = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    valid = lambda c: F.filter(F.zip_with(F.col(c), m, lambda v, w: F.when(w > 0, v)), lambda v: v.isNotNull())
    prepared = rows.select(
        _sum(F.col(scores)).alias("score"), length.alias("length"), *(f(valid(c)).alias(f"{n}_{k}") for n, c in (("advantage", advantages), ("return", returns)) for k, f in (("sum", _sum), ("max", F.array_max), ("min", F.array_min))),
        *([_sum(F.zip_with(F.zip_with(F.col(returns), F.col(values), lambda r, v: r - v), m, lambda d, w: d * w)).alias("d1"), _sum(F.zip_with(F.zip_with(F.col(returns), F.col(values), lambda r, v: r - v), m, lambda d, w: d * d * w)).alias("d2"), _sum(F.zip_with(F.col(returns), m, lambda r, w: r * r * w)).alias("r2")] if values else []),
    )
    tokens = F.sum("length")
    out = [*_three("score", F.col("score"))]
    for n in ("advantage", "return"):
        out += [(F.sum(f"{n}_sum") / tokens).alias(f"{n}_mean"), F.max(f"{n}_max").alias(f"{n}_max"), F.min(f"{n}_min").alias(f"{n}_min")]
    out += _three("length", F.col("length"))
    if max_length is not None:
        out.append(F.avg(F.when(F.col("length") >= max_length, 1.0).otherwise(0.0)).alias("length_clip_ratio"))
    if values:
        spread = lambda s, q: (F.sum(q) - F.sum(s) * F.sum(s) / tokens) / F.nullif(tokens - 1, F.lit(0.0))
        out.append((1 - spread("d1", "d2") / (spread("return_sum", "r2") + 1e-5)).alias("explained_variance"))
    return prepared.agg(*out)


def timing(sections: DataFrame, tokens: DataFrame) -> DataFrame:
    """(name, seconds, ms_per_token) where tokens of the section are known, else null."""
    return sections.join(tokens, "name", "left").select("name", "seconds", F.try_divide(F.col("seconds") * 1000, "tokens").alias("ms_per_token"))


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return tokens / (seconds * devices)


def flops(lengths: DataFrame, length: str, parameters: float, layers: int, heads: int, head_size: int) -> DataFrame:
    """One row: tokens, sum of squares, and the operations of forward and backward passes."""
    n, squares = F.sum(F.col(length).cast("double")), F.sum(F.col(length).cast("double") * F.col(length))
    return lengths.agg(n.alias("tokens"), squares.alias("squares"), (6.0 * parameters * n + 12.0 * squares * head_size * heads * layers).alias("flops"))


def utilisation(flops_done: float, seconds: float, devices: int, device: str) -> float:
    return flops_done / seconds / devices / PEAK_FLOPS[device]


def balance(rows: DataFrame, partition: str, length: str) -> DataFrame:
    """One row: lowest, highest and mean load of the partitions."""
    loads = rows.groupBy(partition).agg(F.sum(length).alias("load"))
    return loads.agg(F.min("load").alias("min"), F.max("load").alias("max"), F.avg("load").alias("mean"))


def sequence_kl(rows: DataFrame, kl: str, mask: str) -> DataFrame:
    """Mean over sequences of the mean over their tokens."""
    m = F.col(mask)
    each = _sum(F.zip_with(F.col(kl), m, lambda k, w: k * w)) / (F.aggregate(m, F.lit(0.0), lambda a, x: a + x) + 1e-8)
    return rows.agg(F.avg(each).alias("kl"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """(name, value): lists of values become their means."""
    return metrics.groupBy("name").agg(F.avg("value").alias("value"))


def appended(metrics: DataFrame, more: DataFrame) -> DataFrame:
    """(name, place, value): the values of list-valued metrics with one more for each row of ``more`` (name, value), after those that are there; its rows of one name come in the order of their value."""
    ends = metrics.groupBy("name").agg((F.max("place") + 1).alias("__end"))
    ranked = ranked_within(more.select("name", "value"), "name", ["value"], "__k")
    added = ranked.join(ends, "name", "left").select("name", (F.coalesce("__end", F.lit(0)) + F.col("__k") - 1).alias("place"), "value")
    return metrics.select("name", "place", "value").unionByName(added)


def metric_lists(metrics: DataFrame) -> DataFrame:
    """(name, values): the lists themselves, a number for each step."""
    return metrics.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))


def run_statistics(log: DataFrame) -> DataFrame:
    """One row over a log: rows, successes and their percentage."""
    ok = F.count_if(F.col("_meta.success"))
    return log.agg(F.count("*").alias("n"), ok.alias("succeeded"), (F.count("*") - ok).alias("failed"), F.try_divide(ok * 100.0, F.count("*")).alias("percent"))


def pace(statistics: DataFrame, elapsed: float) -> DataFrame:
    """Adds seconds for a success and the seconds that what has failed would still take at that pace; 0 without a success."""
    each = F.coalesce(F.try_divide(F.lit(float(elapsed)), "succeeded"), F.lit(0.0))
    return statistics.withColumn("seconds_each", each).withColumn("seconds_left", each * F.col("failed"))
