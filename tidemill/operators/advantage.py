"""Advantages relative to a group, and whitening over a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import arrays as A

EPS = 1e-6
WHITEN_EPS = 1e-8


def _with_group(rows: DataFrame, group: str, **aggregates: Column) -> DataFrame:
    """A group's aggregates beside its rows: summed up ahead of the shuffle, so that a large group is not gathered.

    Rows without a group are a group of their own.
    """
    sums = rows.groupBy(F.col(group).alias("__g")).agg(*(c.alias(f"__{n}") for n, c in aggregates.items()))
    return rows.join(sums, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def _needs_more_than_one(n: Column, value: Column) -> Column:
    return F.when(n > 1, value).otherwise(F.raise_error(F.lit("a group has one member only")).cast("double"))


def grpo(rows: DataFrame, group: str = "uid", score: str = "score", eps: float = EPS) -> DataFrame:
    """(score - mean) / (sample deviation + eps) within the group, which must have more than one member."""
    joined = _with_group(rows, group, n=F.count(score), mean=F.avg(score), sd=F.stddev_samp(score))
    return joined.withColumn("advantage", _needs_more_than_one(F.col("__n"), (F.col(score) - F.col("__mean")) / (F.col("__sd") + eps))).drop("__n", "__mean", "__sd")


def rloo(rows: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """The score less the mean of the others in the group."""
    joined = _with_group(rows, group, n=F.count(score), sum=F.sum(score))
    others = (F.col("__sum") - F.col(score)) / F.nullif(F.col("__n") - 1, F.lit(0))
    return joined.withColumn("advantage", _needs_more_than_one(F.col("__n"), F.col(score) - others)).drop("__n", "__sum")


def remax(rows: DataFrame, baselines: DataFrame, key: str = "uid", score: str = "score", baseline: str = "baseline") -> DataFrame:
    one = baselines.select(F.col(key).alias("__g"), baseline)
    return rows.join(one, F.col(key).eqNullSafe(F.col("__g"))).drop("__g").withColumn("advantage", F.col(score) - F.col(baseline))


def over_tokens(advantage: Column, mask: Column) -> Column:
    """A row's advantage at each of its tokens, 0 where the mask is."""
    return F.transform(mask, lambda m: advantage * m)


def masked_moments(rows: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: mean and Bessel-corrected variance of the masked tokens of all rows, and their number.

    The sums are taken around each row's values in arrays; nothing is exploded.
    """
    v, m = F.col(values), F.col(mask)
    count = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(F.zip_with(v, m, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    center = rows.agg((F.sum(total) / (F.sum(count) + WHITEN_EPS)).alias("__center"))
    off = F.aggregate(F.zip_with(v, m, lambda x, w: (x - F.col("__center")) * (x - F.col("__center")) * w), F.lit(0.0), lambda a, x: a + x)
    spread = rows.join(F.broadcast(center)).agg(F.first("__center").alias("mean"), F.sum(count).alias("n"), (F.sum(off) / (F.sum(count) + WHITEN_EPS)).alias("biased"))
    # of one token alone the variance stays as it is
    corrected = F.when(F.col("n") > 1, F.col("biased") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0.0))).otherwise(F.col("biased"))
    return spread.select("mean", corrected.alias("var"), "n")


def whiten(rows: DataFrame, values: str, mask: str, out: str = "whitened") -> DataFrame:
    """Masked values less their mean, by their deviation over the whole batch."""
    moments = masked_moments(rows, values, mask).select(F.col("mean").alias("__mean"), F.col("var").alias("__var"))
    scaled = F.zip_with(values, mask, lambda x, w: (x - F.col("__mean")) / F.sqrt(F.col("__var") + WHITEN_EPS) * w)
    return rows.join(F.broadcast(moments)).withColumn(out, scaled).drop("__mean", "__var")


def gae(rows: DataFrame, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """Adds returns, the estimates with the values, and advantages, the estimates whitened over the batch's masked tokens."""
    estimated = rows.withColumn("__a", A.gae_advantages(F.col(rewards), F.col(values), gamma, lam))
    returned = estimated.withColumn("returns", F.zip_with("__a", values, lambda a, v: a + v))
    return whiten(returned, "__a", mask, "advantages").drop("__a")


def reinforce_plus_plus(rows: DataFrame, rewards: str, mask: str, gamma: float) -> DataFrame:
    """Adds returns, the discounted rewards to go, and advantages, these whitened over the batch's masked tokens."""
    returned = rows.withColumn("returns", A.discounted_returns(F.col(rewards), F.col(mask), gamma))
    return whiten(returned, "returns", mask, "advantages")
