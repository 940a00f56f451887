"""Clipped policy and value losses, entropy, and the adaptive coefficient of the divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def masked_mean(values: Column, mask: Column) -> Column:
    """Of all rows' tokens, as an aggregate."""
    return F.sum(_sum(F.zip_with(values, mask, lambda v, m: v * m))) / (F.sum(_sum(F.transform(mask, lambda m: m.cast("double")))) + EPS)


def policy_loss(rows: DataFrame, old: str, new: str, advantages: str, mask: str, clip_low: float = 0.2, clip_high: float = 0.2, clip_dual: float = 3.0) -> DataFrame:
    """One row: loss, share of clipped tokens above and below, and the mean divergence from the old policy."""
    gap = F.zip_with(F.col(new), F.col(old), lambda n, o: n - o)
    parts = F.zip_with(gap, F.col(advantages), lambda d, a: F.struct(F.exp(d).alias("r"), a.alias("a")))

    def token(x: Column) -> Column:
        plain, cut = -x["a"] * x["r"], -x["a"] * F.greatest(F.lit(1 - clip_low), F.least(F.lit(1 + clip_high), x["r"]))
        worst, dual = F.greatest(plain, cut), -x["a"] * clip_dual
        return F.struct(
            F.when(x["a"] < 0, F.least(worst, dual)).otherwise(worst).alias("loss"),
            F.when(cut > plain, 1.0).otherwise(0.0).alias("high"),
            F.when((worst > dual) & (x["a"] < 0), 1.0).otherwise(0.0).alias("low"),
        )

    prepared = rows.select(F.transform(parts, token).alias("t"), F.col(mask).alias("m"), F.transform(gap, lambda d: -d).alias("kl"))
    part = lambda n: F.transform("t", lambda x: x[n])
    return prepared.agg(masked_mean(part("loss"), F.col("m")).alias("loss"), masked_mean(part("high"), F.col("m")).alias("clip_high"), masked_mean(part("low"), F.col("m")).alias("clip_low"), masked_mean(F.col("kl"), F.col("m")).alias("kl"))


def value_loss(rows: DataFrame, predicted: str, old: str, returns: str, mask: str, clip: float = 0.5) -> DataFrame:
    """One row: half the mean of the larger squared error, plain or of the clipped value, and the share where clipping counts."""
    pairs = F.zip_with(F.col(predicted), F.col(old), lambda p, o: F.struct(p.alias("p"), F.greatest(o - clip, F.least(o + clip, p)).alias("c")))
    errors = F.zip_with(pairs, F.col(returns), lambda x, r: F.struct(((x["p"] - r) * (x["p"] - r)).alias("plain"), ((x["c"] - r) * (x["c"] - r)).alias("cut")))
    prepared = rows.select(errors.alias("e"), F.col(mask).alias("m"))
    worse = F.transform("e", lambda x: F.greatest(x["plain"], x["cut"]))
    clipped = F.transform("e", lambda x: F.when(x["cut"] > x["plain"], 1.0).otherwise(0.0))
    return prepared.agg((0.5 * masked_mean(worse, F.col("m"))).alias("loss"), masked_mean(clipped, F.col("m")).alias("clipped"))


def entropy(rows: DataFrame, log_p: str, mask: str) -> DataFrame:
    return rows.agg((-masked_mean(F.col(log_p), F.col(mask))).alias("entropy"))


def next_coefficient(coefficient: float, kl: float, target: float, n: int, horizon: float) -> float:
    error = max(-0.2, min(0.2, kl / target - 1))
    return coefficient * (1 + error * n / horizon)


def coefficients(steps: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """(step, coefficient) after each step's kl and n: a running product, as sums of logarithms.

    Steps are one row each; a training run has thousands of them, whatever its data.
    """
    from pyspark.sql import Window

    error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("kl") / target - 1))
    running = F.sum(F.log(1 + error * F.col("n") / horizon)).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("step", (start * F.exp(running)).alias("coefficient"))


def warmup_factor(step: Column, steps: int) -> Column:
    return F.least(F.lit(1.0), step / max(1, steps))
