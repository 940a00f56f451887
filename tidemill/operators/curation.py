"""Curation: score bands, filling up to a target, score summaries and frequency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators.quota import ranked_within
from tidemill.operators.selection import first_by_hash

UNSCORED = 1.0


def with_score(df: DataFrame, score: str = "score", default: float = UNSCORED, overwrite: bool = False) -> DataFrame:
    return df.withColumn(score, F.lit(default) if overwrite else F.coalesce(F.col(score), F.lit(default)))


def needs_score(score: Column) -> Column:
    """No score, or the sign for none."""
    return score.isNull() | (score == UNSCORED)


def valid_answers(df: DataFrame, answer: str = "answer", image: str = "image") -> DataFrame:
    """Rows with an answer and an image, which may be empty."""
    return df.where(~X.missing(F.col(answer)) & F.col(image).isNotNull())


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    out = df
    for c in columns:
        out = out.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return out


def without_errors(df: DataFrame, error: str = "generation_error") -> DataFrame:
    """Rows whose generation did not fail; no sign of an error is none."""
    return df.where(~F.coalesce(F.col(error), F.lit(False)))


def short_enough(prompts: DataFrame, ids: str, most: int) -> DataFrame:
    """Prompts whose ids are no more than allowed; without ids a prompt has length 0."""
    return prompts.where(F.coalesce(F.size(ids), F.lit(0)) <= most)


def with_files(df: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """Rows whose file is in the listing, which has a ``path`` for each."""
    there = listing.select(F.col("path").alias(path)).where("path is not null" if path == "path" else F.col(path).isNotNull()).distinct()
    return df.join(there, path, "left_semi")


def in_band(score: Column, low: float = 0.3, high: float = 0.8) -> Column:
    return score.between(low, high)


def train_rows(df: DataFrame) -> DataFrame:
    """The training set's columns out of scored questions."""
    return df.select(F.col("question").alias("problem"), "answer", F.col("score").cast("double").alias("score"), F.col("image").alias("images"), F.col("question_type").alias("problem_type"), "image_type")


def fill_up(df: DataFrame, passed: Column, target: int, key: list[str], seed: int = 42) -> DataFrame:
    """The passed rows and, if they are fewer than the target, excluded ones by a seeded order; adds ``filled``.

    Never cuts passed rows. The order is that of md5(seed, key), the key last.
    """
    flagged = df.withColumn("__ok", F.coalesce(passed, F.lit(False)))
    need = max(0, target - flagged.where("__ok").count())
    kept = flagged.where("__ok").withColumn("filled", F.lit(False))
    if need == 0:
        return kept.drop("__ok")
    more = first_by_hash(flagged.where("not __ok"), need, seed, key).withColumn("filled", F.lit(True))
    return kept.unionByName(more).drop("__ok")


def score_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """One row: number, mean, extremes, buckets at 0.8 and 0.5 and the high ones' share."""
    s = F.col(score)
    row = df.agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.max(s).alias("max"), F.min(s).alias("min"), F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.5) & (s < 0.8)).alias("medium"), F.count_if(s < 0.5).alias("low"))
    return row.withColumn("high_share", F.coalesce(F.try_divide("high", "n"), F.lit(0.0)))


def histogram(df: DataFrame, value: str, bins: int = 11) -> DataFrame:
    """bin (from 1), its lower end and count, over equal bins from the lowest to the highest value, which falls in the last."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("lo"), width), F.lit(0.0))) + 1).cast("long")
    placed = df.where(F.col(value).isNotNull()).join(F.broadcast(ends))
    return placed.groupBy(place.alias("bin"), (F.col("lo") + (place - 1) * width).alias("from")).agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, median, max and min. The median comes from the ranks, so that no task holds all values."""
    row = df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.count(value).alias("__n"))
    ranked = ranked_within(df.where(F.col(value).isNotNull()).select(F.lit(1).alias("__one"), F.col(value).cast("double").alias("__v")), "__one", ["__v"], "__r")
    middle = ranked.join(F.broadcast(row.select("__n"))).where(F.col("__r").isin(F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1))
    return row.join(F.broadcast(middle.agg(F.avg("__v").alias("median")))).select("mean", "median", "max", "min")


def distribution(df: DataFrame, category: str) -> DataFrame:
    """count and percent (two digits) of each value."""
    counts = df.groupBy(category).agg(F.count("*").alias("count"))
    everything = counts.agg(F.sum("count").alias("__all"))
    return counts.join(F.broadcast(everything)).select(category, "count", F.round(F.col("count") * 100.0 / F.col("__all"), 2).alias("percent"))
