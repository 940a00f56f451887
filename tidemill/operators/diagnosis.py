"""Diagnosis: accuracy by category, derived sampling weights, collected errors and priority reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.quota import ranked_within

# Below each accuracy (not at it) a category gets this weight.
WEIGHT_BANDS = ((0.70, 2.0), (0.75, 1.5), (0.85, 1.0), (0.90, 0.8))
TOP_WEIGHT = 0.5
# The report's bands, by accuracy below a limit.
REPORT_BANDS = ((0.70, "HIGH"), (0.85, "MEDIUM"))
LAST_BAND = "LOW"
OTHER = "mixed"
ERROR_CHARS = 200


def known_or_other(category: Column, known: Sequence[str], other: str = OTHER) -> Column:
    return F.when(category.isin(*known), category).otherwise(other)


def _by_limit(value: Column, bands, last) -> Column:
    out: Column | None = None
    for limit, name in bands:
        out = F.when(value < limit, F.lit(name)) if out is None else out.when(value < limit, F.lit(name))
    return out.otherwise(F.lit(last))


def accuracy(judged: DataFrame, category: str = "category", correct: str = "is_correct") -> DataFrame:
    """category, total, correct, accuracy and error_rate of the categories that occur."""
    right = F.coalesce(F.col(correct), F.lit(False)).cast("long")
    grouped = judged.groupBy(category).agg(F.count("*").alias("total"), F.sum(right).alias("correct"))
    share = F.col("correct") / F.col("total")
    return grouped.withColumn("accuracy", share).withColumn("error_rate", 1 - F.col("accuracy"))


def breakdown(judged: DataFrame, category: str, kind: str, correct: str = "is_correct") -> DataFrame:
    """Totals by category and by category and kind in one pass; ``kind`` is null in the former."""
    right = F.coalesce(F.col(correct), F.lit(False)).cast("long")
    sets = judged.groupingSets([[category], [category, kind]], category, kind)
    return sets.agg(F.count("*").alias("total"), F.sum(right).alias("correct"), F.grouping(kind).cast("int").alias("is_total")).withColumn("accuracy", F.col("correct") / F.col("total"))


def weights(stats: DataFrame, category: str = "category") -> DataFrame:
    """Adds raw_weight by accuracy and weight, its share of all."""
    raw = stats.withColumn("raw_weight", _by_limit(F.col("accuracy"), WEIGHT_BANDS, TOP_WEIGHT))
    everything = raw.agg(F.sum("raw_weight").alias("__all"))  # one row
    return raw.join(F.broadcast(everything)).withColumn("weight", F.try_divide("raw_weight", "__all")).drop("__all")


def summary(judged: DataFrame, correct: str = "is_correct") -> DataFrame:
    """One row: total, correct and accuracy, which is 0 without rows."""
    right = F.coalesce(F.sum(F.coalesce(F.col(correct), F.lit(False)).cast("long")), F.lit(0))
    return judged.agg(F.count("*").alias("total"), right.alias("correct")).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def with_weights(stats: DataFrame, table: DataFrame, category: str = "category", default: float = 1.0) -> DataFrame:
    """Looks weights up; categories without one get the default."""
    return stats.join(table.select(category, "weight"), category, "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def error_descriptions(judged: DataFrame, by: Sequence[str], text: str, limit: int = ERROR_CHARS, most: int | None = None) -> DataFrame:
    """(by, place, description): the wrong rows' descriptions, cut, a row for each in their order within the group; the first ones only on demand."""
    wrong = judged.where("not is_correct").select(F.struct(*by).alias("__g"), F.substring(text, 1, limit).alias("description"))
    ranked = ranked_within(wrong, "__g", ["description"], "place")
    return (ranked if most is None else ranked.where(F.col("place") <= most)).select(*(F.col("__g")[c].alias(c) for c in by), "place", "description")


def upsert_weaknesses(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(question_type, description, count, first_seen): one more for each time found.

    ``found`` has question_type, description, example_id and seen, their
    order; the first that is seen names the weakness. ``known`` is a table of
    this shape.
    """
    new = found.groupBy("question_type", "description").agg(F.count("*").alias("count"), F.min("seen").alias("first_seen"))
    if known is None:
        return new
    both = known.select(*new.columns).withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    return both.groupBy("question_type", "description").agg(F.sum("count").alias("count"), F.min_by("first_seen", "__o").alias("first_seen"))


def weakness_examples(found: DataFrame, keep: int | None = None) -> DataFrame:
    """(question_type, description, place, example_id): a row for each example of a weakness in the order seen; the first ones only on demand.

    Rows, as a list of all examples of a frequent weakness would not fit in one.
    """
    by = ["question_type", "description"]
    ranked = ranked_within(found.select(F.struct(*by).alias("__g"), "seen", "example_id"), "__g", ["seen", "example_id"], "place")
    return (ranked if keep is None else ranked.where(F.col("place") <= keep)).select(*(F.col("__g")[c].alias(c) for c in by), "place", "example_id")


def top_by_count(table: DataFrame, group: Sequence[str], k: int, at_least: int = 1, ties: Sequence[str] = ("first_seen",)) -> DataFrame:
    """The k rows of each group with the highest count; of equals the first seen."""
    place = Window.partitionBy(*group).orderBy(F.desc("count"), *ties)
    return table.where(F.col("count") >= at_least).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def weakness_summary(table: DataFrame, top: int = 3) -> DataFrame:
    """For each question type: kinds, all counts, and the top descriptions in order."""
    totals = table.groupBy("question_type").agg(F.count("*").alias("kinds"), F.sum("count").alias("occurrences"))
    best = top_by_count(table, ["question_type"], top).groupBy("question_type").agg(F.sort_array(F.collect_list(F.struct("rank", "description"))).alias("b"))
    return totals.join(best, "question_type").select("question_type", "kinds", "occurrences", F.transform("b", lambda x: x["description"]).alias("top"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` of ``whole`` in percent as text, rounded half up from whole numbers."""
    scale = 10**digits
    n = F.floor((part.cast("long") * 200 * scale + whole.cast("long")) / (whole.cast("long") * 2)).cast("long")
    return F.concat(F.floor(n / scale).cast("long").cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"), F.lit("%"))


def priority_lines(stats: DataFrame, category: str = "category") -> DataFrame:
    """band, place within the band by accuracy, and a line of text for each category."""
    band = _by_limit(F.col("accuracy"), REPORT_BANDS, LAST_BAND)
    place = F.row_number().over(Window.partitionBy("band").orderBy("accuracy", category))
    line = F.concat(F.lit("- "), F.col(category), F.lit(": "), percent(F.col("correct"), F.col("total")), F.lit(" ("), F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"))
    return stats.withColumn("band", band).withColumn("place", place).select("band", F.col("place").cast("long").alias("place"), category, line.alias("line"))


def weakness_prompt(table: DataFrame, k: int = 5, at_least: int = 2) -> DataFrame:
    """A prompt text for each question type, from its most frequent weaknesses."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("description"), F.lit(" (seen "), F.col("count").cast("string"), F.lit(" times)"))
    best = top_by_count(table, ["question_type"], k, at_least).select("question_type", "rank", line.alias("line"))
    lines = best.groupBy("question_type").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return lines.select("question_type", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"))
