"""Votes over candidate answers: exact in SQL, with equivalence classes as a fold in candidate order."""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}\b)")


def boxed_balanced(text: str | None) -> str | None:
    """The content of the last box, whose braces may nest."""
    at = -1 if text is None else text.rfind("\\boxed{")
    if at < 0:
        return None
    depth, start = 0, at + len("\\boxed")
    for k in range(start, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if depth == 0:
            return text[start + 1 : k]
    return None


@F.pandas_udf(T.StringType())
def boxed(texts: pd.Series) -> pd.Series:
    """The content of the last box as a column."""
    return texts.map(boxed_balanced)


def plain_answer(text: str) -> str:
    text = re.sub(r"\\text\{([^}]*)\}", r"\1", text.strip().strip("$"))
    return " ".join(text.split()).rstrip(".%").strip().lower()


#: Longer texts, and larger exponents, are no numbers to a comparison, which ends soon whatever the answer.
MAX_DIGITS = 1_000
_EXPONENT = re.compile(r"[eE][+-]?0*(\d{4,})$")


def number(text: str) -> Fraction | None:
    if len(text) > MAX_DIGITS or _EXPONENT.search(text.strip()):
        return None
    text = _THOUSANDS.sub("", text)
    m = re.fullmatch(r"\\?d?frac\{(-?\d+)\}\{(\d+)\}", text)
    try:
        return Fraction(int(m[1]), int(m[2])) if m else Fraction(text)
    except (ValueError, ZeroDivisionError):
        return None


def same_answer(a: str, b: str) -> bool:
    """Our own rule: equal as plain text or as numbers, or both a denial."""
    if a == b or ("no " in a.lower() and "no " in b.lower()):
        return True
    a, b = plain_answer(a), plain_answer(b)
    x, y = number(a), number(b)
    return a == b or (x is not None and x == y)


def majority(candidates: DataFrame, question: str, answer: str, order: list[str], denominator: str = "valid") -> DataFrame:
    """question, answer, votes, total and score by exact equality; of equals the answer that came first.

    ``denominator`` is ``valid``, for candidates with an answer, or ``all``.
    """
    filled = F.col(answer).isNotNull() & (F.col(answer) != "")
    totals = candidates.groupBy(question).agg((F.count_if(filled) if denominator == "valid" else F.count("*")).alias("total"))
    counted = candidates.where(filled).groupBy(question, answer).agg(F.count("*").alias("votes"), F.min(F.struct(*order)).alias("__first"))
    best = counted.groupBy(question).agg(F.min_by(F.struct(answer, "votes"), F.struct(-F.col("votes"), F.col("__first"))).alias("b"))
    return best.join(totals, question).select(question, F.col("b")[answer].alias(answer), F.col("b.votes").alias("votes"), "total", (F.col("b.votes") / F.col("total")).alias("score"))


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    """What equal answers have in common: their number, or else their plain text."""

    def form(text: str) -> str:
        plain = plain_answer(text)
        n = number(plain)
        return f"text {plain}" if n is None else f"number {n}"

    return texts.map(form)


def _classes(counted: DataFrame) -> DataFrame:
    """(question_id, answer, votes): the largest class of ``same_answer`` for each question, from its texts with ``first`` and ``times``.

    Answers of one form are one class, except that a denial joins the first
    class that a denial has opened, unless its own form was there before. That
    is settled by the first text of every form and of all denials: no task sees
    all answers to a question.
    """
    at = F.struct("first", "text")
    formed = counted.withColumn("form", _canonical("text")).withColumn("denies", F.lower("text").contains("no "))
    groups = formed.groupBy("question_id", "form", "denies").agg(F.sum("times").alias("times"), F.min(at).alias("at"))
    forms = groups.groupBy("question_id", "form").agg(F.min("at").alias("opened"), F.min_by("denies", "at").alias("denial"))
    denial = forms.groupBy(F.col("question_id").alias("__q")).agg(F.min_by(F.struct("form", "opened"), F.when(F.col("denial"), F.col("opened"))).alias("d"))
    known = groups.join(forms.select(F.col("question_id").alias("__f"), F.col("form").alias("__form"), "opened"), F.col("question_id").eqNullSafe(F.col("__f")) & (F.col("form") == F.col("__form")))
    known = known.join(denial, F.col("question_id").eqNullSafe(F.col("__q")))
    moved = F.col("denies") & F.col("d").isNotNull() & (F.col("opened") > F.col("d.opened"))
    classes = known.groupBy("question_id", F.when(moved, F.col("d.form")).otherwise(F.col("form")).alias("form")).agg(F.sum("times").alias("votes"), F.min("at").alias("at"))
    best = classes.groupBy("question_id").agg(F.min_by(F.struct("at", "votes"), F.struct(-F.col("votes"), F.col("at"))).alias("b"))
    return best.select("question_id", F.col("b.at.text").alias("answer"), F.col("b.votes").alias("votes"))


def majority_of_classes(candidates: DataFrame, same: Callable[[str, str], bool] = same_answer, denominator: str = "valid") -> DataFrame:
    """(question_id, answer, votes, total, score): each candidate joins the first class whose first member it equals.

    The order matters, as the relation need not be transitive. Equal texts are
    counted ahead of the shuffle. With our own rule no task sees all answers to
    a question; with another, one gets the different answers to it, in the order
    of their first candidate.
    """

    def vote(group: pd.DataFrame) -> pd.DataFrame:
        heads: list[list] = []
        for text, times in group.sort_values(["first", "text"], kind="stable")[["text", "times"]].itertuples(index=False):
            for head in heads:
                if same(head[0], text):
                    head[1] += times
                    break
            else:
                heads.append([text, times])
        best = max(heads, key=lambda h: h[1])
        return pd.DataFrame([(group["question_id"].iloc[0], best[0], int(best[1]))], columns=["question_id", "answer", "votes"])

    filled = F.col("text").isNotNull() & (F.col("text") != "")
    rows = candidates.select("question_id", "candidate_index", "text")
    counted = rows.where(filled).groupBy("question_id", "text").agg(F.min("candidate_index").alias("first"), F.count("*").alias("times"))
    best = _classes(counted) if same is same_answer else counted.groupBy("question_id").applyInPandas(vote, "question_id string, answer string, votes long")
    best = best.withColumnRenamed("question_id", "__q")
    totals = rows.groupBy("question_id").agg((F.count_if(filled) if denominator == "valid" else F.count("*")).alias("total"))
    joined = totals.join(best, F.col("question_id").eqNullSafe(F.col("__q")), "left")
    return joined.select("question_id", "answer", F.coalesce("votes", F.lit(0)).alias("votes"), "total", F.coalesce(F.try_divide("votes", "total"), F.lit(0.0)).alias("score"))


def self_consistency(candidates: DataFrame, question: str, answer: str, golden: Column) -> DataFrame:
    """question, consistent, total and score: candidates that give the golden answer among those with one; 0.0 without any."""
    filled = F.col(answer).isNotNull() & (F.col(answer) != "")
    counted = candidates.groupBy(question).agg(F.count_if(filled & (F.col(answer) == golden)).alias("consistent"), F.count_if(filled).alias("total"))
    return counted.withColumn("score", F.coalesce(F.try_divide("consistent", "total"), F.lit(0.0)))


def solver_reward(accuracy: Column, form: Column, weight: float = 0.1) -> Column:
    return (1 - weight) * accuracy + weight * form


def questioner_reward(valid: Column, score: Column, share: Column) -> Column:
    return F.when(valid, F.least(score, 1 - score) - share).otherwise(-1 - share)


def best_candidate(rows: DataFrame, group: list[str], tiers: Column, score: str, index: str) -> DataFrame:
    """One row of each group: the lowest tier, then the highest score, then the lowest index."""
    struct = F.struct(*[c for c in rows.columns if c not in group])
    best = rows.groupBy(*group).agg(F.min_by(struct, F.struct(tiers.alias("t"), (-F.col(score)).alias("s"), F.col(index).alias("i"))).alias("b"))
    return best.select(*group, "b.*")
