"""One iteration of the workflow: diagnose, allocate, generate, admit, score, curate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import curation, diagnosis, grading, quota
from tidemill.plans.providers import Provider
from tidemill.plans.replies import ReplyStore
from tidemill.storage import shared_folder


Model = TypeVar("Model")


@dataclass(frozen=True)
class Settings:
    generated: int = 1000
    target: int = 1024
    low: float = 0.3
    high: float = 0.8
    candidates: int = 9


def diagnose(judged: DataFrame) -> DataFrame:
    """(category, weight) from the judged sample."""
    return diagnosis.weights(diagnosis.accuracy(judged)).select("category", "weight")


def generate(sources: DataFrame, weights: DataFrame, provider: Provider, settings: Settings, store: ReplyStore) -> DataFrame:
    """Admitted new questions: (question_id, category, question, answer, arrival)."""
    quotas = quota.allocate(weights, settings.generated)
    wanted = quota.variants(quotas.where(F.col("category") != quota.FLEXIBLE).select("category", F.col("quota").alias("gap")), sources)
    prompts = wanted.join(sources.select("source_id", "question"), "source_id", "left").withColumn("prompt", F.concat_ws("|", "category", "source_id", "variant_index", "question"))
    replies = store.ask(prompts, "prompt", provider)
    made = replies.select(X.row_id(F.col("prompt")).alias("question_id"), "category", F.col("prompt").alias("question"), F.col("reply").alias("answer"), F.xxhash64("prompt").alias("arrival"))
    return quota.admit(made, quotas, ["arrival", "question_id"]).where("admitted").drop("admitted", "arrival_rank")


def score(questions: DataFrame, provider: Provider, settings: Settings, store: ReplyStore) -> DataFrame:
    """Self-consistency of sampled answers with the question's own."""
    sampled = questions.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(settings.candidates)))).withColumn("prompt", F.concat_ws("|", "question", F.col("k").cast("string")))
    answered = store.ask(sampled, "prompt", provider)
    scores = grading.self_consistency(answered, "question_id", "reply", F.col("answer")).select("question_id", "score")
    return questions.join(scores, "question_id")


def curate(scored: DataFrame, settings: Settings) -> DataFrame:
    """The training set: scores within the band, filled up to the target."""
    return curation.fill_up(scored, curation.in_band(F.col("score"), settings.low, settings.high), settings.target, ["question_id"])


def iterate(judged: DataFrame, sources: DataFrame, provider: Provider, settings: Settings | None = None, store: ReplyStore | None = None) -> DataFrame:
    """The training set of one iteration; every different prompt is asked once, in the store or, without one, in a folder of this iteration's own."""
    settings = settings or Settings()
    store = store or ReplyStore(sources.sparkSession, shared_folder(sources.sparkSession, "replies"))
    return curate(score(generate(sources, diagnose(judged), provider, settings, store), provider, settings, store), settings)


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of this folder; None if it was not written to the end."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def loop(model: Model, judge: Callable[[Model, int], DataFrame], train: Callable[[Model, DataFrame, int], Model], sources: DataFrame, provider: Provider, folder: str, iterations: int = 3, settings: Settings | None = None) -> Model:
    """Judge, generate, curate and train, again and again; each round's training set lies in a folder of its own.

    A round whose set is there is not generated again, so that a loop that
    was broken off goes on where it stopped, and one that broke off within a
    round asks for the replies only that are not in the round's store yet. An
    empty set ends the loop.
    """
    for k in range(1, iterations + 1):
        path = f"{folder}/iteration={k}"
        made = written(sources.sparkSession, path)
        if made is None:
            iterate(judge(model, k), sources, provider, settings, ReplyStore(sources.sparkSession, f"{folder}/replies-{k}")).write.mode("overwrite").parquet(path)
            made = sources.sparkSession.read.parquet(path)
        if made.limit(1).count() == 0:
            break
        model = train(model, made, k)
    return model
