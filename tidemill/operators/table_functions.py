"""Table functions for SQL: candidates of each prompt, and the first valid of each sample's attempts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Candidates:
    """``candidates(TABLE(prompts), 'prompt', n)``: n rows for each, with ``candidate`` from 0 and the prompt to ask for it."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, prompt: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or prompt.value not in rows.dataType.names or n.value is None or n.value < 0:
            raise ValueError("candidates(TABLE(..), name of a column of it, number from 0 on)")
        return AnalyzeResult(T.StructType([*rows.dataType.fields, T.StructField("candidate", T.IntegerType()), T.StructField("asked", T.StringType())]))

    def eval(self, rows: Row, prompt: str, n: int) -> Iterator[tuple]:
        text = rows[prompt]
        for k in range(n):
            yield *rows, k, None if text is None else f"{text}|{k}"


class FirstValid:
    """``first_valid(TABLE(tried), 'sample_id', 'attempt', 'valid')``: of each sample the first valid attempt, with ``tries``, the attempts up to it.

    The engine sends a sample's rows to one task, in order; of these it keeps one.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, attempt: AnalyzeArgument, valid: AnalyzeArgument) -> AnalyzeResult:
        names = rows.dataType.names if rows.isTable else []
        if not {key.value, attempt.value, valid.value} <= {*names}:
            raise ValueError("first_valid(TABLE(..), names of three columns of it)")
        schema = T.StructType([*rows.dataType.fields, T.StructField("tries", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(attempt.value)])

    def __init__(self):
        self.tries, self.found = 0, None

    def eval(self, rows: Row, key: str, attempt: str, valid: str) -> None:
        if self.found is None:
            self.tries += 1
            if rows[valid]:
                self.found = rows

    def terminate(self) -> Iterator[tuple]:
        if self.found is not None:
            yield *self.found, self.tries


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("candidates", F.udtf(Candidates))
    spark.udtf.register("first_valid", F.udtf(FirstValid))
