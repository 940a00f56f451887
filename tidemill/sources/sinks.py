"""Sinks: training sets, logs with their outcome, reports, metrics and checkpoint lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements of an array that Python has as objects at once.
AT_ONCE = 100


def write_training_set(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Parquet; a single file only if one is asked for."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A JSON array's lines from those of its elements, a few at once: a batch may be 10,000 long ones."""
    out = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield out(["["])
    ahead = ""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            lines = batch.column(0).slice(at, AT_ONCE).to_pylist()
            yield out([ahead + lines[0], *("," + x for x in lines[1:])])
            ahead = ","
    yield out(["]"])


def write_json_array(df: DataFrame, path: str) -> None:
    """Part files that are one JSON array each, written row by row."""
    df.select(F.to_json(F.struct(*(F.col(c) for c in df.columns))).alias("value")).mapInArrow(array_lines, "value string").write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str, success: bool, error: str | None = None) -> None:
    """Rows with ``sample_index`` go to the log with what became of them; the commit of the write makes it atomic."""
    meta = F.struct(F.col("sample_index").cast("long").alias("sample_index"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit(success).alias("success"), F.lit(error).cast("string").alias("error"))
    df.withColumn("_meta", meta).drop("sample_index").write.mode("append").json(path)


def finalize_log(log: DataFrame, path: str, all_rows: bool = False, one_file: bool = False) -> None:
    """The successful rows of a log as one set, without the log's own column; a single file only if one is asked for."""
    rows = (log if all_rows else log.where("_meta.success")).drop("_meta")
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").json(path)


def report_text(lines: DataFrame, order: str = "line_no", text: str = "line") -> str:
    """A small report as one text."""
    row = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("t")).first()
    return row.t or ""


def write_report(lines: DataFrame, path: str, order: str = "line_no", text: str = "line") -> None:
    """A report as one text file, its lines in order."""
    lines.select(order, text).coalesce(1).sortWithinPartitions(order).select(text).write.mode("overwrite").text(path)


def to_sinks(metrics: DataFrame, *sinks: Callable[[DataFrame], None]) -> None:
    """The same metrics to every sink. They are a row for each name and step, held while the sinks write."""
    held = metrics.persist()
    try:
        for sink in sinks:
            sink(held)
    finally:
        held.unpersist()


def append_metrics(metrics: DataFrame, path: str) -> None:
    """(step, name, value) rows, a folder for each step so that one step can be read alone."""
    metrics.select("step", "name", "value").write.mode("append").partitionBy("step").parquet(path)


def checkpoints_to_drop(checkpoints: DataFrame, limit: int) -> DataFrame:
    """Of (step, path) those that go when a new one comes and ``limit`` may stay."""
    rank = F.row_number().over(Window.orderBy(F.desc("step"), "path"))  # a listing of checkpoints is short
    return checkpoints.withColumn("rank", rank).where(F.col("rank") > max(limit - 1, 0)).drop("rank")
