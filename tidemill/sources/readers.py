"""Scans: JSON arrays, JSON lines, parquet files and folders, tolerant unions, deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.selection import first_by_hash
from tidemill.sources import json_arrays


#: Bytes of a file whose text may stand as an argument.
MAX_TEXT = 1 << 20


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one JSON array of objects, read by as many tasks as it has splits."""
    return json_arrays.json_array(spark, path, schema)


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """One object on each line; a damaged line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_tolerant(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The readable lines, and the damaged ones as ``line``, so that they can be counted."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path if isinstance(path, str) else list(path)).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.where("r._corrupt is null").select(*(F.col("r")[f.name].alias(f.name) for f in schema.fields))
    return good, parsed.where("r._corrupt is not null").select(F.col("value").alias("line"))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parquet_in_name_order(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """A folder's rows with ``file_name`` and ``file_row``, which order them as the files by name do; the first rows only on demand.

    For these no more files are read than hold them.
    """
    with_place = lambda df: df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("file_row"))
    whole = spark.read.parquet(path)
    if first is None:
        return with_place(whole)
    files = whole.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path")).groupBy("name", "path").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("name", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    wanted = [r.path for r in files.select("path", before.alias("before")).where(F.col("before") < first).collect()]
    if not wanted:
        return with_place(whole).limit(0)
    return with_place(spark.read.schema(whole.schema).parquet(*wanted)).orderBy("file_name", "file_row").limit(first)


def one_file(spark: SparkSession, path: str, seed: int = 42) -> DataFrame:
    """The rows of one file of a folder, chosen by a seeded hash of its name."""
    names = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("p")).distinct()
    chosen = names.orderBy(F.xxhash64(F.lit(seed), F.element_at(F.split("p", "/"), -1)), "p").first()
    if chosen is None:
        raise ValueError(f"no rows in {path}")
    return spark.read.parquet(chosen.p)


def dataset(spark: SparkSession, spec: str) -> DataFrame:
    """``path`` or ``path@split``, where the split is a sub-folder or the beginning of the files' names."""
    path, _, split = spec.partition("@")
    if not split:
        return spark.read.parquet(path)
    try:
        return spark.read.parquet(f"{path}/{split}")
    except AnalysisException:
        return spark.read.option("pathGlobFilter", f"{split}*.parquet").parquet(path)


def union_of_readable(spark: SparkSession, paths: Sequence[str], schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """All files that are there, by columns; missing ones are passed over."""
    frames = []
    for p in paths:
        try:
            frames.append(spark.read.schema(schema).option("multiLine", multi_line).json(p))
        except AnalysisException:
            continue
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def latest_file(spark: SparkSession, path: str, file_format: str = "text") -> str | None:
    """The path of the file that was changed last."""
    listed = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    row = listed.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row.p


def weights_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """(image_type, weight) from a JSON object; None if the file is something else."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    row = text.select(F.size("m").alias("n"), F.col("m").isNull().alias("bad")).first()
    if row is None or row.bad:
        return None
    return text.select(F.explode("m").alias("image_type", "weight"))


def text_or_file(spark: SparkSession, value: str) -> str:
    """The content of the file if there is one by that name, else the text itself."""
    try:
        size = spark.read.format("binaryFile").load(value).select("length").first()
        if size is None:
            return value
        if size.length > MAX_TEXT:
            raise ValueError(f"{value} has {size.length} bytes, too many for a prompt")
        row = spark.read.text(value, wholetext=True).first()
    except ValueError:
        raise
    except Exception:  # noqa: BLE001 - any text may be no valid path
        return value
    return row.value if row else value


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, those that are first by md5(seed, key), which other engines can repeat."""
    return first_by_hash(df, n, seed, [key])
