"""Small tables kept by hand, as a log of changes: every version can be read, and of two writers that start from one version one wins."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.storage import Folder


class Conflict(Exception):
    """Someone else has written a version since."""


class VersionedTable:
    """Rows by key in a folder: ``changes`` has a table for each commit, ``commits`` a file that makes it count.

    A commit's file is created only if it isn't there, so that a version has
    one writer; changes without such a file are never read.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: Sequence[str]):
        self.spark, self.folder, self.schema, self.key = spark, Folder(folder), schema, list(key)
        self.logged = T.StructType([T.StructField("__gone", T.BooleanType()), *schema.fields])

    def _commits(self) -> dict[int, dict]:
        at = self.folder.below("commits")
        return {int(n.split(".")[0]): json.loads(at.read(n)) for n in at.names()}

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        return max((int(n.split(".")[0]) for n in self.folder.below("commits").names()), default=0)

    def _create(self, version: int, entry: Mapping[str, str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder.uri}/commits/{version:08d}.json")
        # content under another name first: a commit is whole or not there, and a rename replaces nothing
        hidden = f".{version:08d}.{uuid.uuid4().hex}"
        self.folder.below("commits").write(hidden, json.dumps(entry).encode())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        source = jvm.org.apache.hadoop.fs.Path(f"{self.folder.uri}/commits/{hidden}")
        try:
            context.rename(source, path, none)
        except Py4JJavaError as e:
            context.delete(source, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} is there") from e
            raise

    def commit(self, changes: DataFrame, after: int | None = None) -> int:
        """Writes the changes, rows with ``__gone``, as the version that follows ``after``, or the last one; ``Conflict`` if that is there. Of a key's changes in one commit the greatest row counts."""
        after = self.version() if after is None else after
        name = uuid.uuid4().hex
        changes.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.logged.fields)).write.parquet(self.folder.below(f"changes/{name}").uri)
        self._create(after + 1, {"changes": name})
        return after + 1

    def put(self, rows: DataFrame, after: int | None = None) -> int:
        """Adds rows, or replaces those of the same key."""
        return self.commit(rows.withColumn("__gone", F.lit(False)), after)

    def add(self, rows: DataFrame, after: int | None = None) -> int:
        """Adds rows whose keys are new; an error if one is there."""
        after = self.version() if after is None else after
        if rows.join(self.at(after), self.key, "left_semi").limit(1).count():
            raise ValueError("a key is there already")
        return self.put(rows, after)

    def update(self, key: Mapping[str, object], values: Mapping[str, object], after: int | None = None) -> int:
        """New values in the row of this key."""
        after = self.version() if after is None else after
        return self.put(self._of(key, after).withColumns({c: F.lit(v).cast(self.schema[c].dataType) for c, v in values.items()}), after)

    def remove(self, key: Mapping[str, object], after: int | None = None) -> int:
        after = self.version() if after is None else after
        return self.commit(self._of(key, after).withColumn("__gone", F.lit(True)), after)

    def _of(self, key: Mapping[str, object], version: int) -> DataFrame:
        found = self.at(version)
        for c, v in key.items():
            found = found.where(F.col(c).eqNullSafe(F.lit(v)))
        return found

    def history(self, version: int | None = None) -> DataFrame:
        """(version, __gone and the columns) of all changes up to a version."""
        commits = {v: c["changes"] for v, c in self._commits().items() if version is None or v <= version}
        if not commits:
            return self.spark.createDataFrame([], T.StructType([T.StructField("version", T.LongType()), *self.logged.fields]))
        names = self.spark.createDataFrame([(c, v) for v, c in commits.items()], "__name string, version long")
        rows = self.spark.read.schema(self.logged).parquet(*(self.folder.below(f"changes/{c}").uri for c in commits.values()))
        named = rows.withColumn("__name", F.element_at(F.split("_metadata.file_path", "/"), -2))
        return named.join(F.broadcast(names), "__name").select("version", *self.logged.names)

    def at(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the last one."""
        last = self.history(version).groupBy(*self.key).agg(F.max(F.struct("version", *self.logged.names)).alias("r"))
        return last.where("not r.__gone").select(*(F.col("r")[c].alias(c) for c in self.schema.names))


def summary(table: DataFrame, group: str, count: str) -> DataFrame:
    """For each value of ``group``: how many rows it has, and the sum of ``count``."""
    return table.groupBy(group).agg(F.count("*").alias("kinds"), F.sum(count).alias("total"))


def markdown(table: DataFrame, group: str, text: str, kind: str, count: str, top: int = 3) -> DataFrame:
    """(line_no, line): a report of a small table, group by group, with its top rows as a table and, if there are more, all as a list."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.desc(count), text, kind)
    ranked = table.withColumn("__r", F.row_number().over(order))
    sums = summary(table, group, count)
    head = sums.select(group, F.array(F.concat(F.lit("## "), group), F.lit(""), F.concat(F.lit("- kinds: "), "kinds"), F.concat(F.lit("- total: "), "total"), F.lit(""), F.lit("| rank | text | kind | count |"), F.lit("|---|---|---|---|")).alias("lines"), F.lit(0).alias("part"), F.lit(0).alias("place"))
    first = ranked.where(F.col("__r") <= top).select(group, F.array(F.concat(F.lit("| "), F.concat_ws(" | ", "__r", text, kind, count), F.lit(" |"))).alias("lines"), F.lit(1).alias("part"), F.col("__r").alias("place"))
    longer = ranked.join(sums.where(F.col("kinds") > top).select(group), group)
    every = longer.select(group, F.array(F.concat("__r", F.lit(". **"), text, F.lit("** ("), kind, F.lit(", "), F.col(count).cast("string"), F.lit(")"))).alias("lines"), F.lit(3).alias("part"), F.col("__r").alias("place"))
    gap = sums.where(F.col("kinds") > top).select(group, F.array(F.lit("")).alias("lines"), F.lit(2).alias("part"), F.lit(0).alias("place"))
    end = sums.select(group, F.array(F.lit("")).alias("lines"), F.lit(4).alias("part"), F.lit(0).alias("place"))
    rows = head.unionByName(first).unionByName(gap).unionByName(every).unionByName(end)
    lines = rows.select(group, "part", "place", F.posexplode("lines").alias("k", "line"))
    return lines.select(F.row_number().over(Window.orderBy(group, "part", "place", "k")).alias("line_no"), "line")  # a report is short
