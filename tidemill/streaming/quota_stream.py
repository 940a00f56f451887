"""Quota admission over a stream with keyed state: each quota's line has its counts in the state store, and timers on demand."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemill.operators.quota import FLEXIBLE
from tidemill.storage import Folder

REASON = "Quota exceeded for type"
STATE = "category string, count long"
#: The state store that keyed state with named variables needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How rows travel through the keyed state: as text, which keeps large numbers beside nulls whole.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Keys that rows which can't be admitted are dealt out to, beside their line.
SPREAD = 64
#: Rows of a line whose progress rows are made at once.
STRETCH = 50_000


@dataclass(frozen=True)
class Admission:
    """What arrives, and what may be taken of it.

    A progress row is written whenever a line has seen ``processed`` more rows
    or admitted ``accepted`` more, and, with ``idle``, when it has had none for
    so many seconds; a stream with ``idle`` waits for more rows instead of
    ending when all is read.
    """

    results: DataFrame
    quotas: dict[str, int]
    category: str
    order: str
    processed: int = 5
    accepted: int = 10
    idle: float | None = None


def admit_stream(results: DataFrame, quotas: dict[str, int], category: str = "category", order: str = "arrival", **more) -> Admission:
    """Rows are admitted within their category's quota or, without one, within the flexible pool; those of a micro-batch compete in their order, nulls first, then by the hash of the row."""
    return Admission(results, dict(quotas), category, order, **more)


def _beyond(quotas: dict[str, int], rows: pd.DataFrame) -> np.ndarray:
    """Rows that have more rows of their line before them, among these alone, than the line's quota."""
    ordered = rows.sort_values(["order", "tie"], kind="stable", na_position="first")
    place = ordered.groupby("line").cumcount().reindex(rows.index)
    return (place >= rows["line"].map(quotas).fillna(0)).to_numpy()


class Admit(StatefulProcessor):
    """The state of a line: how many rows it has admitted and seen, and how many it had seen at its last progress row."""

    def __init__(self, quotas: dict[str, int], processed: int, accepted: int, idle: float | None):
        self.quotas, self.steps, self.idle = quotas, (processed, accepted), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "admitted long, seen long, noted long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        line, salt = key
        if salt:
            for part in rows:
                yield self._out(line, part, "rejected")
            return
        admitted, seen, noted = self.counts.get() if self.counts.exists() else (0, 0, 0)
        quota = self.quotas.get(line, 0)
        free, held, n = max(0, quota - admitted), None, 0
        for part in rows:
            n += int(part["n"].sum())
            part = part[part["row"].notna()]
            both = (part if held is None else pd.concat([held, part])).sort_values(["order", "tie"], kind="stable", na_position="first")
            held = both.head(free)  # no more than what is left of the quota
            if len(both) > free:
                yield self._out(line, both.iloc[free:], "rejected")
        if held is not None and len(held):
            yield self._out(line, held, "accepted")
        for at in range(0, n, STRETCH):  # a line may have seen many millions of rows
            k = np.arange(at + 1, min(at + STRETCH, n) + 1)
            k = k[((seen + k) % self.steps[0] == 0) | ((k <= free) & ((admitted + k) % self.steps[1] == 0))]
            if len(k):
                yield self._progress(line, seen + k, np.minimum(admitted + k, max(quota, admitted)))
                noted = seen + int(k[-1])
        self.counts.update((admitted + min(n, free), seen + n, noted))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        admitted, seen, noted = self.counts.get()
        if seen > noted:
            self.counts.update((admitted, seen, seen))
            yield self._progress(key[0], [seen], [admitted])

    def close(self) -> None:
        pass

    @staticmethod
    def _out(line: str, part: pd.DataFrame, outcome: str) -> pd.DataFrame:
        return pd.DataFrame({"outcome": outcome, "line": line, "seen": pd.NA, "admitted": pd.NA, "row": part["row"].tolist()}).astype({"seen": "Int64", "admitted": "Int64"})

    @staticmethod
    def _progress(line: str, seen, admitted) -> pd.DataFrame:
        out = pd.DataFrame({"outcome": "progress", "line": line, "seen": seen, "admitted": admitted, "row": None})
        return out.astype({"seen": "Int64", "admitted": "Int64"})


def judged(admission: Admission) -> DataFrame:
    """A stream of (outcome, line, seen, admitted, row): rows, as JSON, with what became of them, and progress rows.

    A task holds no more rows of a line than are left of its quota. Rows that
    can't be among them, as enough of their own part come first, are dealt out
    to keys without state, so that a frequent category with a small quota
    doesn't meet in one task; its line gets their number.
    """
    quotas, results = admission.quotas, admission.results
    typed = [k for k in quotas if k != FLEXIBLE]
    category = F.col(admission.category)
    line = F.when(category.isin(*typed), category.cast("string")).otherwise(FLEXIBLE) if typed else F.lit(FLEXIBLE)
    whole = F.to_json(F.struct(*(F.col(c) for c in results.columns)), JSON)
    keyed = results.select(line.alias("line"), F.col(admission.order).alias("order"), F.xxhash64(whole).alias("tie"), whole.alias("row"))
    schema = T.StructType([*keyed.schema.fields, T.StructField("salt", T.IntegerType(), False), T.StructField("n", T.LongType(), False)])

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            beyond = _beyond(quotas, part)
            yield part.assign(salt=np.where(beyond, part["tie"].to_numpy() % SPREAD + 1, 0).astype("int32"), n=1)
            away = part[beyond].groupby("line").agg(order=("order", "first"), n=("tie", "size")).reset_index()
            if len(away):  # the line hears how many they are
                yield away.assign(tie=0, row=None, salt=0)[[*part.columns, "salt", "n"]].astype({"salt": "int32"})

    out = "outcome string, line string, seen long, admitted long, row string"
    processor = Admit(quotas, admission.processed, admission.accepted, admission.idle)
    return keyed.mapInPandas(deal, schema).groupBy("line", "salt").transformWithStateInPandas(processor, out, "Append", "None" if admission.idle is None else "ProcessingTime")


def write_outcomes(admission: Admission, accepted_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Accepted rows to one folder, rejected ones with their reason to another, progress rows to ``progress`` beside the checkpoint.

    The counts are state under the checkpoint: a micro-batch that is repeated
    starts from those of the batch before, and overwrites its own part of each
    folder; a stream whose checkpoint is damaged fails.
    """
    spark, schema = admission.results.sparkSession, admission.results.schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            part = lambda path: f"{path}/batch={number}"
            rows = held.select("outcome", F.from_json("row", schema, JSON).alias("row"))
            rows.where("outcome = 'accepted'").select("row.*").write.mode("overwrite").json(part(accepted_path))
            rows.where("outcome = 'rejected'").select("row.*", F.lit(REASON).alias("error")).write.mode("overwrite").json(part(rejected_path))
            held.where("outcome = 'progress'").select("line", "seen", "admitted").write.mode("overwrite").json(part(f"{checkpoint}-progress"))
        finally:
            held.unpersist()

    writer = judged(admission).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if admission.idle is None else writer.trigger(processingTime="0 seconds")).start()


def progress_so_far(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(line, seen, admitted) of every progress row."""
    return spark.read.schema("line string, seen long, admitted long").json(f"{checkpoint}-progress")


def counts_so_far(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(category, count) of what was admitted, from the state of the last micro-batch; the pool's row is ``FLEXIBLE``. Only before the first micro-batch has ended there is none; state that is missing later is an error."""
    if not Folder(checkpoint).below("commits").names():
        return spark.createDataFrame([], STATE)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "counts").load()
    return state.select(F.col("key.line").alias("category"), F.col("value.admitted").alias("count")).where("count > 0")


def is_full(spark: SparkSession, quotas: dict[str, int], checkpoint: str) -> bool:
    """Whether every quota and the pool are used up."""
    used = {r.category: r["count"] for r in counts_so_far(spark, checkpoint).collect()}  # a row for each quota
    return all(used.get(k, 0) >= n for k, n in quotas.items())


def run_until_full(admission: Admission, accepted_path: str, rejected_path: str, checkpoint: str, pause: float = 1.0) -> bool:
    """Runs until the quotas are full, what arrived is read, or the stream fails; True if they are full.

    How much is in flight is the source's limit for a micro-batch
    (``maxFilesPerTrigger`` and the like); at most one more is read when the
    quotas are full.
    """
    spark = admission.results.sparkSession
    query = write_outcomes(admission, accepted_path, rejected_path, checkpoint)
    seen = -1
    while not query.awaitTermination(pause):
        last = query.lastProgress
        if last is not None and last["batchId"] != seen:
            seen = last["batchId"]
            if is_full(spark, admission.quotas, checkpoint):
                query.stop()
                break
    return is_full(spark, admission.quotas, checkpoint)
