from __future__ import annotations

import os
import random
import shutil
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemill.operators import quota
from tidemill.operators.quota import FLEXIBLE
from tidemill.streaming import quota_stream
from tidemill.streaming.quota_stream import admit_stream, counts_so_far, progress_so_far, write_outcomes

SCHEMA = "arrival long, category string, note long"


def feed(spark, folder, rows) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/in")


def source(spark, folder):
    os.makedirs(f"{folder}/in", exist_ok=True)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def start(admission, folder):
    return write_outcomes(admission, f"{folder}/ok", f"{folder}/no", f"{folder}/checkpoint")


def results(spark, folder, name):
    return spark.read.schema(SCHEMA).json(f"{folder}/{name}").drop("batch")


def some(chance, lo, hi):
    return [(k, chance.choice(["a", "a", "a", "b", "c", None]), 2**60 + k if k % 3 else None) for k in range(lo, hi)]


def test_one_micro_batch_admits_what_a_table_does(spark, tmp_path):
    rows = some(random.Random(1), 0, 400)
    quotas = {"a": 30, "b": 1000, FLEXIBLE: 25}
    feed(spark, tmp_path, rows)
    start(admit_stream(source(spark, tmp_path), quotas), tmp_path).awaitTermination(120)
    table = quota.admit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(quotas.items()), "category string, quota long"), ["arrival"])
    for name, admitted in (("ok", True), ("no", False)):
        expected = sorted(map(tuple, table.where(F.col("admitted") == admitted).select("arrival", "category", "note").collect()))
        assert sorted(map(tuple, results(spark, tmp_path, name).collect())) == expected  # large numbers beside nulls are whole
    used = {r.category: r["count"] for r in counts_so_far(spark, f"{tmp_path}/checkpoint").collect()}
    assert used == {"a": 30, "b": sum(r[1] == "b" for r in rows), FLEXIBLE: 25}


def test_a_restart_within_a_micro_batch_changes_nothing(spark, tmp_path, monkeypatch):
    chance = random.Random(2)
    quotas = {"a": 50, FLEXIBLE: 20}
    every = []
    for k in range(3):
        every.append(some(chance, 100 * k, 100 * k + 100))
        feed(spark, tmp_path, every[-1])
    monkeypatch.setattr(quota_stream, "REASON", F.raise_error(F.lit("disk full")))  # accepted rows are written, rejected ones are not
    with pytest.raises(StreamingQueryException):
        start(admit_stream(source(spark, tmp_path), quotas), tmp_path).awaitTermination(120)
    monkeypatch.undo()
    assert counts_so_far(spark, f"{tmp_path}/checkpoint").count() == 0
    start(admit_stream(source(spark, tmp_path), quotas), tmp_path).awaitTermination(120)
    kept, lost = (results(spark, tmp_path, n) for n in ("ok", "no"))
    assert kept.where("category = 'a'").count() == 50 and kept.where("category <> 'a' or category is null").count() == 20
    assert sorted(r.arrival for r in kept.unionByName(lost).collect()) == list(range(300))
    # the first rows of a line that came, micro-batch by micro-batch
    assert {r.arrival for r in kept.where("category = 'a'").collect()} == set(sorted(r[0] for rows in every for r in rows if r[1] == "a")[:50])


def test_progress_rows_at_every_n(spark, tmp_path):
    rows = [(k, "a", k) for k in range(23)]
    feed(spark, tmp_path, rows[:12])
    feed(spark, tmp_path, rows[12:])
    for quota_of_a in (18, 9):
        folder = tmp_path / str(quota_of_a)
        folder.mkdir()
        (tmp_path / "in").rename(folder / "in") if quota_of_a == 18 else (tmp_path / "18" / "in").rename(folder / "in")
        start(admit_stream(source(spark, folder), {"a": quota_of_a, FLEXIBLE: 1}, processed=5, accepted=4), folder).awaitTermination(120)
        got = sorted((r.seen, r.admitted) for r in progress_so_far(spark, f"{folder}/checkpoint").collect())
        assert got == [(n, min(n, quota_of_a)) for n in range(1, 24) if n % 5 == 0 or (n <= quota_of_a and n % 4 == 0)]


def test_a_timer_notes_the_last_rows_of_a_line(spark, tmp_path):
    feed(spark, tmp_path, [(k, "a", k) for k in range(7)])
    query = start(admit_stream(source(spark, tmp_path), {"a": 6, FLEXIBLE: 1}, idle=0.5), tmp_path)
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = sorted((r.seen, r.admitted) for r in progress_so_far(spark, f"{tmp_path}/checkpoint").collect()) if os.path.exists(f"{tmp_path}/checkpoint-progress") else []
            if (7, 6) in got:
                break
    finally:
        query.stop()
    assert got == [(5, 5), (7, 6)]


def test_lost_state_is_an_error(spark, tmp_path):
    feed(spark, tmp_path, [(k, "a", k) for k in range(7)])
    start(admit_stream(source(spark, tmp_path), {"a": 5}), tmp_path).awaitTermination(120)
    shutil.rmtree(f"{tmp_path}/checkpoint/state")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader says
        counts_so_far(spark, f"{tmp_path}/checkpoint").collect()
    feed(spark, tmp_path, [(9, "a", 9)])
    with pytest.raises(StreamingQueryException):
        start(admit_stream(source(spark, tmp_path), {"a": 5}), tmp_path).awaitTermination(120)


class Held:
    """A line's state, in memory."""

    def __init__(self):
        self.value = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_progress_rows_of_many_rows_come_in_parts():
    admit, held = quota_stream.Admit({"a": 25}, 5, 10, None), Held()
    admit.init(held)
    held.update((3, 7, 5))
    n = 1_000_003
    rows = pd.DataFrame({"order": [None], "tie": [0], "row": [None], "n": [n]})
    parts = [p for p in admit.handleInputRows(("a", 0), iter([rows]), None) if len(p)]
    assert max(map(len, parts)) <= 50_000
    got = pd.concat(parts)
    marks = [k for k in range(1, n + 1) if (7 + k) % 5 == 0 or (k <= 22 and (3 + k) % 10 == 0)]
    assert set(got["outcome"]) == {"progress"} and got["row"].isna().all()
    assert got["seen"].tolist() == [7 + k for k in marks]
    assert got["admitted"].tolist() == np.minimum(3 + np.array(marks), 25).tolist()
    assert held.value == (25, 7 + n, 7 + marks[-1])
