from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import images
from tidemill.operators import batch, metrics, records, table_functions, versions
from tidemill.operators.versions import Conflict, VersionedTable
from tidemill.plans.providers import Canned, Paced
from tidemill.plans.replies import ReplyStore
from tidemill.sources import sinks


def test_table_functions(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, "p"), (2, None)], "id long, prompt string").createOrReplaceTempView("prompts")
    got = spark.sql("select id, candidate, asked from candidates(TABLE(prompts), 'prompt', 2)").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "p|0"), (1, 1, "p|1"), (2, 0, None), (2, 1, None)]
    assert spark.sql("select * from candidates(TABLE(prompts), 'prompt', 0)").count() == 0
    with pytest.raises(Exception, match="name of a column"):
        spark.sql("select * from candidates(TABLE(prompts), 'nothing', 2)").collect()
    tried = spark.createDataFrame([(s, a, bool(a % 3 == s % 3), f"{s}-{a}") for s in range(20) for a in range(s % 5)], "sample_id long, attempt int, valid boolean, text string")
    tried.repartition(5).createOrReplaceTempView("tried")
    got = spark.sql("select sample_id, attempt, text, tries from first_valid(TABLE(tried), 'sample_id', 'attempt', 'valid')")
    expected = records.attempts(tried, "valid", max_retries=99).select("sample_id", "attempt", "text", "tries")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() > 5


WEAK = "kind string, text string, error string, n long"


def weak_table(spark, folder) -> VersionedTable:
    return VersionedTable(spark, str(folder), T._parse_datatype_string(WEAK), ["kind", "text"])


def test_versions_of_a_table(spark, tmp_path):
    table = weak_table(spark, tmp_path)
    assert table.version() == 0 and table.at().count() == 0
    row = lambda *rows: spark.createDataFrame(rows, WEAK)
    assert table.add(row(("chart", "axis", "reading", 3), ("chart", "legend", "reading", 1), ("map", "scale", "unit", 2))) == 1
    assert table.update({"kind": "chart", "text": "axis"}, {"n": 5}) == 2
    assert table.remove({"kind": "map"}) == 3
    assert table.put(row(("map", "scale", "unit", 9), ("table", None, "x", 1))) == 4
    now = sorted(map(tuple, table.at().collect()), key=str)
    assert now == sorted([("chart", "axis", "reading", 5), ("chart", "legend", "reading", 1), ("map", "scale", "unit", 9), ("table", None, "x", 1)], key=str)
    assert sorted(r.n for r in table.at(1).collect()) == [1, 2, 3] and table.at(3).where("kind = 'map'").count() == 0 and table.at(0).count() == 0
    assert [r.version for r in table.history().orderBy("version").collect()] == [1, 1, 1, 2, 3, 4, 4]
    with pytest.raises(ValueError, match="there already"):
        table.add(row(("chart", "axis", "reading", 3)))
    assert table.remove({"text": None}) == 5 and table.at().where("kind = 'table'").count() == 0
    assert weak_table(spark, tmp_path).version() == 5


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = weak_table(spark, tmp_path), weak_table(spark, tmp_path)
    row = lambda n: spark.createDataFrame([("chart", "axis", "reading", n)], WEAK)
    base = one.put(row(1))
    assert one.put(row(2), after=base) == base + 1
    with pytest.raises(Conflict):
        two.put(row(3), after=base)
    assert [r.n for r in two.at().collect()] == [2] and two.history().count() == 2  # what lost is never read
    assert two.put(row(3), after=two.version()) == base + 2 and [r.n for r in one.at().collect()] == [3]
    assert not [f for f in os.listdir(f"{tmp_path}/commits") if f.startswith(".0")]


def test_report_of_a_table(spark):
    rows = spark.createDataFrame([("map", "scale", "unit", 2)] + [("chart", f"t{k}", "reading", k) for k in range(5)], WEAK)
    assert sorted(map(tuple, versions.summary(rows, "kind", "n").collect())) == [("chart", 5, 10), ("map", 1, 2)]
    text = sinks.report_text(versions.markdown(rows, "kind", "text", "error", "n"))
    assert text.split("\n") == ["## chart", "", "- kinds: 5", "- total: 10", "", "| rank | text | kind | count |", "|---|---|---|---|", "| 1 | t4 | reading | 4 |", "| 2 | t3 | reading | 3 |", "| 3 | t2 | reading | 2 |", "",
                                "1. **t4** (reading, 4)", "2. **t3** (reading, 3)", "3. **t2** (reading, 2)", "4. **t1** (reading, 1)", "5. **t0** (reading, 0)", "", "## map", "", "- kinds: 1", "- total: 2", "", "| rank | text | kind | count |", "|---|---|---|---|", "| 1 | scale | unit | 2 |", ""]


def test_slots_keep_callers_apart():
    now, begun = [100.0], []

    class Slow:
        def __init__(self, seconds):
            self.seconds = seconds

        def call(self, prompts):
            begun.append(now[0])
            now[0] += self.seconds
            return prompts

    def sleep(s):
        now[0] += s

    for seconds in (0.0, 0.5, 7.0):
        begun.clear()
        callers = [Paced(Slow(seconds), 1.0, owners=3, owner=k, base=100.0, sleep=sleep, clock=lambda: now[0]) for k in range(3)]
        for c in [0, 1, 2, 2, 1, 0, 0, 0]:
            assert callers[c].call([f"{c}"]) == [f"{c}"]
        assert all(b - a >= 1.0 for a, b in zip(begun, begun[1:], strict=False))
    alone = Paced(Canned(("ok",)), 2.0, sleep=sleep, clock=lambda: now[0])
    before = now[0]
    assert alone.call(["a", "b", "c"]) == ["ok"] * 3 and now[0] - before >= 4.0 and alone.call([]) == []


def test_calls_of_all_tasks_keep_their_distance(spark, tmp_path):
    folder, interval = str(tmp_path / "calls"), 0.15
    os.makedirs(folder)

    class Stamped:
        def call(self, prompts):
            if len(os.listdir(folder)) > 6 and not os.path.exists(f"{folder}.failed"):
                open(f"{folder}.failed", "w").close()
                raise OSError("broken off")
            with open(f"{folder}/{time.time()}", "w") as f:
                f.write(prompts[0])
            return prompts

    rows = spark.range(14).select(F.concat(F.lit("p"), "id").alias("prompt"))
    got = ReplyStore(spark, f"{tmp_path}/store").ask(rows, "prompt", Stamped(), tasks=3, interval=interval)
    assert os.path.exists(f"{folder}.failed")  # the stage was repeated
    times = sorted(map(float, os.listdir(folder)))
    assert got.where("reply <> prompt or reply is null").count() == 0 and sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder)) == sorted(f"p{k}" for k in range(14))
    assert all(b - a >= interval for a, b in zip(times, times[1:], strict=False))


def plain_variance(image):
    out = []
    for y in range(1, len(image) - 1):
        for x in range(1, len(image[0]) - 1):
            out.append(image[y - 1][x] + image[y + 1][x] + image[y][x - 1] + image[y][x + 1] - 4 * image[y][x])
    return float(np.var(out)) if out else 0.0


def test_sharpness_is_the_plain_kernel(spark):
    chance = np.random.default_rng(2)
    pictures = [chance.integers(0, 255, (h, w)).tolist() for h, w in ((3, 3), (4, 9), (30, 7), (2, 5), (5, 2), (1, 1), (64, 64))] + [[], [[]], None, [[7] * 5] * 5]
    rows = spark.createDataFrame(list(enumerate(pictures)), "id int, p array<array<int>>").repartition(3)
    got = {r.id: r.s for r in rows.select("id", images.sharpness(F.col("p")).alias("s")).collect()}
    for k, p in enumerate(pictures):
        assert got[k] is None if p is None else got[k] == pytest.approx(plain_variance(p) if p and p[0] else 0.0)


def test_slices_items_and_members(spark):
    rows = spark.range(10).select(F.col("id").alias("idx"), (F.col("id") * 10).alias("v"))
    for part in (slice(2, 7), slice(None, None, 3), slice(-4, None), slice(None, None, -1), slice(8, 1, -3), slice(5, 5), slice(-100, 100)):
        got = batch.sliced(rows, part.start, part.stop, part.step).orderBy("idx").collect()
        assert [r.v for r in got] == [k * 10 for k in range(10)][part] and [r.idx for r in got] == list(range(len(got)))
    assert [r.v for r in batch.item(rows, -2).collect()] == [80]
    with pytest.raises(IndexError):
        batch.item(rows, 10)
    placed = batch.members(rows.withColumn("g", F.col("v") % 20), "g", ["v"]).collect()
    assert sorted((r.g, r.place, r.v) for r in placed) == sorted((g, k, g + 20 * k) for g in (0, 10) for k in range(5))


def test_values_are_appended_to_lists(spark):
    kept = spark.createDataFrame([("loss", 0, 2.0), ("loss", 1, 1.0)], "name string, place long, value double")
    more = spark.createDataFrame([("loss", 0.5), ("kl", 0.1), ("kl", 0.2)], "name string, value double")
    lists = {r.name: r["values"] for r in metrics.metric_lists(metrics.appended(kept, more)).collect()}
    assert lists == {"loss": [2.0, 1.0, 0.5], "kl": [0.1, 0.2]}
    assert metrics.appended(kept.limit(0), more.limit(0)).count() == 0


def test_sorted_then_shuffled(spark):
    rows = spark.createDataFrame([(f"t{k:03}", k) for k in range(200)], "text string, id long")
    got = [r.id for r in records.shuffled_by_text(rows, "text", 20).orderBy("idx").collect()]
    again = [r.id for r in records.shuffled_by_text(rows.repartition(7), "text", 20).orderBy("idx").collect()]
    assert got == again and len(set(got)) == 20 and got != sorted(got)
    assert sorted(r.id for r in records.shuffled_by_text(rows, "text", 500).collect()) == list(range(200))
