from __future__ import annotations

import os
import uuid

import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidemill.plans.iteration import Settings, iterate, loop
from tidemill.plans.replies import ReplyStore, answer
from tidemill.storage import Folder


def counting(folder, breaks: int = 0):
    """A provider that notes each prompt in a file of its own and fails once in every task that comes to ``breaks`` calls, until ``mended`` is there; never says the same twice."""
    folder = str(folder)
    os.makedirs(folder, exist_ok=True)

    class Counting:
        calls = 0

        def call(self, prompts):
            Counting.calls += 1
            if breaks and Counting.calls > breaks and not os.path.exists(f"{folder}/mended"):
                raise OSError("broken off")
            for p in prompts:
                with open(f"{folder}/{uuid.uuid4().hex}.asked", "w") as f:
                    f.write(p)
            return [f"{p} {uuid.uuid4().hex}" for p in prompts]

    return Counting()


def asked(folder) -> list[str]:
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder) if n.endswith(".asked"))


def test_each_prompt_is_asked_once_however_often_it_is_read(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"p{k % 30}", "old") for k in range(90)] + [(90, None, "old"), (91, "", "old")], "id long, prompt string, reply string")
    store = ReplyStore(spark, f"{tmp_path}/store")
    provider = counting(tmp_path / "n")
    got = store.ask(rows, "prompt", provider)
    first, second = sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, got.collect()), key=str)
    assert first == second and got.columns == rows.columns
    assert asked(tmp_path / "n") == sorted([f"p{k}" for k in range(30)] + [""])
    by_prompt = {(p, r) for _, p, r in first}
    assert len(by_prompt) == 32 and (None, None) in by_prompt
    # more rows: only what is new is asked
    store.ask(rows.limit(0).unionByName(spark.createDataFrame([(1, "p1", ""), (2, "q", "")], rows.schema)), "prompt", provider)
    assert asked(tmp_path / "n").count("p1") == 1 and asked(tmp_path / "n").count("q") == 1
    assert store.table().count() == 32
    assert store.ask(rows.limit(0), "prompt", provider).count() == 0


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("p"), "id").alias("prompt"))
    store = ReplyStore(spark, f"{tmp_path}/store", handful=5)
    with pytest.raises(PythonException):
        store.ask(rows, "prompt", counting(tmp_path / "n", breaks=4))
    before = asked(tmp_path / "n")
    assert 0 < len(before) < 200
    again = ReplyStore(spark, f"{tmp_path}/store", handful=5)
    got = again.ask(rows, "prompt", counting(tmp_path / "n"))
    assert asked(tmp_path / "n") == sorted(f"p{k}" for k in range(200))
    assert got.where("reply is null").count() == 0 and again.table().select("digest").distinct().count() == again.table().count() == 200


def test_a_repeated_task_asks_for_the_rest(tmp_path):
    part = pd.DataFrame({"digest": [f"d{k}" for k in range(23)], "prompt": [f"p{k}" for k in range(23)]})
    log = Folder(f"{tmp_path}/log")
    with pytest.raises(OSError):
        list(answer(iter([part]), counting(tmp_path / "n", breaks=2), log, 5))
    assert len(asked(tmp_path / "n")) == 10
    (out,) = answer(iter([part[:11], part[11:]]), counting(tmp_path / "n"), log, 5)
    assert out["asked"].tolist() == [13] and asked(tmp_path / "n") == sorted(part["prompt"])


def test_a_settlement_that_broke_off_adds_nothing_twice(spark, tmp_path):
    store = ReplyStore(spark, f"{tmp_path}/store")
    log = store.folder.below("log/part-0")
    log.write("a.jsonl", b'["d1","p1","r1"]\n["d2","p2",null]')
    log.write("b.jsonl", b'["d1","p1","other"]')  # by a task that ran twice
    spark.createDataFrame([("d2", "p2", None)], "digest string, prompt string, reply string").write.parquet(f"{tmp_path}/store/replies")
    store.settle()
    assert sorted(map(tuple, store.table().collect())) == [("d1", "p1", "r1"), ("d2", "p2", None)]
    assert not store.folder.below("log").exists()


def workflow(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = labels.join(docs, "doc_id").select(F.col("source").alias("category"), (F.col("quality") == 1).alias("is_correct"))
    return judged, docs.select(F.col("source").alias("category"), F.col("doc_id").alias("source_id"), F.substring("text", 1, 30).alias("question"))


def test_an_iteration_asks_once(spark, folder, tmp_path):
    judged, sources = workflow(spark, folder)
    got = iterate(judged, sources, counting(tmp_path / "n"), Settings(generated=20, target=40, candidates=3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert len(asked(tmp_path / "n")) == len(set(asked(tmp_path / "n"))) > 20


def test_a_loop_that_broke_off_within_a_round_asks_once(spark, folder, tmp_path):
    judged, sources = workflow(spark, folder)
    run = lambda provider: loop("v0", lambda m, k: judged, lambda m, made, k: f"v{k}", sources, provider, f"{tmp_path}/loop", 1, Settings(generated=40, target=20, candidates=3))
    with pytest.raises(PythonException):
        run(counting(tmp_path / "n", breaks=1))
    assert asked(tmp_path / "n")
    assert run(counting(tmp_path / "n")) == "v1"
    assert len(asked(tmp_path / "n")) == len(set(asked(tmp_path / "n")))
