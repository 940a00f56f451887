from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.operators.quota import FLEXIBLE
from tidemill.sources import readers, sinks
from tidemill.streaming.quota_stream import admit_stream, counts_so_far, run_until_full, write_outcomes


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "question": "q"}, {"id": "2"}]))
    assert readers.json_array(spark, str(tmp_path / "a.json"), schemas.SOURCE_SAMPLE).count() == 2
    (tmp_path / "l.jsonl").write_text('{"id": "1"}\n{"id": \n\n{"id": "3"}\n')
    good, bad = readers.json_lines_tolerant(spark, str(tmp_path / "l.jsonl"), schemas.SOURCE_SAMPLE)
    assert sorted(r.id for r in good.collect()) == ["1", "3"] and bad.count() == 1
    union = readers.union_of_readable(spark, [str(tmp_path / "a.json"), str(tmp_path / "none.json")], schemas.SOURCE_SAMPLE)
    assert union.count() == 2
    (tmp_path / "w.json").write_text('{"chart": 0.5}')
    (tmp_path / "x.json").write_text("[1]")
    assert [tuple(r) for r in readers.weights_or_none(spark, str(tmp_path / "w.json")).collect()] == [("chart", 0.5)]
    assert readers.weights_or_none(spark, str(tmp_path / "x.json")) is None
    assert readers.text_or_file(spark, str(tmp_path / "w.json")) == '{"chart": 0.5}'
    assert readers.text_or_file(spark, "plain words") == "plain words"


def test_parquet_sources(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/d/train-{k}")
    rows = readers.parquet_in_name_order(spark, f"{tmp_path}/d/train-0", 4)
    assert [r.id for r in rows.collect()] == [0, 1, 2, 3]
    spark.range(100, 130).repartitionByRange(3, "id").write.parquet(f"{tmp_path}/many")
    for n in (0, 1, 10, 11, 25, 99):
        got = [(r.id, r.file_name) for r in readers.parquet_in_name_order(spark, f"{tmp_path}/many", n).collect()]
        assert [i for i, _ in got] == list(range(100, min(130, 100 + n)))
    assert readers.one_file(spark, f"{tmp_path}/d/train-1").count() == 10
    assert readers.dataset(spark, f"{tmp_path}/d@train-2").count() == 10
    assert readers.seeded_sample(spark.range(100), "id", 7).collect() == readers.seeded_sample(spark.range(100).repartition(5), "id", 7).collect()
    assert readers.latest_file(spark, f"{tmp_path}/d/train-1").endswith(".parquet")


def test_log_and_checkpoints(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "sample_index long, question string")
    sinks.append_log(rows.limit(1), f"{tmp_path}/log", True)
    sinks.append_log(rows.where("sample_index = 2"), f"{tmp_path}/log", False, "broken")
    log = spark.read.json(f"{tmp_path}/log")
    assert log.count() == 2 and log.where("_meta.success").count() == 1
    sinks.finalize_log(log, f"{tmp_path}/final")
    assert [r.question for r in spark.read.json(f"{tmp_path}/final").collect()] == ["a"]
    listed = spark.createDataFrame([(k, f"p{k}") for k in range(5)], "step long, path string")
    assert sorted(r.step for r in sinks.checkpoints_to_drop(listed, 3).collect()) == [0, 1, 2]
    metrics = spark.createDataFrame([(1, "loss", 0.5)], "step long, name string, value double")
    sinks.append_metrics(metrics, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 1
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "line_no long, line string")
    assert sinks.report_text(lines) == "a\nb"
    sinks.write_report(lines, f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report", wholetext=True).first().value == "a\nb\n"
    sinks.finalize_log(log, f"{tmp_path}/one", all_rows=True, one_file=True)
    assert len([f for f in (tmp_path / "one").iterdir() if f.name.startswith("part-")]) == 1
    sinks.to_sinks(metrics, lambda m: sinks.append_metrics(m, f"{tmp_path}/m1"), lambda m: sinks.write_json(m, f"{tmp_path}/m2"))
    assert spark.read.parquet(f"{tmp_path}/m1").count() == spark.read.json(f"{tmp_path}/m2").count() == 1


def test_stream_admits_as_one_batch_would_and_resumes(spark, tmp_path):
    schema = "arrival long, category string"
    quotas = {"a": 7, FLEXIBLE: 4}
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")

    def feed(k: int) -> None:
        spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("arrival"), F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 3 == 0, "b").otherwise("c").alias("category")).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    for part in ((0, 1), (2,)):
        for k in part:
            feed(k)
        query = write_outcomes(admit_stream(source, quotas), f"{tmp_path}/ok", f"{tmp_path}/no", f"{tmp_path}/checkpoint")
        query.awaitTermination(120)
    kept = spark.read.json(f"{tmp_path}/ok")
    assert kept.where("category = 'a'").count() == 7 and kept.where("category <> 'a'").count() == 4
    assert sorted(r.arrival for r in kept.where("category = 'a'").collect()) == list(range(0, 14, 2))
    rejected = spark.read.json(f"{tmp_path}/no")
    assert rejected.count() == 30 - 11 and rejected.where("error is null").count() == 0
    assert {r.category: r["count"] for r in counts_so_far(spark, f"{tmp_path}/checkpoint").collect()} == quotas
    # full quotas end the stream before all is read
    for k in (3, 4, 5, 6):
        feed(k)
    assert run_until_full(admit_stream(source, quotas), f"{tmp_path}/ok", f"{tmp_path}/no", f"{tmp_path}/checkpoint", pause=0.2)
    assert spark.read.json(f"{tmp_path}/ok").count() == 11
