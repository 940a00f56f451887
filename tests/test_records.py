from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemill.functions import images
from tidemill.operators import records


def test_fields_and_turns(spark):
    rows = spark.createDataFrame([("", "q", None), ("p", "q", "i")], "problem string, question string, image string")
    got = records.coalesced(rows, {"text": ["problem", "question", "absent"], "images": ["images", "image"], "none": ["nowhere"]}, "-").collect()
    assert [tuple(r) for r in got] == [("q", "-", "-"), ("p", "i", "-")]
    turns = spark.createDataFrame([([("gpt", "a"), ("human", "b")],), ([],)], "c array<struct<from:string,value:string>>")
    assert [r.q for r in turns.select(records.opening_question(F.col("c")).alias("q")).collect()] == ["b", None]


def test_nested_bytes(spark):
    rows = spark.createDataFrame([((b"a", [b"b"]), 1)], "s struct<x:binary,y:array<binary>>, n int")
    assert records.encoded(rows).first().s == ("YQ==", ["Yg=="])


def test_mini_batches_cover_each_epoch(spark):
    got = records.mini_batches(spark.range(10), "id", 4, epochs=2).collect()
    for epoch in range(2):
        own = [r for r in got if r.epoch == epoch]
        assert sorted(r.id for r in own) == list(range(10)) and sorted(r.batch for r in own) == [0] * 4 + [1] * 4 + [2] * 2


def test_small_tables(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert [tuple(r) for r in records.removed(table, {"k": "a"}).collect()] == [("b", 2)]
    assert sorted(tuple(r) for r in records.updated(table, {"k": "a"}, {"n": 9}).collect()) == [("a", 9), ("b", 2)]


def test_images(spark):
    gate = lambda *v: spark.createDataFrame([v], "w int, h int, b int, s double").select(images.acceptable(F.col("w"), F.col("h"), F.col("b"), F.col("s")).alias("x")).first().x
    assert gate(100, 2000, 30_000, 90.0) and not gate(100, 100, 30_000, 90.0) and not gate(600, 600, 100, 90.0) and not gate(600, 600, 30_000, 10.0)
    flat, edge = np.zeros((5, 5)), np.eye(5)
    assert images.laplacian_variance(flat.ravel(), 5) == 0 < images.laplacian_variance(edge.ravel(), 5)
    row = spark.createDataFrame([(edge.tolist(),)], "p array<array<double>>").select(images.sharpness(F.col("p")).alias("s")).first()
    assert abs(row.s - images.laplacian_variance(edge.ravel(), 5)) < 1e-12
