from __future__ import annotations

import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tidemill.sources import json_arrays, readers, sinks

SCHEMA = "id long, text string, list array<struct<a:string>>, deep struct<x:struct<y:string>>"


def schema():
    return T._parse_datatype_string(SCHEMA)


def some_objects(seed: int, n: int) -> list[dict]:
    chance = random.Random(seed)
    signs = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", "x", "\\\"", "𝄞", " "]
    text = lambda: "".join(chance.choice(signs) for _ in range(chance.randrange(30)))
    return [{"id": k, "text": text(), "list": [{"a": text()} for _ in range(chance.randrange(3))], "deep": {"x": {"y": text()}}} for k in range(n)]


def rows_of(df) -> list[tuple]:
    return sorted((r.id, r.text, str(r.list), str(r.deep)) for r in df.collect())


@pytest.mark.parametrize("split", [64, 300, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_equal_to_the_plain_read_for_any_split(spark, tmp_path, split, indent):
    path = f"{tmp_path}/a.json"
    with open(path, "w") as f:
        json.dump(some_objects(split, 120), f, indent=indent, ensure_ascii=False)
    plain = rows_of(spark.read.schema(schema()).option("multiLine", True).json(path))
    with_splits(spark, split)
    try:
        got = readers.json_array(spark, path, schema())
        pieces = json_arrays.fragments(spark, path)
        tasks = pieces.rdd.getNumPartitions()
        assert rows_of(got) == plain and len(plain) == 120
        assert tasks > 3 or split > 1000
    finally:
        with_splits(spark, None)


def with_splits(spark, size: int | None) -> None:
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        if size is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, str(size if "max" in name else 0))


def test_several_files_an_object_over_many_splits_and_scalars(spark, tmp_path):
    (tmp_path / "d").mkdir()
    long = "{}[]\\\"" * 300
    (tmp_path / "d" / "a.json").write_text(" \n[ 1, \"a}{b\", " + json.dumps({"id": 1, "text": long}) + ', null, {"id": 2}, "}"]\n')
    (tmp_path / "d" / "b.json").write_text("[]")
    (tmp_path / "d" / "c.json").write_text('[{"id": 3}]')
    (tmp_path / "d" / "e.json").write_text('{"id": 4}\n{"id": 5, "deep": {"x": {"y": "}"}}}')
    with_splits(spark, 50)
    try:
        got = {r.id: r for r in readers.json_array(spark, f"{tmp_path}/d", schema()).collect()}
    finally:
        with_splits(spark, None)
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1].text == long and got[5].deep.x.y == "}"


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id": 2', '[{"id": 1}, {"id": 2}', '[{"id": 1}, {"text": "a'])
def test_a_file_that_breaks_off_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="ends within"):
        readers.json_array(spark, f"{tmp_path}/a.json", schema())


def test_advance():
    assert json_arrays.advance('[{"a": {', False) == (3, False)
    assert json_arrays.advance('x{", "b": [1]', True) == (0, False)
    assert json_arrays.advance('"open {', False) == (0, True) and json_arrays.advance("{{[", True) == (0, True)
    assert json_arrays.advance('a\\" { " {', True) == (1, False)


def test_a_large_batch_is_not_held_as_objects():
    n = 10_000
    texts = pa.array([f'{{"id": {k}, "text": "{"x" * 2000}"' for k in range(n)])  # 20 MB
    pieces = pa.RecordBatch.from_arrays([pa.array(["a"] * n), pa.array([0] * n), texts], ["path", "start", "value"])
    tracemalloc.start()
    try:
        assert sum(1 for _ in json_arrays._by_split(iter([pieces]))) == n
        assert sum(b.num_rows for b in sinks.array_lines(iter([pieces.select(["value"])]))) == n + 2
        assert tracemalloc.get_traced_memory()[1] < 3_000_000
    finally:
        tracemalloc.stop()


def test_the_array_over_several_batches_is_whole():
    batches = [pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(lo, hi)], pa.string())], ["value"]) for lo, hi in ((0, 0), (0, 250), (250, 251), (251, 251), (251, 400))]
    lines = [x for b in sinks.array_lines(iter(batches)) for x in b.column(0).to_pylist()]
    assert json.loads("\n".join(lines)) == list(range(400))
    assert json.loads("".join(x for b in sinks.array_lines(iter([])) for x in b.column(0).to_pylist())) == []
