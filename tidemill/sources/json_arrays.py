"""Files that are one JSON array, read by many tasks.

Spark splits a text file at any byte that ends a line, and here a line ends at
each closing brace. Whether such a brace closes an object depends on what is
before it: on how deep it lies and on whether it lies within a string. So a
first pass works out, for every split, what it does to either state; these
steps are put together in the order of the splits, and a second pass then cuts
each split from the state that it really begins in. What an object has in
several splits is put together at last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)
_SIGN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{\[\]"]', re.DOTALL)
#: Pieces of a batch that Python has as objects at once.
AT_ONCE = 100
STEPS = "path string, start long, bytes long, opener string, " + ", ".join(f"depth{k} long, least{k} long, inside{k} boolean" for k in (0, 1))
STATES = "path string, start long, base long, depth long, inside boolean, owner long"


def fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, value): the pieces between closing braces, those of a split in order."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value", F.col("_metadata.file_size").alias("size"))


def advance(text: str, inside: bool) -> tuple[int, bool]:
    """How much deeper it is after this text, which has no closing brace outside of strings, and whether it ends within one."""
    at = 0
    if inside:
        rest = _REST.match(text)
        if rest is None:
            return 0, True
        at = rest.end()
    plain = _STRING.sub("", text[at:])
    opened = plain.find('"')
    if opened >= 0:
        plain = plain[:opened]
    return plain.count("{") + plain.count("[") - plain.count("]"), opened >= 0


@dataclass
class Step:
    """What a split does, from outside a string (0) and from within one (1)."""

    bytes: int = 0
    opener: str | None = None
    depth: list[int] = field(default_factory=lambda: [0, 0])
    least: list[int] = field(default_factory=lambda: [0, 0])
    inside: list[bool] = field(default_factory=lambda: [False, True])

    def add(self, value: str) -> None:
        self.bytes += len(value.encode()) + 1
        self.opener = self.opener or next(iter(value.strip("﻿ \t\r\n")[:1]), None)
        for k in (0, 1):
            deeper, self.inside[k] = advance(value, self.inside[k])
            self.depth[k] += deeper - (not self.inside[k])  # and the brace itself
            self.least[k] = min(self.least[k], self.depth[k])


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):  # a batch may be 10,000 long pieces
            columns = [c.to_pylist() for c in batch.slice(at, AT_ONCE).columns]
            for path, start, value, *more in zip(*columns, strict=True):
                yield (path, start, *more), value


def steps(pieces: DataFrame) -> DataFrame:
    """A row for each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Step] = {}
        for name, value in _by_split(batches):
            found.setdefault(name, Step()).add(value)
        rows = [(*name, s.bytes, s.opener, *(x for k in (0, 1) for x in (s.depth[k], s.least[k], s.inside[k]))) for name, s in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = T._parse_datatype_string(STEPS)
    names = schema.names
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in schema]
    return pieces.select("path", "start", "value").mapInArrow(run, schema)


def states(rows: list, sizes: dict[str, int]) -> list[tuple]:
    """(path, start, base, depth, inside, owner) at the beginning of every split; ``owner`` is the split in which the object began that is open there."""
    out, at = [], 0
    rows = sorted(rows, key=lambda r: (r.path, r.start))
    while at < len(rows):
        path, total = rows[at].path, 0
        base = 0 if next((r.opener for r in rows[at:] if r.path == path and r.opener), "[") == "{" else 1
        depth, inside, owner = 0, False, None
        while at < len(rows) and rows[at].path == path:
            r = rows[at]
            out.append((path, r.start, base, depth, inside, owner))
            k = int(inside)
            back = depth <= base or depth + r[f"least{k}"] <= base
            depth, inside, total = depth + r[f"depth{k}"], r[f"inside{k}"], total + r.bytes
            owner = (r.start if back else owner) if depth > base else None
            at += 1
        if total > sizes[path] and not inside:
            depth += 1  # the last piece ends with the file, not with a brace
        if depth or inside:
            raise ValueError(f"{path} ends within a value")
    return out


class Cutter:
    """Cuts a split into objects, from the state it begins in."""

    def __init__(self, base: int, depth: int, inside: bool):
        self.base, self.depth, self.inside = base, depth, inside
        self.open, self.whole = [] if depth > base else None, depth <= base

    def add(self, value: str) -> tuple[bool, str] | None:
        """An object that ends with this piece, and whether it began in this split."""
        if self.open is None:
            start = None
            if self.inside:  # a string among the elements
                rest = _REST.match(value)
                if rest is None:
                    return None
                value, self.inside = value[rest.end() :], False
            for sign in _SIGN.finditer(value):
                if sign[0] == "{" and self.depth == self.base:
                    start = sign.start()
                    break
                if sign[0] in "{[]":
                    self.depth += 1 if sign[0] != "]" else -1
                elif sign[0] == '"':
                    self.inside = True
                    break
            if start is None:
                self.depth -= not self.inside
                return None
            self.open, value = [], value[start:]
        deeper, self.inside = advance(value, self.inside)
        self.depth += deeper - (not self.inside)
        self.open += [value, "}"]
        if self.depth != self.base or self.inside:
            return None
        text, whole = "".join(self.open), self.whole
        self.open, self.whole = None, True
        return whole, text


def objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text): every object of the arrays as JSON; for files without an array, those that follow each other."""
    pieces = fragments(spark, path)
    found = steps(pieces).collect()  # a row for each split
    sizes = {r.path: r.size for r in pieces.select("path", "size").distinct().collect()} if found else {}
    known = spark.createDataFrame(states(found, sizes), STATES)
    marked = pieces.select("path", "start", "value").join(F.broadcast(known), ["path", "start"]).select("path", "start", "value", "base", "depth", "inside", "owner")
    schema = T._parse_datatype_string("path string, owner long, part long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, cutter, size = [], None, None, 0

        def close() -> None:
            if cutter is not None and cutter.open:  # goes on in the next split
                path, start, *_, owner = now
                rows.append((path, start if cutter.whole else owner, start, "".join(cutter.open)))

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], schema.names)
            rows.clear()
            return batch

        for name, value in _by_split(batches):
            if name != now:
                close()
                now, cutter = name, Cutter(*name[2:5])
            done = cutter.add(value)
            if done is not None:
                whole, text = done
                rows.append((name[0], None if whole else name[5], name[1], text))
                size += len(text)
            if len(rows) >= 1000 or size > 4_000_000:
                if rows:
                    yield out()
                size = 0
        close()
        if rows:
            yield out()

    cut = marked.mapInArrow(run, schema)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    joined = cut.where("owner is not null").groupBy("path", "owner").agg(F.array_join(parts, "").alias("text"))  # of an object over several splits
    return cut.where("owner is null").select("text").unionByName(joined.select("text"))


def json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The objects of files that are one JSON array of objects each. A file that ends within a value is an error; numbers and strings among the elements are passed over."""
    return objects(spark, path).select(F.from_json("text", schema).alias("r")).select(*(F.col("r")[f.name].alias(f.name) for f in schema.fields))
