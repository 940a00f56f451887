"""URL rules by a sort-merge range join.

A host's labels, reversed and each ended by a dot, make a key under which a
host and all its subdomains form one interval. URLs are dealt out by ranges of
that key and sorted; a sweep over them and the sorted rules keeps a stack of
the rules whose intervals are open, one inside the other. Of the open rules
whose path begins the URL's path, the longest decides. Up to ``MAX_SENT`` rules
are broadcast; of more, each range of URLs gets those whose intervals overlap it.

Defined results: a null URL, or one without ``://``, has an empty host and
path and no rule; of rules with equal host and path, block wins; of rules of
equal length, the one with the longer host.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import arrow_schema, batch_of, materialize, slices

#: Rules, of 100 bytes or so, up to which all are sent to every range of URLs.
MAX_SENT = 100_000
#: URLs and rules in a range, about, where rules are dealt out, and keys looked at for each border.
RANGE_ROWS, LOOKED_AT = 200_000, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z made small; then to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def reversed_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class RuleSweep:
    """Rules sorted by key; ``best`` takes keys in ascending order."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        paths: dict[str, dict[str, str]] = {}
        for host, path, verdict in rules:
            own = paths.setdefault(key_of(host), {})
            own[path] = "block" if "block" in (verdict, own.get(path)) else verdict
        paths.pop("", None)
        self.host = {key_of(h): h for h, _, _ in rules}
        self.paths = paths
        self.lengths = {k: sorted({len(p) for p in own}, reverse=True) for k, own in paths.items()}
        self.keys = sorted(paths)
        self.stack: list[str] = []
        self.next = 0
        self.last = ""

    def _open(self, key: str) -> None:
        """Close the rules that the key has left, open those that it is in."""
        if key < self.last:
            raise ValueError("keys must come in order")
        self.last = key
        while self.stack and not key.startswith(self.stack[-1]):
            self.stack.pop()
        end = bisect_right(self.keys, key, self.next)
        if end > self.next:
            # of the rules passed over, those still open begin the key
            at = len(self.stack[-1]) if self.stack else 0
            while (at := key.find(".", at) + 1) > 0:
                prefix = key[:at]
                k = bisect_left(self.keys, prefix, self.next, end)
                if k < end and self.keys[k] == prefix and (not self.stack or len(prefix) > len(self.stack[-1])):
                    self.stack.append(prefix)
            self.next = end

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as text, and its verdict."""
        self._open(key)
        found = None
        for k in reversed(self.stack):
            for n in self.lengths[k]:
                p = path[:n]
                if len(p) == n and p in self.paths[k]:
                    rule = self.host[k] + p
                    if found is None or len(rule) > len(found[0]):
                        found = (rule, self.paths[k][p])
                    break
        return found


RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow", max_sent: int = MAX_SENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict of every row.

    ``rules`` has host, path and verdict. Its size is checked: what is within
    ``max_sent`` is broadcast to the sweep, more is dealt out with the URLs.
    """
    wanted = rules.select("host", "path", "verdict").where("host is not null and host <> '' and path is not null and verdict in ('allow', 'block')").distinct()
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path")).withColumn("k", reversed_key(F.col("host")))
    schema = T.StructType([T.StructField(key, urls.schema["id"].dataType), *(T.StructField(c, T.StringType(), c == "rule") for c in ("host", "path", "rule", "verdict"))])
    taken = wanted.limit(max_sent + 1).collect()
    if len(taken) > max_sent:
        return _swept_together(urls, wanted, schema, default, range_rows)
    shared = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in taken])
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = urls.repartitionByRange(n, "k", "path", "id").sortWithinPartitions("k", "path", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, sweep = arrow_schema(schema), RuleSweep(shared.value)
        for batch in slices(batches):
            found = [sweep.best(k, p) for k, p in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch_of(target, [batch.column(0), batch.column(1), batch.column(2), [f and f[0] for f in found], [f[1] if f else default for f in found]])

    return ordered.mapInArrow(run, schema)


def _swept_together(urls: DataFrame, rules: DataFrame, schema: T.StructType, default: str, range_rows: int) -> DataFrame:
    """URLs and rules dealt out by the same ranges of the key; a range's rules come first.

    Borders are taken from a sample of the URLs' keys. A host that is the
    border of several ranges is dealt out among these by a hash of the path.
    A rule goes to all ranges that its host's interval overlaps.
    """
    spark = urls.sparkSession
    urls, rules = materialize(urls, "urls"), materialize(rules.withColumn("k", reversed_key(F.col("host"))), "rules")
    total = urls.count()
    n = max(1, -(-(total + rules.count()) // range_rows))
    sample = sorted(r.k for r in urls.select("k").sample(min(1.0, LOOKED_AT * n / max(1, total)), seed=42).collect())  # some twenty a range
    borders = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    shared = spark.sparkContext.broadcast(borders)
    dealt_schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("is_url", T.BooleanType()), T.StructField("k", T.StringType()), *(urls.schema[c] for c in ("id", "host", "path")), T.StructField("verdict", T.StringType())])

    def of_url(k: str, path: str) -> list[int]:
        low, high = bisect_left(shared.value, k), bisect_right(shared.value, k)
        return [low + crc32(path.encode()) % (high - low + 1)]

    def of_rule(k: str, path: str) -> list[int]:
        return list(range(bisect_left(shared.value, k), bisect_right(shared.value, k + "\U0010ffff") + 1))

    def dealt(parts):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            target = arrow_schema(dealt_schema)
            for batch in slices(batches):
                places = list(map(parts, batch.column("k").to_pylist(), batch.column("path").to_pylist()))
                rows = batch.take(pa.array([i for i, p in enumerate(places) for _ in p], pa.int64()))
                none = pa.nulls(rows.num_rows)
                columns = [rows.column(c) if c in rows.schema.names else none for c in ("k", "id", "host", "path", "verdict")]
                yield batch_of(target, [[x for p in places for x in p], [parts is of_url] * rows.num_rows, *columns])

        return run

    both = urls.mapInArrow(dealt(of_url), dealt_schema).unionByName(rules.mapInArrow(dealt(of_rule), dealt_schema))
    ordered = both.repartition(n, "part").sortWithinPartitions("part", "is_url", "k", "path", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, part, known, sweep = arrow_schema(schema), None, [], None
        for batch in slices(batches):
            out = []
            for at, is_url, k, own, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    part, known, sweep = at, [], None
                if not is_url:
                    known.append((host, path, verdict))
                    continue
                sweep = sweep or RuleSweep(known)
                found = sweep.best(k, path)
                out.append((own, host, path, *(found or (None, default))))
            if out:
                yield batch_of(target, [list(x) for x in zip(*out, strict=True)])

    return ordered.mapInArrow(run, schema)
