"""WARC archives with a two-level capture index.

Writing: every page becomes a record, compressed by itself, in an archive file
of its task. Of equal payloads that are large enough, the one with the
smallest id is a response and the others revisit it. The captures, keyed by
reversed host and path, are sorted by range; each range is one index file of
compressed blocks, and a sparse directory has the first key, place and size of
every block.

Reading: sorted lookup keys find their index file and block by binary search
in the directory, the block is fetched by a range read, the capture by binary
search in it, and the record by a range read of the archive.

All files lie in a folder that the executors share. A task that is tried again
writes under a new name; only what the attempt that counts has reported is
ever looked up.

Defined results: a null page is empty; a null URL has an empty key; a page
without an id is written, and can't be referred to; rows that repeat an id and
a payload are all responses; records of one key and id are all found.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import arrow_schema, batch_of, materialize, shared_dir, slices
from tidemill.llm.url_rules import host_and_path, reversed_key

#: Payloads below this size are never revisits.
MIN_REVISIT = 100
#: Captures in a block of the index.
BLOCK = 512
LEVEL = 3
#: Bytes that one range read of an archive may fetch for several records.
READ_AHEAD = 4 << 20
#: At least and at most for one task: captures of an index range, bytes of the archives to read.
RANGE_ROWS = (1_000, 500_000)
READ_BYTES = (1 << 20, 32 << 20)
#: Revisits up to which their ids, 100 bytes each, are broadcast.
MAX_SENT = 100_000

CAPTURE = [("key", T.StringType()), ("page_id", T.LongType()), ("file", T.StringType()), ("offset", T.LongType()), ("size", T.LongType())]
CAPTURES = T.StructType([T.StructField(n, t) for n, t in CAPTURE])
DIRECTORY = T.StructType([T.StructField("shard", T.StringType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("blocks", T.BinaryType()), T.StructField("captures", T.LongType())])
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType(), False), T.StructField("payload_digest", T.StringType(), False), T.StructField("record_type", T.StringType(), False), T.StructField("refers_to", T.LongType()), T.StructField("target_uri", T.StringType())])


def capture_key(url: Column) -> Column:
    """Reversed host, path and the rest of the URL, so that a site's captures lie side by side."""
    host, _ = host_and_path(url)
    at = F.locate("://", url)
    rest = F.when(at > 0, F.regexp_replace(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", "")).otherwise(F.coalesce(url, F.lit("")))
    key = F.concat(reversed_key(host), F.lit(")"), rest)
    for c in "%\x00\t\n":  # blocks are lines of fields
        key = F.replace(key, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return key


def sort_name(key: str, page_id: int | None) -> str:
    """The key and then the id, in an order of text that is the order of both."""
    return f"{key}\x00{'-' if page_id is None else format(page_id + (1 << 63), '020d')}"


def record(url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the one referred to, which has its headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_of(urn: str) -> int | None:
    text = urn[len("<urn:page:") : -1]
    return int(text) if text else None


@dataclass
class Store:
    """Reads and writes files by URI, on whatever file system it names."""

    base: str

    def __post_init__(self):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(self.base)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        self.fs.create_dir(os.path.dirname(self.path(name)), recursive=True)
        return self.fs.open_output_stream(self.path(name), compression=None)

    def open(self, name: str):
        return self.fs.open_input_file(self.path(name))


@dataclass
class Archive:
    """Where the files lie, and the directory: a row for each index file."""

    base: str
    directory: DataFrame


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, html as payload, digest and refers_to (the response's id, for revisits).

    Only ids and digests of payloads that occur twice travel; what is left of
    them, a row for each revisit, then meets the pages by id.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", F.sha2("payload", 256).alias("digest"))
    seen = materialize(large, "digests")
    firsts = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = seen.join(firsts, "digest").where("page_id is null or page_id <> first")
    known = again.select("page_id", F.col("digest").alias("of"), F.col("first")).distinct()
    digest = F.sha2("payload", 256)
    known = materialize(known, "revisits")
    few = known.count() <= MAX_SENT  # else payloads travel to their ids
    known = F.broadcast(known) if few else known
    found = rows.withColumn("digest", digest).join(known, rows.page_id.eqNullSafe(known.page_id) & (F.col("digest") == F.col("of")), "left")
    return found.select(rows.page_id, "url", "payload", "digest", F.when(F.octet_length("payload") >= MIN_REVISIT, F.col("first")).alias("refers_to"))


def write_records(classified: DataFrame, base: str) -> DataFrame:
    """Archive files, one for each task, and a capture for each record."""
    rows = classified.select("page_id", "url", capture_key(F.col("url")).alias("key"), "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, store, name, out, at = arrow_schema(CAPTURES), Store(base), f"archive/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in slices(batches, size=16_000_000):
                out = out or store.create(name)
                ids, urls, keys, payloads, digests, refers = (c.to_pylist() for c in batch.columns)
                places = []
                for page_id, url, payload, digest, refers_to in zip(ids, urls, payloads, digests, refers, strict=True):
                    data = gzip_member(record(url, page_id, payload, digest, refers_to))
                    out.write(data)
                    places.append((at, len(data)))
                    at += len(data)
                yield batch_of(target, [keys, ids, [name] * len(ids), [a for a, _ in places], [n for _, n in places]])
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, CAPTURES), "captures")


def parts_of(spark: SparkSession, size: int, least: int, most: int) -> int:
    """Into how many tasks work of this size goes: no more than ``most`` in each, and one for each core if that leaves ``least``."""
    return max(1, -(-size // most), min(spark.sparkContext.defaultParallelism, size // least))


def write_index(captures: DataFrame, base: str) -> DataFrame:
    """Sorted captures in compressed blocks, one file for each range, and the directory."""
    n = parts_of(captures.sparkSession, captures.count(), *RANGE_ROWS)
    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, store, name = arrow_schema(DIRECTORY), Store(base), f"index/{uuid.uuid4().hex}.blocks"
        out, at, total, sparse, lines, last = None, 0, 0, [], [], ""

        def block() -> None:
            nonlocal at
            data = zlib.compress("\n".join("\t".join(x) for x in lines).encode(), 6)
            out.write(data)
            sparse.append((lines[0][0], at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            out = out or store.create(name)
            for key, page_id, file, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = sort_name(key, page_id)
                lines.append((last, file, str(offset), str(size)))
                total += 1
                if len(lines) == BLOCK:
                    block()
        if out is None:
            return
        if lines:
            block()
        out.close()
        yield batch_of(target, [[name], [sparse[0][0]], [last], [pack(sparse)], [total]])

    return materialize(ordered.mapInArrow(run, DIRECTORY), "directory")


def pack(sparse: list[tuple[str, int, int]]) -> bytes:
    return zlib.compress(b"".join(struct.pack("<IQI", len(k := first.encode()), offset, size) + k for first, offset, size in sparse))


def unpack(data: bytes) -> list[tuple[str, int, int]]:
    data, at, out = zlib.decompress(data), 0, []
    while at < len(data):
        n, offset, size = struct.unpack_from("<IQI", data, at)
        at += 16
        out.append((data[at : at + n].decode(), offset, size))
        at += n
    return out


def write(pages: DataFrame) -> Archive:
    """Records, index and directory of all pages, in a new shared folder."""
    base = shared_dir(pages.sparkSession, "warc")
    return Archive(base, write_index(write_records(classify(pages), base), base))


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """The captures of each (key, page_id): file, offset and size; several, if one was captured again.

    The keys are dealt out by range and sorted, so that a task goes through
    few index files, and through each block once. Which file a key lies in is
    searched among the files' first and last keys, a row for each range.
    """
    shards = archive.directory.select("shard", "first", "last", "captures").orderBy("first", "last").collect()
    n = parts_of(keys.sparkSession, sum(r.captures for r in shards), *RANGE_ROWS)
    base, sent = archive.base, keys.sparkSession.sparkContext.broadcast([(r.shard, r["first"], r["last"]) for r in shards])
    wanted = keys.select("key", "page_id").distinct().repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("name", T.StringType())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, files = arrow_schema(schema), sent.value
        lasts = [x[2] for x in files]
        for batch in batches:
            out = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = sort_name(key, page_id)
                k = bisect_left(lasts, name)
                while k < len(files) and files[k][1] <= name:
                    out.append((files[k][0], name))
                    k += 1
            yield batch_of(target, [[s for s, _ in out], [n for _, n in out]])

    routed = wanted.mapInArrow(route, schema)
    # the directory's part for a file goes where the file's keys go
    parts = archive.directory.select("shard", F.lit("").alias("name"), "blocks")
    both = routed.withColumn("blocks", F.lit(None).cast("binary")).unionByName(parts)
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("blocks").isNull(), "name")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, store = arrow_schema(CAPTURES), Store(base)
        shard, sparse, firsts, file, loaded, names, lines = None, [], [], None, -1, [], []
        for batch in batches:
            found = []
            for s, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is not None:
                    if file is not None:
                        file.close()
                    shard, sparse, loaded = s, unpack(data), -1
                    firsts, file = [x[0] for x in sparse], store.open(s)
                    continue
                assert s == shard
                k = max(0, bisect_left(firsts, name) - 1)
                while k < len(firsts) and firsts[k] <= name:
                    if k != loaded:
                        loaded = k
                        lines = [x.split("\t") for x in zlib.decompress(file.read_at(sparse[k][2], sparse[k][1])).decode().split("\n")]
                        names = [x[0] for x in lines]
                    for line in lines[bisect_left(names, name) : bisect_right(names, name)]:
                        found.append((line[0], None, line[1], int(line[2]), int(line[3])))
                    k += 1
            if found:
                yield batch_of(target, [list(x) for x in zip(*found, strict=True)])
        if file is not None:
            file.close()

    return dealt.mapInArrow(search, CAPTURES).drop("page_id")


def read_records(archive: Archive, captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """What the archive has at each capture; neighbours in a file are fetched by one range read."""
    base = archive.base
    schema = T.StructType([*RECORD.fields, *([T.StructField("payload", T.BinaryType())] if with_payload else [])])
    places = materialize(captures.select("file", "offset", "size"), "places")
    total = places.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # stretches of a file, so that a large one is read by many
    stretch = F.floor(F.col("offset") / READ_BYTES[1])
    ordered = places.repartition(parts_of(places.sparkSession, total, *READ_BYTES), "file", stretch).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, store, name, source = arrow_schema(schema), Store(base), None, None
        def rows_of(out: list) -> pa.RecordBatch:
            return batch_of(target, [list(x) for x in zip(*out, strict=True)])

        for batch in slices(batches):
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            out, held, k = [], 0, 0
            while k < len(places):
                file, start, size = places[k]
                end, upto = start + size, k + 1
                while upto < len(places) and places[upto][0] == file and places[upto][1] <= end and places[upto][1] + places[upto][2] - start <= READ_AHEAD:
                    end, upto = max(end, places[upto][1] + places[upto][2]), upto + 1
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open(file)
                data = memoryview(source.read_at(end - start, start))
                for _, offset, n in places[k:upto]:
                    fields, http, payload = parse(zlib.decompress(data[offset - start : offset - start + n], 31))
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{file} is damaged at {offset}")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    row = (page_of(fields["WARC-Record-ID"]), length, digest, fields["WARC-Type"], page_of(fields["WARC-Refers-To"]) if revisit else None, fields.get("WARC-Target-URI"))
                    out.append((*row, payload) if with_payload else row)
                    held += len(payload) if with_payload else 0
                    if held > READ_AHEAD:
                        yield rows_of(out)
                        out, held = [], 0
                k = upto
            if out:
                yield rows_of(out)
        if source is not None:
            source.close()

    return ordered.mapInArrow(run, schema)


def write_and_read(pages: DataFrame) -> DataFrame:
    """Every page's record, looked up in the index and read back."""
    archive = write(pages)
    keys = pages.select(capture_key(F.col("url")).alias("key"), "page_id")
    return read_records(archive, lookup(archive, keys))
