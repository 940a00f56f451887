"""Secrets in texts: an Aho-Corasick pass names places, patterns anchored there decide, and embedded checksums settle the rest.

One automaton runs over a folded view of a text, in which letters are lower
case and every hexadecimal digit is ``0``. That lets one pass find the folded
keywords of all kinds and runs of hexadecimal digits as well; a hit is no more
than a place at which the pattern of its kind is then tried on the text itself.

Kinds ``assign``, ``access`` and ``hex`` are judged by their pattern and length,
``github`` and ``npm`` by the checksum that these tokens carry: their last six
characters are the CRC-32 of the 30 before, in base 62.

Defined results: a null or empty text has no secrets; a text of any length is
scanned whole, in memory in proportion to it; rows are judged one by one, so
that repeated rows and rows without an id come out as often as they came;
columns of any name are left alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import arrow_schema, batch_of, kept, release, slices, utf8

KINDS = ["assign", "access", "hex", "github", "npm"]
BASE = 3
#: Keywords at which a kind's pattern is tried.
KEYWORDS = {
    "assign": [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"],
    "access": [b"AKIA"],
    "hex": [b"0" * 24],
    "github": [b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"],
    "npm": [b"npm_"],
}
#: The patterns, in ASCII.
PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[oprsu]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(ord("0") if chr(c).lower() in "0123456789abcdef" and c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_LATER = bytes(range(0x80, 0xC0))  # bytes of a character after its first


def checksum(body: bytes) -> bytes:
    """The six characters of base 62 that close a token with this body."""
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit : digit + 1] + out
    return out


def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[tuple[int, int]]] = {}
    for kind, words in KEYWORDS.items():
        for word in words:
            found.setdefault(word.translate(_FOLD).decode("latin-1"), []).append((KINDS.index(kind), len(word)))
    made = ahocorasick.Automaton()
    for word, places in found.items():
        made.add_word(word, tuple(places))
    made.make_automaton()
    return made


def _good(kind: str, match: re.Match) -> bool:
    if kind in LEAST:
        return len(match[match.lastindex or 0]) >= LEAST[kind]
    return checksum(match[1][:30]) == match[1][30:]


def find(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in bytes, in that order.

    Of each kind the leftmost matches that don't overlap, and of these the good
    ones: a match that fails still covers its place.
    """
    view = text.translate(_FOLD).decode("latin-1")
    done, spans = [0] * len(KINDS), []
    for last, places in kept(("secrets",), _automaton).iter(view):
        for k, size in places:
            start = last + 1 - size
            if start < done[k]:
                continue
            kind = KINDS[k]
            match = PATTERNS[kind].match(text, start)
            if match is None:
                continue
            # a short run of hexadecimal digits ends before a character that no other can hold
            done[k] = match.end()
            if _good(kind, match):
                spans.append((start, k, match.end()))
    return sorted(spans)


def characters(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points instead of bytes."""
    edges = sorted({e for s, _, t in spans for e in (s, t)})
    place, at, before = {}, 0, 0
    for e in edges:
        before += len(text[at:e].translate(None, _LATER))
        place[e], at = before, e
    return [(place[s], k, place[t]) for s, k, t in spans]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{t}" for s, k, t in spans)


def _each(docs: DataFrame, text: str, keep: list[str], fields: list[T.StructField], row) -> DataFrame:
    """``keep`` and what ``row`` makes of each text."""
    schema = T.StructType([docs.schema[k] for k in keep] + fields)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        target = arrow_schema(schema)
        for batch in slices(batches):
            found = [row(t.as_py()) for t in batch.column(n)]
            yield batch_of(target, [*(batch.column(i) for i in range(n)), *(list(x) for x in zip(*found, strict=True))])

    return docs.select(*keep, utf8(text).alias("__text")).mapInArrow(run, schema)


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, how many spans of each base kind, their digest, and all spans."""

    def row(value: bytes | None) -> tuple:
        spans = characters(value or b"", find(value or b""))
        base = [s for s in spans if s[1] < BASE]
        return *(sum(s[1] == k for s in base) for k in range(BASE)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)

    fields = [T.StructField(f"n_{k}", T.LongType(), False) for k in KINDS[:BASE]] + [T.StructField(c, T.StringType(), False) for c in ("base_sha256", "spans")]
    return _each(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], fields, row)


def secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each secret: doc_id, kind, start and end in code points, and the secret itself."""
    each = "array<struct<kind: string, start: long, end: long, secret: string>>"

    def row(value: bytes | None) -> tuple:
        value = value or b""
        spans = find(value)
        return ([{"kind": KINDS[k], "start": a, "end": b, "secret": value[s:t].decode("utf-8", "replace")} for (s, k, t), (a, _, b) in zip(spans, characters(value, spans), strict=True)],)

    found = _each(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], [T.StructField("found", T._parse_datatype_string(each), False)], row)
    return found.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents in their own columns, each secret replaced by its kind in brackets; spans that overlap are one, named by the first."""

    def row(value: bytes | None) -> tuple:
        if value is None:
            return (None,)
        out, at = [], 0
        for s, k, t in find(value):
            if s >= at:
                out += [value[at:s], b"[%s]" % KINDS[k].encode()]
            at = max(at, t)
        return ("".join(x.decode("utf-8", "replace") for x in [*out, value[at:]]),)

    others = [c for c in docs.columns if c != text]
    return _each(docs, text, others, [T.StructField(text, T.StringType(), True)], row).select(*docs.columns)
