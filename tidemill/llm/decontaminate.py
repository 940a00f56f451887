"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds the items' normalised words. A document's words run
through it; wherever the longest match reaches a window (13 words, or a whole
shorter item), the matched words are hit.

Defined results: a null or empty text has no words, no hits and is clean; an
item without words never occurs; repeated rows and repeated items count each
for itself, but an item id once; an item whose id is null hits words and
stands in lists of ids as the empty string.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import arrow_schema, batch_of, kept, materialize, slices, utf8
from tidemill.llm.automaton import ROOT, SuffixAutomaton

WINDOW = 13
#: Bytes of item texts that one automaton holds; more items go through the documents in further passes.
ITEM_BYTES = 4 << 20
#: Automata in one pass, of which each core holds as many.
CHAIN = 4
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
FOUND = [T.StructField("n_words", T.LongType(), False), T.StructField("n_hit", T.LongType(), False), T.StructField("spans", SPANS, False), T.StructField("items", T.ArrayType(T.StringType(), False), False), T.StructField("clean", T.BinaryType())]


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; A-Z become small."""
    return _WORD.findall(text.lower())


class ItemMatcher:
    """Longest matches of documents against the items, and the windows within them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.sam = SuffixAutomaton()
        texts = [(i, [self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)]) for i, t in items]
        texts = [(i, x) for i, x in texts if x]
        ends = [self.sam.add(x) for _, x in texts]
        self.shortest = min([window, *(len(x) for _, x in texts)])
        #: Items by the state of a whole short item, and by the state that holds a full window.
        self.short: dict[int, set[str]] = {}
        self.full: dict[int, set[str]] = {}
        for (item, x), end in zip(texts, ends, strict=True):
            if len(x) < window:
                self.short.setdefault(end, set()).add(item)
                continue
            state = length = 0
            for symbol in x:
                state, length = self.sam.step(state, length, symbol)
                if length >= window:
                    self.full.setdefault(self._of_window(state), set()).add(item)
        self.near = self.sam.nearest(self.short)

    def _of_window(self, state: int) -> int:
        """The state on the suffix path that holds the string of one window."""
        link, length = self.sam.link, self.sam.length
        while length[link[state]] >= self.window:
            state = link[state]
        return state

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, spans of hit words (start, end), and the items with occurring windows."""
        words = words_of(text)
        items: set[str] = set()
        if len(words) < self.shortest:
            return len(words), [], items
        numbers = np.fromiter(map(self.number.get, words, [0] * len(words)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        gaps = np.concatenate(([-1], np.flatnonzero(numbers == 0), [len(words)]))  # no match goes over an unknown word
        for k in np.flatnonzero(np.diff(gaps) > self.shortest).tolist():
            first = int(gaps[k]) + 1
            self._run(numbers[first : int(gaps[k + 1])].tolist(), first, spans, items)
        return len(words), spans, items

    def _run(self, numbers: list[int], first: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        sam, step, window = self.sam, self.sam.step, self.window
        state = length = 0
        for i, symbol in enumerate(numbers, first):
            state, length = step(state, length, symbol)
            reach = 0
            if length >= window:
                reach = length
                items |= self.full[self._of_window(state)]
            s = self.near[state] if length == sam.length[state] else self.near[max(sam.link[state], ROOT)]
            while s != ROOT:
                reach = max(reach, sam.length[s])
                items |= self.short[s]
                s = self.near[sam.link[s]]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))


def matcher(name: str, items: list[tuple[str, bytes]], window: int) -> ItemMatcher:
    """The automaton of a block of items, built once for each Python worker, which keeps the last one."""
    return kept(("matcher", name), lambda: ItemMatcher(items, window))


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, in blocks that are small enough for one automaton each."""
    chosen = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), utf8(text).alias("t")).where("t is not null")
    total = chosen.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    for k in range(n):
        yield [(r.i, bytes(r.t)) for r in chosen.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """``keep`` with n_words, n_hit, the spans of hit words, the sorted ids of
    the items found, and the text without the spans (null if there are none).

    The items' size is checked. Up to ``block_bytes`` they are broadcast; with
    more, the rows pass through one automaton for each block of items, and are
    written down after every ``CHAIN`` of them, whose broadcasts then go.
    """
    keep = ["doc_id"] if keep is None else keep
    sc = docs.sparkSession.sparkContext
    rows = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), utf8(text).alias("text"))
    carried = T.StructType([*rows.schema.fields, *FOUND])

    def passing(shared, previous: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            target, found_by = arrow_schema(carried), matcher(*shared.value)
            n = len(keep) + 1
            for batch in slices(batches):
                texts = batch.column(n - 1).to_pylist()
                found = [found_by.find(t or b"") for t in texts]
                before = zip(batch.column(n + 2).to_pylist(), batch.column(n + 3).to_pylist(), strict=True) if previous else None
                if before is not None:
                    found = [(w, merged([(x["start"], x["end"]) for x in s] + spans), ids | set(i)) for (w, spans, ids), (s, i) in zip(found, before, strict=True)]
                yield batch_of(target, [*(batch.column(i) for i in range(n)), [w for w, _, _ in found], [sum(e - s for s, e in spans) for _, spans, _ in found], [[{"start": s, "end": e} for s, e in spans] for _, spans, _ in found], [sorted(ids) for _, _, ids in found], [without(t, spans) if spans else None for t, (_, spans, _) in zip(texts, found, strict=True)]])

        return run

    sent = []
    for k, block in enumerate(_blocks(items, item_id, item_text, block_bytes)):
        if len(sent) == CHAIN:
            rows = materialize(rows, "found")
            while sent:
                sent.pop().destroy()
        sent.append(sc.broadcast((uuid.uuid4().hex, block, window)))
        rows = rows.mapInArrow(passing(sent[-1], k > 0), carried)
    return rows.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), "n_words", "n_hit", "spans", "items", "clean")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    """Hit at all, and by at least one word in ``one_in``."""
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = find_items(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    at, out = 0, []
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", one_in: int = 20) -> DataFrame:
    """The documents without benchmark passages, in their own columns.

    Where hit words make up one in ``one_in`` or more, the document goes; from
    the others the spans that match a window are cut. Documents without a hit
    stay as they are.
    """
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__own"))
    found = find_items(whole, items, "__own", ["__row"])
    kept = found.where(~is_contaminated(F.col("n_hit"), F.col("n_words"), one_in))
    cut = F.coalesce(F.col("clean").cast("string"), F.col("__row")[text])
    return kept.select(*(cut.alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns))
