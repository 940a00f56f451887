"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word one token is the last of that prefix's encoding.
A suffix automaton of the vocabulary yields the tokens that end at a prefix;
the one that fits behind the last token of the prefix before it is kept, and
following these back from the word's end gives the ids that merging gives.

Texts are Spark rows; a Python worker keeps one encoder, a memo of words and
one of pairs, both of bounded size, and drops them for the next operator's.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemill.llm._shared import arrow_schema, batch_of, kept, slices
from tidemill.llm.automaton import ROOT, SuffixAutomaton

#: Bytes, about, of the words whose ids a worker remembers, in each of two generations.
MEMO_BYTES = 16_000_000
#: Pairs of tokens remembered; the memo starts anew beyond that.
PAIR_MEMO = 200_000
#: Words that are encoded at a time, which bounds what a very long text takes.
AT_ONCE = 50_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


#: Characters whose classes and normal forms are the same in all Unicode versions in use.
USUAL = ((0, 0x239), (0x250, 0x2FF), (0x374, 0x52F), (0x2000, 0x208E), (0x20A0, 0x20BF), (0x2190, 0x21FF), (0x3000, 0x302F), (0x3041, 0x3096), (0x30A1, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def ranges(characters: str) -> str:
    """The characters as the inside of a regular expression's class."""
    points, spans = sorted(set(map(ord, characters))), []
    for c in points:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(rf"\U{lo:08x}-\U{hi:08x}" for lo, hi in spans)


class PrefixEncoder:
    """Encodes as the vocabulary file's own merges would, word by word."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.n_tokens = 1 + max([*vocab.values(), *self.special.values()])
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + end] for x in letters]
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            l, r, i = vocab[left], vocab[right], vocab[left + right]
            if max(l, r) >= i or i in self.parts:
                raise ValueError(f"token {i} is not made after its parts, or twice")
            self.parts[i] = (l, r)
            self.merged[l, r] = i
        self._automaton()
        self._splitter(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.spec = {**spec, "model": {**model, "vocab": {}, "merges": []}, "added_tokens": []}
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.control = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_size = 0

    @cached_property
    def library(self) -> Tokenizer:
        """The library's normaliser and splitter alone, made for the first text that needs them."""
        return Tokenizer.from_str(json.dumps(self.spec))

    def _splitter(self, pattern: str) -> None:
        """The file's splitting pattern with its classes spelt out over the usual characters, which makes it quick."""
        usual = [chr(c) for lo, hi in USUAL for c in range(lo, hi + 1)]
        inside = {name: "".join(regex.findall(rf"\p{{{name}}}", "".join(usual))) for name in "LN"}
        space = "".join(regex.findall(r"\s", "".join(usual)))
        spelt = {r"[\p{L}]": f"[{ranges(inside['L'])}]", r"[\p{N}]": f"[{ranges(inside['N'])}]", r"[^\s\p{L}\p{N}]": f"[^{ranges(space + inside['L'] + inside['N'])}]"}
        for general in sorted(spelt, key=len, reverse=True):
            pattern = pattern.replace(general, spelt[general])
        if r"\p" in pattern or r"\s" in pattern:
            raise ValueError(f"a splitting pattern of another kind: {pattern}")
        self.word = re.compile(pattern)
        self.unusual = re.compile(f"[^{ranges(''.join(usual))}]")

    def _automaton(self) -> None:
        symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in [*self.inner, *self.final]}
        for i in sorted(self.parts):
            l, r = self.parts[i]
            symbols[i] = symbols[l] + symbols[r]
        self.sam = SuffixAutomaton()
        self.size = {i: len(x) for i, x in symbols.items()}
        self.token_at = {self.sam.add(x): i for i, x in symbols.items()}
        self.near = self.sam.nearest(self.token_at)

    def _edge(self, token: int, side: int, top: int) -> list[tuple[int, int]]:
        """The tokens at one side of a token, from itself inwards, each with the id of the merge that ends it."""
        found = [(token, top)]
        while token in self.parts:
            found.append((self.parts[token][side], token))
            token = self.parts[token][side]
        return found

    def fits(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether ``left`` and ``right`` stay side by side: no merge over their border comes first.

        A merge of two border tokens happens if it precedes those that end
        them; at equal rank the leftmost goes first. ``before`` limits this
        to merges of a lower id.
        """
        top = before if before is not None else self.n_tokens
        for x, ends_x in self._edge(left, 1, top):
            for y, ends_y in self._edge(right, 0, top):
                m = self.merged.get((x, y))
                if m is not None and m < ends_x and (m <= ends_y if ends_y != top else m < top):
                    return False
        return True

    def whole(self, token: int) -> bool:
        """Whether merging the token's own symbols gives that token."""
        known = self._whole.get(token)
        if known is None:
            known = token not in self.parts or (self.whole(self.parts[token][0]) and self.whole(self.parts[token][1]) and self.fits(*self.parts[token], before=token))
            self._whole[token] = known
        return known

    def _pair(self, left: int, right: int) -> bool:
        known = self._pairs.get(left << 20 | right)
        if known is None:
            if len(self._pairs) >= PAIR_MEMO:
                self._pairs.clear()
            known = self._pairs[left << 20 | right] = self.whole(right) and self.fits(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        go, link, length = self.sam.go, self.sam.link, self.sam.length
        near, size, token_at, pairs = self.near, self.size, self.token_at, self._pairs
        last = [0] * (len(symbols) + 1)
        state = matched = 0
        for i, symbol in enumerate(symbols, 1):
            to = go[state].get(symbol)
            while to is None:  # the root has every symbol
                state = link[state]
                matched = length[state]
                to = go[state].get(symbol)
            state, matched = to, matched + 1
            s = near[state] if matched == length[state] else near[link[state]]
            while s != ROOT:
                token = token_at[s]
                start = i - size[token]
                if start:
                    left = last[start]
                    good = pairs.get(left << 20 | token)
                    if good is None:
                        good = self._pair(left, token)
                else:
                    good = self.whole(token)
                if good:
                    last[i] = token
                    break
                s = near[link[s]]
        ids, i = [], len(symbols)
        while i:
            ids.append(last[i])
            i -= size[last[i]]
        return ids[::-1]

    def _ids_of(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = np.array(self.encode_word(word), "<i4").tobytes()
        if len(word) > 1000:  # would fill the memo and hardly comes again
            return found
        self.memo_size += len(word) + len(found) + 150
        if self.memo_size > MEMO_BYTES:
            self.older, self.memo, self.memo_size = self.memo, {}, len(word) + len(found) + 150
        self.memo[word] = found
        return found

    def _words(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text without special tokens that are encoded apart, so many at a time.

        Where a character's class may differ from one Unicode version to the
        next, the library's own normaliser and splitter decide.
        """
        if self.unusual.search(text):
            text = self.library.normalizer.normalize_str(text)
            yield [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
            return
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if len(text) <= AT_ONCE:
            yield self.word.findall(text)
            return
        pieces = (m[0] for m in self.word.finditer(text))
        while part := list(islice(pieces, AT_ONCE)):
            yield part

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        make = self._ids_of
        for k, piece in enumerate(self.control.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(np.array([self.special[piece]], "<i4").tobytes())
            elif piece:
                for words in self._words(piece):
                    get = self.memo.get
                    found = [get(w) for w in words]
                    out.append(b"".join(found if None not in found else [f or make(w) for f, w in zip(found, words)]))
        return b"".join(out)


class Decoder:
    """Token texts by id, special ones included."""

    def __init__(self, text: str):
        spec = json.loads(text)
        found = [*spec["model"]["vocab"].items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]
        self.tokens = [""] * (1 + max(i for _, i in found))
        for token, i in found:
            self.tokens[i] = token

    def decode(self, ids) -> str:
        """Token texts with a space between, as for a vocabulary file without a decoder; special ones stay."""
        return " ".join(map(self.tokens.__getitem__, ids))


def encoder(spec: str) -> PrefixEncoder:
    return kept(("encoder", hash(spec)), lambda: PrefixEncoder(spec))


def both(spec: str) -> tuple[PrefixEncoder, Decoder]:
    return kept(("encoder and decoder", hash(spec)), lambda: (PrefixEncoder(spec), Decoder(spec)))


def read_spec(tokenizer_path: str) -> str:
    """The vocabulary file's text; it is sent to the tasks once, a few MB whatever the input."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return f.read()


def with_token_ids(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """``keep`` and the ids of each row's whole text; a null or empty text has none.

    Rows are independent: repeated rows come out repeated, an empty table
    stays empty and columns outside ``keep`` and ``text`` are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        enc = encoder(spec.value)
        for batch in slices(batches):
            pieces = [enc.encode(x) if x else b"" for x in batch.column(n).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in pieces)]).astype("i4")
            values = pa.array(np.frombuffer(b"".join(pieces), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(ends), values)
            yield batch_of(target, [*(batch.column(i) for i in range(n)), ids.cast(target.field(n).type)])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def with_decoded(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", keep: list[str] | None = None, out: str = "decoded") -> DataFrame:
    """``keep``, the ids and the text that they decode to."""
    keep = ["doc_id"] if keep is None else keep
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    schema = T.StructType([*(encoded.schema[k] for k in keep), encoded.schema[ids], T.StructField(out, T.StringType(), False)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        decode = kept(("decoder", hash(spec.value)), lambda: Decoder(spec.value)).decode
        for batch in slices(batches, size=1_000_000):
            texts = [decode(x or ()) for x in batch.column(n).to_pylist()]
            yield batch_of(target, [*batch.columns, texts])

    return encoded.select(*keep, ids).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    The digests are of the ids as unsigned 32-bit little-endian integers, and
    of the text that these ids decode to. One pass over the rows does both
    ways, so that a core has one encoder.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)])
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        enc, dec = both(spec.value)
        for batch in slices(batches, size=2_000_000):
            n, a, b = [], [], []
            for x in batch.column(1).to_pylist():
                ids = enc.encode(x) if x else b""
                n.append(len(ids) // 4)
                a.append(sha256(ids).hexdigest())
                b.append(sha256(dec.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield batch_of(target, [batch.column(0), n, a, b])

    return docs.select(doc_id, F.col(text).alias("__text")).mapInArrow(run, schema)


__all__ = ["Decoder", "PrefixEncoder", "encode_and_decode", "encoder", "with_decoded", "with_token_ids"]
