from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import bpe, token_counts
from tidemill.llm.automaton import SuffixAutomaton

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.PrefixEncoder(bpe.read_spec(PATH))


def texts() -> list[str]:
    chance = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzaeiouaeiouth'.!123éüñ "
    pieces = ["th", "e", "an", "in", "ly", "aaa", "sch", "ung", "ation", " ", "'ll", "\u00a0", "Σ", "ß", "½"]
    some = ["".join(chance.choice(letters) for _ in range(chance.randint(0, 60))) for _ in range(1500)]
    some += ["".join(chance.choice(pieces) for _ in range(chance.randint(1, 14))) for _ in range(1500)]
    return some + ["<|startoftext|>Hi<|endoftext|>", "<|STARTOFTEXT|>", "ΑΣ ΣΑΣ", "a" * 3000, "ha" * 2000, "İI", "e\u0301\u0323 Ⱥ Ա", "中文字 カタカナ 🙂👍🏽", "\x00\t\x1c\x85", "ﬁ Ａ ² ௧"]


def test_ids_and_text_are_the_librarys(library, own):
    decoder = bpe.Decoder(bpe.read_spec(PATH))
    for text, ref in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True):
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == ref.ids, text
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_letter_of_every_script(library, own):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    cases = [f"a{chr(c)}b {chr(c)}{chr(c)}x" for c in points]
    for text, ref in zip(cases, library.encode_batch(cases, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<i4").tolist() == ref.ids, text


def test_query_digests(spark, library):
    rows = [(1, "Hello World", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello World", "x"), (None, "Grüße " * 500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("n_tokens", F.lit(9))
    got = sorted(map(tuple, bpe.encode_and_decode(docs, PATH).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_and_decode(docs.limit(0), PATH).count() == 0


def test_decoded_column(spark, library):
    docs = spark.createDataFrame([(1, "Round trip")], "doc_id long, text string")
    row = bpe.with_decoded(bpe.with_token_ids(docs, PATH), PATH).first()
    assert row.decoded == library.decode(row.ids, skip_special_tokens=False)


def test_automaton_finds_all_substrings():
    words = ["abcab", "bcb", "aab"]
    sam = SuffixAutomaton(words)
    parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    text = "abcbaabcabxbcab"
    state = length = 0
    for i, c in enumerate(text):
        state, length = sam.step(state, length, c)
        assert length == max([0, *(n for n in range(1, i + 2) if text[i + 1 - n : i + 1] in parts)])


def test_limits_are_exact(spark, library):
    lengths = [0, 3, 3, 5000, 1, 0, 7, 2049, 2048]
    counts = token_counts.histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens int"))
    rows = token_counts.limits(counts).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_from == sum(n >= r.n_tokens for n in lengths)
        assert r.tokens_from == sum(n for n in lengths if n >= r.n_tokens)
        assert r.tokens_cut == sum(min(n, r.n_tokens) for n in lengths)
        assert r.docs_to == sum(n <= r.n_tokens for n in lengths) and r.share_to == r.docs_to / len(lengths)
    assert tuple(token_counts.cut_at(counts, 100).first()) == (sum(min(n, 100) for n in lengths), 3)
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in token_counts.report(docs, PATH).collect()) == [0, 3]
    assert token_counts.report(docs.limit(0), PATH).count() == 0
