"""Chat formatting on the level of tokens, with a loss mask.

A turn is ``<s>`` role ``[INST]`` text ``[/INST]`` ``</s>``: the four marks are
reserved ids, spliced between the ids of role and text, which are encoded
apart. No text can thus yield a mark. So that the written form is as safe, a
control string that occurs in a role or text gets a backslash behind its first
character, and one more where it has some already; reading takes one away.

The loss mask covers the ids of assistant texts: +1 where such a text begins
and -1 behind its end, summed up from the start of a conversation.

Defined results: a null role, text or turn counts as empty, empty and first;
rows of one conversation and turn are ordered by role and text, repeated rows
stay repeated; rows without a conversation id form one conversation; texts of
white space are kept as they are. Conversations are never gathered: their rows
pass a task in order, and only digests in progress are kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import arrow_schema, batch_of, kept, slices

MARKS = ("<s>", "[INST]", "[/INST]", "</s>")
LEARNED = "assistant"
_CONTROL = re.compile("|".join(re.escape(m[0]) + r"(\\*)" + re.escape(m[1:]) for m in MARKS))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


class TokenCodec:
    """Byte-level ids for texts, and reserved ids behind them for the marks."""

    def __init__(self, ranks_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.start, self.text_from, self.text_to, self.end = range(self.first, self.first + 4)

    def ids_of(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(escape(text))

    def text_of(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode()

    def turn(self, role: str, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """The ids of a turn, and where the loss mask goes up and down."""
        head = [self.start, *self.ids_of(role), self.text_from]
        body = self.ids_of(text)
        steps = [(len(head), 1), (len(head) + len(body), -1)] if role == LEARNED else []
        return [*head, *body, self.text_to, self.end], steps

    def written(self, ids: list[int]) -> str:
        """The written form, marks as their strings."""
        out, run = [], []
        for i in ids:
            if i >= self.first:
                out += [self.text_of(run), MARKS[i - self.first]]
                run = []
            else:
                run.append(i)
        return "".join([*out, self.text_of(run)])


def codec(ranks_file: bytes, pattern: str) -> TokenCodec:
    return kept(("codec", hash((ranks_file, pattern))), lambda: TokenCodec(ranks_file, pattern))


def format_turns(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, text with the ids of each turn and the mask's steps within them.

    A conversation's ids are its turns' ids in the order of turn, role and text.
    """
    with open(ranks_path, "rb") as f:
        shared = conversations.sparkSession.sparkContext.broadcast((f.read(), pattern))
    ints = T.ArrayType(T.IntegerType(), False)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", ints, False), T.StructField("mask_at", ints, False), T.StructField("mask_step", ints, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, c = arrow_schema(schema), codec(*shared.value)
        for batch in slices(batches):
            turns = [c.turn(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch_of(target, [*batch.columns, [i for i, _ in turns], [[at for at, _ in s] for _, s in turns], [[d for _, d in s] for _, s in turns]])

    return rows.mapInArrow(run, schema)


class Reader:
    """Reads one conversation back from its stream of ids and mask."""

    def __init__(self, c: TokenCodec):
        self.codec, self.turns, self.digest, self.loss, self.loss_chars, self.chars = c, 0, sha256(), sha256(), 0, 0
        self.mask = 0

    def take(self, ids: np.ndarray, at: np.ndarray, step: np.ndarray) -> None:
        """Some whole turns, one behind the other; the mask runs on from what came before."""
        delta = np.zeros(len(ids) + 1, np.int64)
        np.add.at(delta, at, step)
        mask = self.mask + np.cumsum(delta)
        self.mask = int(mask[-1])
        mask = mask[:-1]
        c, all_ids = self.codec, ids.tolist()
        marks = np.flatnonzero(ids >= c.first)
        for a, b, d, e in marks.reshape(-1, 4).tolist():
            role, text = unescape(c.text_of(all_ids[a + 1 : b])), unescape(c.text_of(all_ids[b + 1 : d]))
            self.turns += 1
            self.digest.update(f"{role}\n{text}\n".encode())
            self.chars += sum(map(len, MARKS)) + len(c.text_of(all_ids[a + 1 : b])) + len(c.text_of(all_ids[b + 1 : d]))
        on = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
        for lo, hi in on.reshape(-1, 2).tolist():
            learned = unescape(c.text_of(all_ids[lo:hi]))
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)

    def row(self, conv_id) -> tuple:
        return conv_id, self.turns, self.digest.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row for each conversation, from the formatted ids and mask alone."""
    with open(ranks_path, "rb") as f:
        shared = formatted.sparkSession.sparkContext.broadcast((f.read(), pattern))
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField("conv_id", formatted.schema["conv_id"].dataType), *(T.StructField(n, t, False) for n, t in (("n_turns", long), ("turns_sha256", string), ("loss_chars", long), ("loss_sha256", string), ("formatted_chars", long)))])
    order = ["conv_id", "turn", "role", "text"]
    ordered = formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "ids", "mask_at", "mask_step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, c = arrow_schema(schema), codec(*shared.value)
        current, reader = None, None
        for batch in slices(batches):
            done = []
            names = batch.column(0).to_pylist()
            lists = [batch.column(k) for k in (1, 2, 3)]
            for k, name in enumerate(names):
                if reader is None or name != current:
                    if reader is not None:
                        done.append(reader.row(current))
                    current, reader = name, Reader(c)
                reader.take(*(np.array(x[k].as_py(), np.int64) for x in lists))
            if done:
                yield batch_of(target, [list(x) for x in zip(*done, strict=True)])
        if reader is not None:
            yield batch_of(target, [[x] for x in reader.row(current)])

    return ordered.mapInArrow(run, schema)


def format_and_read(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    return read_back(format_turns(conversations, ranks_path, pattern), ranks_path, pattern)
