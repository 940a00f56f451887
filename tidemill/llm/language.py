"""Language identification with interpolated Kneser-Ney character models.

Spark counts the words of all learning documents for each language, then the
character grams of the distinct words, and makes continuation counts,
discounts, probabilities and back-off weights of them: no gram is left out.
Models of up to ``MAX_CELLS`` are broadcast, in one sorted array of gram hashes
for each order with a column for each language; larger ones stay a table, which
is joined to the grams of the distinct words that are to be scored. The
language with the lowest cross-entropy for each character wins. Temperature
and rejection limit are calibrated on a bounded sample of learning documents.

Defined results: a null text, or one without a letter, is ``und`` with score
0; rows without an id or a language teach nothing; without any learning
document all predictions are ``und`` with score 0.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import arrow_schema, batch_of, hash_sample, join_counted, materialize, release, slices

ORDER = 4
START, END = "\x02", "\x03"
#: Grams times languages, of eight bytes each, up to which the models are collected and broadcast; beyond, they are joined.
MAX_CELLS = 4_000_000
#: Learning documents that calibrate temperature and rejection.
CALIBRATION = 1_500
#: Of these, as many are also scrambled, to see how text of no language scores.
SCRAMBLED = 200
#: Share of the calibration texts, of those whose label is predicted, that the limit for their length lets through.
WITHIN = 0.995
WORD_MEMO = 100_000
_LATIN = re.compile("[^\\W\\d_²³¹¼½¾]+")
_BEYOND = re.compile("[^\x00-ɏ‐-‧]")
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in small letters."""
    return (_LETTERS if _BEYOND.search(text) else _LATIN).findall(text.lower())


def count_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows; tasks count ahead of the shuffle."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        target, counts = arrow_schema(schema), defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for code in list(counts):
                c = counts.pop(code)
                yield batch_of(target, [[code] * len(c), list(c), list(c.values())])

        for batch in slices(batches):
            for code, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[code].update(words_of(t))
            if sum(map(len, counts.values())) > 100_000:
                yield from flush()
        yield from flush()

    return docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): the grams that end at each character of a word and at its end."""
    padded = F.concat(F.lit(START * (order - 1)), F.col("word"), F.lit(END))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(order)))
    return words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A hash of the ``order`` code points that end at each place."""
    h = np.full(len(points), 0xCBF29CE484222325 + order, np.uint64)
    for k in range(order - 1, -1, -1):
        h = (h ^ np.concatenate([np.zeros(k, np.uint64), points[: len(points) - k]])) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def continuations(top: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, n) of all orders: the highest has its counts, each lower one the number of different grams of the next that end in its own."""
    levels = [top.select("lang", F.lit(order).alias("size"), "gram", "n")]
    for size in range(order - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n")).select("lang", F.lit(size).alias("size"), "gram", "n"))
    return reduce(DataFrame.unionByName, levels)


def kneser_ney(counts: DataFrame, base: float, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, p, weight) of all grams and contexts: interpolated probability, and back-off weight as a context.

    ``p`` is null for contexts that are no gram, ``weight`` where nothing
    follows; size 0 is the empty context of each language.
    """
    ones, twos = (F.count(F.when(F.col("n") == k, 1)) for k in (1, 2))
    by_order = counts.groupBy("lang", "size").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("discount"))
    context = F.expr("substring(gram, 1, size - 1)").alias("context")
    seen = counts.groupBy("lang", "size", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(by_order, ["lang", "size"])
    contexts = materialize(seen.withColumn("back", F.col("discount") * F.col("kinds") / F.col("total")), "contexts")
    own = counts.select("*", context).join(contexts, ["lang", "size", "context"]).select("lang", "size", "gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("own"), "back")
    own, lower, levels = materialize(own, "grams"), None, []
    for size in range(1, order + 1):
        level = own.where(F.col("size") == size)
        if lower is None:
            level = level.withColumn("lower", F.lit(base))
        else:
            level = level.withColumn("tail", F.substring("gram", 2, size)).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang", "tail"])
        lower = level.select("lang", "size", "gram", (F.col("own") + F.col("back") * F.col("lower")).alias("p"))
        levels.append(lower.withColumn("weight", F.lit(None).cast("double")))
    weights = contexts.select("lang", (F.col("size") - 1).alias("size"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), F.col("back").alias("weight"))
    return reduce(DataFrame.unionByName, [*levels, weights]).groupBy("lang", "size", "gram").agg(F.max("p").alias("p"), F.max("weight").alias("weight"))


@dataclass
class Judge:
    """Decides on cross-entropies for a character, a column for each language."""

    languages: list[str]
    temperature: float = 0.05
    limit: float = np.inf
    slack: float = 0.0

    def decide(self, entropy: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is like none of the languages."""
        if not self.languages:
            return ["und"] * len(sizes), np.zeros(len(sizes)), np.ones(len(sizes), bool)
        known = sizes > 0
        filled = np.where(known[:, None], entropy, 0.0)
        best = filled.argmin(axis=1)
        low = filled[np.arange(len(best)), best]
        share = 1 / np.exp(-(filled - low[:, None]) / self.temperature).sum(axis=1)
        over = low - self.limit - self.slack / np.sqrt(np.maximum(sizes, 1))
        strange = known & (over > 0)
        score = np.where(known, share * np.exp(-np.maximum(over, 0)), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.clip(score, 0, 1), strange | ~known

    def calibrate(self, texts: list[str], labels: list[str], entropies: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        """Temperature by likelihood; the rejection limit lies midway between these texts and scrambled ones.

        Only texts whose label is predicted count for the limit; without any it stays off.
        """
        number = {x: k for k, x in enumerate(self.languages)}
        entropy, sizes = entropies(texts)
        good = np.flatnonzero((sizes > 0) & np.array([x in number for x in labels], bool))
        if not len(good):
            return
        e, n, true = entropy[good], sizes[good], np.array([number[labels[k]] for k in good])

        def loss(t: float) -> float:
            x = -(e - e.min(axis=1, keepdims=True)) / t
            return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(true)), true]).mean())

        self.temperature = min((0.02 * 1.5**k for k in range(12)), key=loss)
        agree = e.argmin(axis=1) == true  # a wrong label says nothing about its language
        if not agree.any():
            return
        own, n, good = e[np.arange(len(true)), true][agree], n[agree], good[agree]
        long = own[n >= np.median(n)]
        chance = random.Random(0)
        noise = ["".join(chance.sample(t, len(t))) for t in (texts[k] for k in good[n >= np.median(n)][:SCRAMBLED])]
        strange = entropies(noise)[0].min(axis=1)
        near, far = float(np.quantile(long, 0.999)), float(np.nanquantile(strange, 0.01))
        self.limit = near + max(0.0, far - near) / 2
        self.slack = max(0.0, float(np.quantile((own - self.limit) * np.sqrt(n), WITHIN)))


@dataclass
class HashArrays:
    """All languages' models side by side, by order, in sorted hash arrays."""

    n_languages: int
    start: np.ndarray
    keys: list[np.ndarray]
    probability: list[np.ndarray]
    weight: list[np.ndarray]

    @classmethod
    def of(cls, table: pa.Table, languages: list[str], start: np.ndarray, order: int = ORDER) -> HashArrays:
        """From (lang, size, gram, p, weight); ``start`` is what a character has before any gram is known."""
        sizes, number = table["size"].to_numpy(), {x: k for k, x in enumerate(languages)}
        of_lang = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
        names, p, w = np.array(table["gram"].to_pylist(), object), table["p"].to_numpy(), table["weight"].to_numpy()
        keys, probability, weight = [], [], []
        for size in range(1, order + 1):
            at = np.flatnonzero(sizes == size)
            hashes = gram_hashes(points_of("".join(names[at])), size)[size - 1 :: size]
            own, place = np.unique(hashes, return_inverse=True)
            keys.append(own)
            for out, values, none in ((probability, p, 0), (weight, w, 1)):
                cells = np.full((len(own), len(languages)), none, np.float32)
                there = ~np.isnan(values[at])
                cells[place[there], of_lang[at][there]] = values[at][there]
                out.append(cells)
        return cls(len(languages), start, keys, probability, weight)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word, to its end, in each language."""
        points = points_of("".join(f"{START * (ORDER - 1)}{w}{END}" for w in words))
        p = np.tile(self.start, (len(points), 1))
        context = None
        for n, (keys, probability, weight) in enumerate(zip(self.keys, self.probability, self.weight, strict=True), 1):
            h = gram_hashes(points, n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            there = keys[at] == h
            if context is not None:
                p *= context
            own = probability[at]
            p = np.where(there[:, None] & (own > 0), own, p)
            weights = np.where(there[:, None], weight[at], np.float32(1))
            context = np.concatenate([weights[:1], weights[:-1]])
        logs = np.log(p)
        logs[points == ord(START)] = 0
        ends = np.flatnonzero(points == ord(END))
        return np.add.reduceat(logs, np.concatenate(([0], ends[:-1] + 1)), axis=0)

    def cross_entropies(self, texts: list[str], memo: dict[str, int] | None = None, rows: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the cross-entropy for a character in each language (nan without letters) and its number of words."""
        memo, rows = ({}, []) if memo is None else (memo, rows)
        if len(memo) > WORD_MEMO:
            memo.clear()
            rows.clear()
        found = [words_of(t) for t in texts]
        new = list({w for ws in found for w in ws if w not in memo})
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            rows.append(np.column_stack([self.word_scores(part), [len(w) + 1.0 for w in part]]))
            memo.update(zip(part, range(len(memo), len(memo) + len(part)), strict=True))
        sizes = np.array([len(ws) for ws in found])
        sums = np.full((len(texts), self.n_languages + 1), np.nan)
        if rows:
            if len(rows) > 1:
                rows[:] = [np.concatenate(rows)]
            table, get = rows[0], memo.__getitem__
            for k, ws in enumerate(found):  # a text at a time bounds what is gathered
                if ws:
                    sums[k] = table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
        return -sums[:, :-1] / sums[:, -1:], sizes


@dataclass
class LanguageModels:
    """What was learned: ``arrays`` to broadcast, or where these would be too large ``entries``, a table of all grams."""

    judge: Judge
    start: np.ndarray
    arrays: HashArrays | None
    entries: DataFrame | None


def joined_scores(words: DataFrame, entries: DataFrame, languages: list[str], start: np.ndarray) -> DataFrame:
    """(word, logs): the log-probability of each distinct word in each language, by joins with the grams.

    A place in a word has up to four grams that end there and three contexts
    that end before it; each is a row, so that no word is too long.
    """
    of_lang = F.map_from_entries(F.collect_list(F.struct("lang", F.struct("p", "weight"))))
    dense = entries.where("size > 0").groupBy("gram").agg(of_lang.alias("m"))
    side = lambda c: F.transform(F.array(*map(F.lit, languages)), lambda x: F.try_element_at(F.col("m"), x)[c]).alias(c)
    dense = dense.select("gram", side("p"), side("weight"))
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("word"), F.lit(END))
    places = words.select("word", padded.alias("s"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    gram = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.expr(f"substring(s, i + {ORDER - n - kind}, {n})").alias("gram"))
    asked = places.select("word", "i", F.explode(F.array(*(gram(0, n) for n in range(1, ORDER + 1)), *(gram(1, n) for n in range(1, ORDER)))).alias("g")).select("word", "i", "g.*")
    asked = materialize(asked, "asked")
    uses = asked.groupBy("gram").agg(F.count("*").alias("n"))
    found = join_counted(asked, uses.join(dense, "gram"), "gram", asked.count()).withColumn("n", F.length("gram"))
    none = F.lit(None).cast("array<double>")
    every = found.unionByName(places.select("word", "i", F.lit(2).alias("kind"), F.lit("").alias("gram"), none.alias("p"), none.alias("weight"), F.lit(0).alias("n")))
    pick = lambda kind, n, c: F.first(F.when((F.col("kind") == kind) & (F.col("n") == n), F.col(c)), ignorenulls=True).alias(f"{c}{n}")
    at_place = every.groupBy("word", "i").agg(*(pick(0, n, "p") for n in range(1, ORDER + 1)), *(pick(1, n, "weight") for n in range(1, ORDER)))

    def log_p(first: Column, k: Column) -> Column:
        out = first
        for n in range(1, ORDER + 1):
            if n > 1:
                out = out * F.coalesce(F.get(F.col(f"weight{n - 1}"), k), F.lit(1.0))
            own = F.get(F.col(f"p{n}"), k)
            out = F.when(own > 0, own).otherwise(out)
        return F.log(out)

    logs = at_place.select("word", F.posexplode(F.transform(F.array(*(F.lit(float(x)) for x in start)), log_p)).alias("k", "v"))
    return _rows_of(logs.groupBy("word", "k").agg(F.sum("v").alias("v")), "word").withColumnRenamed("values", "logs")


def _rows_of(cells: DataFrame, key: str) -> DataFrame:
    """(key, values) from (key, k, v), in the order of k: one value for each language."""
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("values"))


def joined_entropies(texts: DataFrame, models: LanguageModels) -> DataFrame:
    """(row, entropy, size) of the texts (row, text) that have a letter; as ``HashArrays.cross_entropies``, by joins."""
    schema = T.StructType([texts.schema["row"], T.StructField("word", T.StringType()), T.StructField("times", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in slices(batches, 100):
            found = [(r, w, n) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w, n in Counter(words_of(t or "")).items()]
            for at in range(0, len(found), 10_000):
                yield batch_of(target, [list(x) for x in zip(*found[at : at + 10_000], strict=True)])

    words = materialize(texts.select("row", "text").mapInArrow(run, schema), "words")
    uses = words.groupBy("word").agg(F.count("*").alias("n"))
    scores = materialize(joined_scores(uses.select("word"), models.entries, models.judge.languages, models.start), "scores")
    hits = join_counted(words, scores.join(uses, "word"), "word", words.count())
    cells = hits.select("row", "times", F.length("word").alias("long"), F.posexplode("logs").alias("k", "log"))
    sums = cells.groupBy("row", "k").agg(F.sum(F.col("times") * F.col("log")).alias("log"), F.sum(F.col("times") * (F.col("long") + 1)).alias("chars"), F.sum("times").alias("size"))
    sizes = sums.where("k = 0").select("row", "size")
    return _rows_of(sums.select("row", "k", (-F.col("log") / F.col("chars")).alias("v")), "row").withColumnRenamed("values", "entropy").join(sizes, "row")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", order_by: str = "doc_id", max_cells: int = MAX_CELLS) -> LanguageModels:
    """Models from all rows with a text and a language."""
    spark = docs.sparkSession
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    words = materialize(count_words(usable, text, lang), "words")
    counts = materialize(continuations(materialize(count_grams(words), "grams")), "counts")
    alphabet = counts.where("size = 1").select("gram").distinct().count()
    base = 1.0 / (alphabet + 1)
    entries = materialize(kneser_ney(counts, base), "entries")
    empty = {r.lang: r.weight for r in entries.where("size = 0").collect()}  # a row for each language
    languages = sorted(empty)
    start = base * np.array([empty[x] for x in languages])
    judge = Judge(languages)
    if not languages:
        return LanguageModels(judge, start, None, None)
    grams = entries.where("size > 0").select("gram").distinct().count()
    if grams * len(languages) <= max_cells:
        arrays = HashArrays.of(entries.where("size > 0").toArrow(), languages, start)
        models = LanguageModels(judge, start, arrays, None)
        entropies = arrays.cross_entropies
    else:
        models = LanguageModels(judge, start, None, entries)

        def entropies(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = {r.row: r for r in joined_entropies(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), models).collect()}
            none = [np.nan] * len(languages)
            return np.array([found[k].entropy if k in found else none for k in range(len(texts))]).reshape(-1, len(languages)), np.array([found[k]["size"] if k in found else 0 for k in range(len(texts))])

    sample = hash_sample(usable.select(order_by, F.col(text).alias("t"), F.col(lang).alias("l")), order_by, CALIBRATION).collect()
    judge.calibrate([r.t for r in sample], [r.l for r in sample], entropies)
    return models


PREDICTED = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("rejected", T.BooleanType(), False)]


def predict(docs: DataFrame, models: LanguageModels, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` with lang_pred, score and rejected."""
    keep = ["doc_id"] if keep is None else keep
    if models.entries is not None:
        return _predict_joined(docs, models, text, keep)
    schema = T.StructType([docs.schema[k] for k in keep] + PREDICTED)
    shared, n = docs.sparkSession.sparkContext.broadcast((models.judge, models.arrays)), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        target, (judge, arrays), memo, rows = arrow_schema(schema), shared.value, {}, []
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(n).to_pylist()]
            entropy, sizes = arrays.cross_entropies(texts, memo, rows) if judge.languages else (None, np.zeros(len(texts)))
            names, score, strange = judge.decide(entropy, sizes)
            yield batch_of(target, [*(batch.column(i) for i in range(n)), names, pa.array(score), pa.array(strange)])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _predict_joined(docs: DataFrame, models: LanguageModels, text: str, keep: list[str]) -> DataFrame:
    """As ``predict``, for models of any size. The rows' numbers are written down before anything is joined by them."""
    rows = materialize(docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "rows")
    found = rows.select("row", "kept").join(joined_entropies(rows, models), "row", "left").select("kept", "entropy", "size")
    schema, judge = T.StructType([found.schema["kept"], *PREDICTED]), models.judge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, none = arrow_schema(schema), [np.nan] * len(judge.languages)
        for batch in slices(batches):
            entropy = np.array([e or none for e in batch.column(1).to_pylist()], float).reshape(batch.num_rows, -1)
            names, score, strange = judge.decide(entropy, np.array([k or 0 for k in batch.column(2).to_pylist()]))
            yield batch_of(target, [batch.column(0), names, pa.array(score), pa.array(strange)])

    return found.mapInArrow(run, schema).select(*(F.col("kept")[k].alias(k) for k in keep), *(f.name for f in PREDICTED))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected; learned from the documents that are not held out."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    models = learn(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(rows, models, keep=["doc_id", "held_out"])


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in a language that the others with a label teach; letterless ones and those like no language go."""
    models = learn(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), text, lang)
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__own"))
    return predict(whole, models, "__own", ["__row"]).where(~F.col("rejected")).select("__row.*")
