"""Quality rules: text statistics and a decision list learned from labelled documents.

Everything over the documents is made of DataFrame functions. Sequential
covering grows one conjunction of thresholds after another on two thirds of a
bounded labelled sample, prunes it on the rest, keeps it if it is precise on
both, and goes on with the documents that no rule covers yet. The list becomes
one ordered conditional expression.

Defined results: a null or empty text has no words, fails the base rule and
is not kept; labels without a document, a quality or an id teach nothing, and
of repeated labels the lowest counts; without labels the list is empty and the
base rule decides alone. Repeated documents are judged one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm._shared import hash_sample, materialize

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Labelled documents that the list is learned from: a sample by hash of the id.
MAX_LABELLED = 8_000
#: Candidate thresholds for each statistic.
THRESHOLDS = 40
MAX_RULES, MAX_CONDITIONS = 12, 3
MIN_PRECISION, MIN_COVERED = 0.97, 8
SPACE = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once for the row."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def n_repeat_words(words: Column) -> Column:
    """Words within windows that occur twice or more in the text, the first occurrence included."""

    def covered(places: Column) -> Column:
        """Words below the windows at these sorted places."""
        step = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"])), covered))

    def hashes(each: Column) -> Column:
        """Of every window, from the hashes of its words: each step doubles the length."""
        double = lambda h, k: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + k)))
        return F.slice(let(let(double(each, 1), lambda h: double(h, 2)), lambda h: double(h, 4)), 1, F.size(each) - (WINDOW - 1))

    of_words = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(let(of_words, hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def statistics(text: Column) -> Column:
    """All statistics of a text as one struct; the list of words is made once."""
    safe = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        joined = F.array_join(words, "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            n_repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w, i: F.get(words, i - 1) == w)).cast("long").alias("n_twin_words"),
        )

    return F.struct(
        let(words_of(text), of).alias("w"),
        (F.length(safe) - F.length(without(safe, "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.length(safe) - F.length(F.replace(safe, F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        (F.length(safe) - F.length(F.translate(safe, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
        n_dup_lines(text).cast("long").alias("n_dup_lines"),
    )


CONTRACT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ALL = [*CONTRACT, "n_twin_words", "n_marks", "n_capitals"]


WITHIN = {"n_words", "word_chars", "n_repeat_words", "n_twin_words"}
#: The statistic of this name as a column.
Statistic = Callable[[str], Column]


def of(statistics_: Column) -> Statistic:
    return lambda c: statistics_["w"][c] if c in WITHIN else statistics_[c]


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*keep, statistics(F.col(text)).alias("__s"))
    return rows.select(*keep, *(of(F.col("__s"))(c).alias(c) for c in ALL))


def rates(s: Statistic = F.col) -> dict[str, Column]:
    """What the rules compare with thresholds: statistics for each word or character."""
    words, chars = F.greatest(s("n_words"), F.lit(1)), F.greatest(s("word_chars"), F.lit(1))
    return {
        "mean_word": s("word_chars") / words,
        "symbols_a_word": s("n_symbols") / words,
        "marks_a_word": s("n_marks") / words,
        "capitals_a_character": s("n_capitals") / chars,
        "twins_a_word": s("n_twin_words") / words,
        "repeats_a_word": s("n_repeat_words") / words,
        "dup_lines": s("n_dup_lines").cast("double"),
        "words": s("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    rate: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.rate] >= self.threshold if self.above else row[self.rate] < self.threshold

    def column(self, s: Statistic = F.col) -> Column:
        rate = rates(s)[self.rate]
        return rate >= F.lit(self.threshold) if self.above else rate < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.rate} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; a document that fits one is rejected by the first."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def number(self, s: Statistic = F.col) -> Column:
        """The first rule that fits, from 1 on; 0 if none does."""
        out: Column | None = None
        for k, rule in enumerate(self.rules, 1):
            fits = rule[0].column(s)
            for c in rule[1:]:
                fits = fits & c.column(s)
            out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, rule)) for rule in self.rules)


Labelled = list[tuple[dict[str, float], bool]]


def _covered(rule, rows: Labelled) -> tuple[int, int]:
    fits = [bad for row, bad in rows if all(c.holds(row) for c in rule)]
    return sum(fits), len(fits) - sum(fits)


def _thresholds(rows: Labelled) -> dict[str, list[float]]:
    """Midpoints between neighbouring values where good and bad documents meet, evenly chosen if there are many."""
    out = {}
    for rate in rows[0][0]:
        kinds: dict[float, int] = {}
        for row, bad in rows:
            kinds[row[rate]] = kinds.get(row[rate], 0) | (2 if bad else 1)
        values = sorted(kinds)
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:]) if kinds[a] != kinds[b] or kinds[a] == 3]
        out[rate] = cuts if len(cuts) <= THRESHOLDS else [cuts[len(cuts) * k // THRESHOLDS] for k in range(THRESHOLDS)]
    return out


def _grow(rows: Labelled) -> tuple[Condition, ...]:
    """Add the condition with the largest information gain until no good document is covered."""
    rule: tuple[Condition, ...] = ()
    rows = list(rows)
    while len(rule) < MAX_CONDITIONS:
        bad = sum(b for _, b in rows)
        good = len(rows) - bad
        if not bad or not good:
            break
        base, best = math.log2(bad / (bad + good)), (0.0, None)
        for rate, cuts in _thresholds(rows).items():
            ordered = sorted((row[rate], b) for row, b in rows)
            at = below_bad = 0
            for cut in cuts:
                while at < len(ordered) and ordered[at][0] < cut:
                    below_bad += ordered[at][1]
                    at += 1
                for above, p, n in ((True, bad - below_bad, len(rows) - at), (False, below_bad, at)):
                    if p:
                        best = max(best, (p * (math.log2(p / n) - base), Condition(rate, above, cut)), key=lambda x: x[0])
        if best[1] is None:
            break
        rule += (best[1],)
        rows = [(row, b) for row, b in rows if best[1].holds(row)]
    return rule


def _prune(rule: tuple[Condition, ...], rows: Labelled) -> tuple[Condition, ...]:
    """The shortest beginning of the rule that separates held-back documents best."""

    def worth(r) -> float:
        p, n = _covered(r, rows)
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth) if rule else rule


def learn_list(rows: Labelled) -> DecisionList:
    """Sequential covering; every third document is held back for pruning."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    found = DecisionList()
    while len(found.rules) < MAX_RULES and any(b for _, b in grow):
        rule = _prune(_grow(grow), prune)
        p, n = _covered(rule, grow) if rule else (0, 0)
        q, m = _covered(rule, prune) if rule else (0, 0)
        if p + q < MIN_COVERED or p < MIN_PRECISION * (p + n) or q < MIN_PRECISION * (q + m):
            break
        found.rules.append(rule)
        grow, prune = ([(row, b) for row, b in part if not all(c.holds(row) for c in rule)] for part in (grow, prune))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = MAX_LABELLED) -> Labelled:
    """Rates of at most ``limit`` labelled documents and whether each is bad, in the order of the id.

    The first by a hash of the id among the labels that have a document; of
    documents that share an id the first text counts. Statistics are worked
    out for these few texts alone, which are written down first.
    """
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__q"))
    chosen = hash_sample(usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", limit)
    there = docs.select(F.col("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = materialize(there.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("__q").alias("__q")), "labelled")
    measured = with_statistics(texts, "text", ["doc_id", "__q"]).select("doc_id", "__q", base_failed().alias("__f"), *(c.alias(k) for k, c in rates().items()))
    rows = sorted((r for r in measured.collect() if not r["__f"]), key=lambda r: r.doc_id)
    names = list(rates())
    return [({k: float(r[k]) for k in names}, r["__q"] == 0) for r in rows]


def base_failed(s: Statistic = F.col) -> Column:
    return (s("n_words") < MIN_WORDS) | (s("n_repeat_words") * 100 > s("n_words") * MAX_REPEAT_PERCENT)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep``, the statistics, base_failed, the number of the rule that rejects (0: none) and kept."""
    learned = learn_list(labelled_sample(docs, labels, text))
    judged = with_statistics(docs, text, keep).withColumn("base_failed", base_failed()).withColumn("rule", learned.number())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", *CONTRACT, "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, in their own columns.

    The verdict is one expression, in which a text's statistics stand once,
    wherever the optimiser puts the filter.
    """
    taught = learn_list(labelled_sample(docs, labels, text))
    return docs.where(let(statistics(F.col(text)), lambda s: ~base_failed(of(s)) & (taught.number(of(s)) == 0)))
