"""Exact histogram of encoded lengths and what every context limit makes of it.

Documents are aggregated by length; suffix sums over the lengths then give,
for a limit at each of them, how many documents and tokens lie at or beyond
it and how many tokens are left when every document is cut there.

The sums are made in two steps, within ranges of lengths and over the ranges'
totals, so that no task gets all lengths. Defined results: a null or empty
text has length 0; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._shared import materialize
from tidemill.llm.bpe import with_token_ids

#: Lengths in one range.
SPAN = 256


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs) from a row for each document."""
    return lengths.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def _from_end(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Adds, for each length, the sums over it and all greater ones."""
    rows = rows.withColumn("__range", F.floor(F.col("n_tokens") / SPAN))
    totals = rows.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    beyond = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    after = totals.select("__range", *(F.coalesce(F.sum(f"__{c}").over(beyond), F.lit(0)).alias(f"__{c}") for c in sums))
    within = Window.partitionBy("__range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(after, "__range")
    return joined.select(*[c for c in rows.columns if c != "__range"], *((F.sum(c).over(within) + F.col(f"__{c}")).alias(to) for c, to in sums.items()))


def limits(counts: DataFrame) -> DataFrame:
    """For each length that occurs, as a limit: documents and tokens at or beyond it, tokens left of all, and the share of documents below or at it.

    The quantile q of the lengths is the first row whose ``share_to`` is q or more.
    """
    tokens = counts.withColumn("n_here", F.col("n_tokens") * F.col("n_docs"))
    summed = _from_end(tokens, {"n_docs": "docs_from", "n_here": "tokens_from"})
    docs, total = tokens.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_here"), F.lit(0))).first()
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.lit(total) - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("tokens_cut"),
        (F.lit(docs) - F.col("docs_from") + F.col("n_docs")).alias("docs_to"),
        ((F.lit(docs) - F.col("docs_from") + F.col("n_docs")) / F.lit(docs)).alias("share_to"),
    )


def cut_at(counts: DataFrame, limit: int) -> DataFrame:
    """Tokens left and documents cut for any one limit, from the histogram."""
    return counts.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_cut"), F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"))


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    lengths = with_token_ids(docs, tokenizer_path, keep=[]).select(F.size("ids").alias("n_tokens"))
    return limits(materialize(histogram(lengths), "lengths"))
