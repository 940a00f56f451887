"""Token-level arrays: masks, positions, padding, discounted sums and divergences, without exploding rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def masked_total(values: Column, mask: Column) -> Column:
    return total(F.zip_with(values, mask, lambda v, m: v * m))


def at_index(length: Column, index: Column, value: Column) -> Column:
    """Zeros but for one place."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(i == index, value).otherwise(F.lit(0.0)))


def response_mask(ids: Column, stop: Sequence[int]) -> Column:
    """1 up to and including the first stop id, then 0."""
    places = [F.nullif(F.array_position(ids, F.lit(s)), F.lit(0)) for s in stop]
    first = F.least(*places) if len(places) > 1 else places[0]
    return F.transform(ids, lambda _, i: F.when(i < F.coalesce(first, F.size(ids)), 1).otherwise(0))


#: Elements of a block of a running fold.
BLOCK = 64


def _running(items: Column, start: Column, step, kind: str) -> Column:
    """What each step of a fold puts out, in order; a step gives the carried value and what is put out.

    The fold goes by blocks, so that adding to the list of results copies a
    block at most, and a reference for each block before it: the work for L
    elements grows as L times the block's length, not with the square of L.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / BLOCK), F.lit(0)).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))

    def one(a, x):
        carried, put = step(a["c"], x)
        return F.struct(carried.alias("c"), F.concat(a["out"], F.array(put)).alias("out"))

    def block(a, some):
        inner = F.aggregate(some, F.struct(a["c"].alias("c"), F.array().cast(f"array<{kind}>").alias("out")), one)
        return F.get(F.transform(F.array(inner), lambda s: F.struct(s["c"].alias("c"), F.concat(a["out"], F.array(s["out"])).alias("out"))), F.lit(0))

    return F.aggregate(blocks, F.struct(start.alias("c"), F.array().cast(f"array<array<{kind}>>").alias("out")), block, lambda a: F.flatten(a["out"]))


def position_ids(mask: Column) -> Column:
    """Running count of the mask less one, at least 0."""
    zero = F.lit(0).cast("long")
    return _running(mask, zero, lambda n, m: (n + m, F.greatest(n + m - 1, zero)), "bigint")


def fit_left(ids: Column, length: int, pad: int) -> Column:
    """Cut from the left or padded on the left to a length."""
    return F.when(F.size(ids) >= length, F.slice(ids, F.size(ids) - length + 1, length)).otherwise(F.concat(F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(length - F.size(ids), F.lit(0))), ids))


def fit_right(ids: Column, length: int, pad: int) -> Column:
    """Cut or padded on the right to a length."""
    return F.when(F.size(ids) >= length, F.slice(ids, 1, length)).otherwise(F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(length - F.size(ids), F.lit(0)))))


def fit_or_fail(ids: Column, length: int) -> Column:
    return F.when(F.size(ids) > length, F.raise_error(F.lit("longer than allowed"))).otherwise(ids)


def _from_end(items: Column, step) -> Column:
    """A fold from the last element on; each step gives the carried value and what is put out, in the order of the items."""
    return F.reverse(_running(F.reverse(items), F.lit(0.0), step, "double"))


def gae_advantages(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates: of each step's surprise, discounted from the end on."""
    following = lambda i: F.coalesce(F.get(values, i + 1), F.lit(0.0))
    surprises = F.transform(rewards, lambda r, i: r + gamma * following(i) - F.get(values, i))
    return _from_end(surprises, lambda c, x: ((x + gamma * lam * c,) * 2))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Rewards to go; the carried sum starts anew where the mask is 0, behind what is put out there."""
    pairs = F.zip_with(rewards, mask, lambda r, m: F.struct(r.alias("r"), m.cast("double").alias("m")))
    return _from_end(pairs, lambda c, x: ((x["r"] + gamma * c) * x["m"], x["r"] + gamma * c))


def divergence(kind: str, log_p: Column, log_ref: Column) -> Column:
    """For each token, one of: kl, abs, mse, low_var_kl."""
    forms = {
        "kl": lambda p, r: p - r,
        "abs": lambda p, r: F.abs(p - r),
        "mse": lambda p, r: 0.5 * (p - r) * (p - r),
        "low_var_kl": lambda p, r: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(r - p) - (r - p) - 1)),
    }
    if kind not in forms:
        raise ValueError(f"no divergence {kind}")
    return F.zip_with(log_p, log_ref, forms[kind])


def penalised(scores: Column, kl: Column, mask: Column, coefficient: float) -> Column:
    return F.zip_with(scores, F.zip_with(kl, mask, lambda k, m: k * m), lambda s, k: s - coefficient * k)
