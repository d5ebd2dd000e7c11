"""Padding, masks and folds over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def response_mask(ids: Column, eos: int) -> Column:
    """1 up to and including the first end token, 0 after it; all 1 without one."""
    at = F.array_position(ids, F.lit(eos))
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), F.lit(1)).otherwise(F.lit(0)))


def padded(items: Column, length: int | Column, value, left: bool = False) -> Column:
    """Pad to a length; longer arrays stay as they are."""
    length = F.lit(length) if isinstance(length, int) else length
    fill = F.array_repeat(F.lit(value), F.greatest(length - F.size(items), F.lit(0)))
    return F.concat(fill, items) if left else F.concat(items, fill)


def fitted(items: Column, length: int, value, truncation: str = "error", left_pad: bool = True) -> Column:
    """Exactly ``length`` items: padded, or cut on the left or right; with 'error' a longer array fails."""
    if truncation == "left":
        cut = F.slice(items, F.greatest(F.size(items) - length + 1, F.lit(1)), F.lit(length))
    elif truncation == "right":
        cut = F.slice(items, F.lit(1), F.lit(length))
    elif truncation == "error":
        cut = F.when(F.size(items) <= length, items).otherwise(F.raise_error(F.lit(f"sequence is longer than {length}")))
    else:
        raise ValueError(f"unknown truncation {truncation!r}")
    return padded(cut, length, value, left=left_pad)


def masked_mean(values: Column, mask: Column, eps: float = 1e-8) -> Column:
    """Mean of a row's values under its mask."""
    total = F.aggregate(F.zip_with(values, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    return total / (F.aggregate(mask, F.lit(0.0), lambda a, m: a + m) + eps)


def differences(items: Column) -> Column:
    n = F.size(items)
    return F.when(n > 1, F.zip_with(F.slice(items, F.lit(2), n - 1), F.slice(items, F.lit(1), n - 1), lambda b, a: b - a)).otherwise(F.slice(items, 1, 0))


def running(items: Column, start: Column | float = 0.0) -> Column:
    """Start and its cumulative sums: one element more than ``items``."""
    first = F.lit(float(start)) if isinstance(start, (int, float)) else start
    return F.aggregate(items, F.array(first.cast("double")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def discounted(rewards: Column, mask: Column, gamma: float = 1.0) -> Column:
    """Reverse discounted returns; the running value is multiplied by the mask after each step."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    zero = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        value = x["r"].cast("double") + gamma * state["run"]
        return F.struct((value * x["m"]).cast("double").alias("run"), F.concat(F.array(value), state["out"]).alias("out"))

    return F.aggregate(steps, zero, step, lambda s: s["out"])


def gae(rewards: Column, values: Column, mask: Column, gamma: float = 1.0, lam: float = 1.0) -> Column:
    """Advantages by the generalised estimator, in reverse; masked steps pass the state on and get 0."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    zero = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("following"), F.array().cast("array<double>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        delta = x["r"] + gamma * state["following"] - x["v"]
        new = delta + gamma * lam * state["last"]
        live = x["m"] > 0
        return F.struct(
            F.when(live, new).otherwise(state["last"]).cast("double").alias("last"),
            F.when(live, x["v"]).otherwise(state["following"]).cast("double").alias("following"),
            F.concat(F.array(F.when(live, new).otherwise(F.lit(0.0)).cast("double")), state["out"]).alias("out"),
        )

    return F.aggregate(steps, zero, step, lambda s: s["out"])


def rms(items: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(items, F.lit(0.0), lambda a, x: a + x * x), F.size(items)))


def within(items: Column, low: float | None = None, high: float | None = None) -> Column:
    """All elements strictly inside the bounds; a bound of None is open."""
    return F.forall(items, lambda x: (x > (float("-inf") if low is None else low)) & (x < (float("inf") if high is None else high)))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true elements; NULL elements are passed over and do not end a run."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x.isNull(), s["now"]).when(x, s["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(flags, zero, step, lambda s: s["best"])


def inverse_permutation(order: Column) -> Column:
    """Where each index 0..n-1 stands in ``order``."""
    return F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda i: F.array_position(order, i).cast("int") - 1)
