"""Score formulas as column expressions. All take and give Columns; undefined results are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of progress, time to collision and comfort in the driving score.
WEIGHTS = (5.0, 5.0, 2.0)
#: Weights of progress, time to collision, lane keeping, history comfort and extended comfort.
EXTENDED_WEIGHTS = (5.0, 5.0, 2.0, 2.0, 2.0)


def clip01(x: Column) -> Column:
    """Clamp to [0, 1]; NaN becomes 1, as min and max of plain floats give it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def focal(x: Column, gamma: float) -> Column:
    return 1 - F.pow(1 - x, F.lit(float(gamma)))


def driving_score(nc: Column, dac: Column, ep: Column, ttc: Column, hc: Column, weights=WEIGHTS) -> Column:
    """Gates times the weighted mean of progress, time to collision and comfort."""
    a, b, c = weights
    return nc * dac * (a * ep + b * ttc + c * hc) / (a + b + c)


def scaled_score(nc: Column, dac: Column, ep: Column, ttc: Column, hc: Column, gammas=(0.6, 0.6, 1.0), weights=WEIGHTS, clip: bool = True) -> Column:
    """The weighted mean of focal maps, 0 where a gate is exactly 0. Missing gates count as 1 and missing metrics as 0."""
    a, b, c = weights
    nc, dac = F.coalesce(nc, F.lit(1.0)), F.coalesce(dac, F.lit(1.0))
    ep, ttc, hc = (clip01(F.coalesce(x, F.lit(0.0))) for x in (ep, ttc, hc))
    raw = (a * focal(ep, gammas[0]) + b * focal(ttc, gammas[1]) + c * focal(hc, gammas[2])) / (a + b + c)
    return F.when((nc == 0) | (dac == 0), F.lit(0.0)).otherwise(clip01(raw) if clip else raw)


def product_scaled_score(nc: Column, dac: Column, ep: Column, ttc: Column, hc: Column, gammas=(0.4, 0.4, 1.0), eps: float = 1e-6) -> Column:
    """The product of focal maps plus eps, 0 where a gate is exactly 0. All that is missing counts as 1."""
    nc, dac, ep, ttc, hc = (F.coalesce(x, F.lit(1.0)) for x in (nc, dac, ep, ttc, hc))
    maps = [focal(clip01(x), g) for x, g in zip((ep, ttc, hc), gammas)]
    return F.when((nc == 0) | (dac == 0), F.lit(0.0)).otherwise(maps[0] * maps[1] * maps[2] + eps)


def safety_first_reward(nc: Column, dac: Column, ep: Column, ttc: Column, hc: Column, gamma: float = 0.6) -> Column:
    """0.5 safe + 0.5 safe * quality + 0.1 (1 - safe) * ttc: safe rows get 0.5 to 1, unsafe ones 0 to 0.1."""
    safe = F.when((clip01(nc) > 0) & (clip01(dac) > 0), F.lit(1.0)).otherwise(F.lit(0.0))
    ep, ttc, hc = clip01(ep), clip01(ttc), clip01(hc)
    quality = (5 * focal(ep, gamma) + 5 * focal(ttc, gamma) + 2 * hc) / 12
    return 0.5 * safe + 0.5 * safe * quality + 0.1 * (1 - safe) * ttc


def extended_score(product: Column, metrics: Column, comfort: Column, weights=EXTENDED_WEIGHTS, strict: bool = False) -> Column:
    """Gate product times the weighted mean of a metric array whose last place takes ``comfort``.

    A NaN or NULL comfort gets weight 0, or with ``strict`` makes the result NULL. A total weight of 0 gives NULL.
    """
    missing = comfort.isNull() | F.isnan(comfort)
    total = sum(F.get(metrics, F.lit(i)) * w for i, w in enumerate(weights[:-1]))
    base = float(sum(weights[:-1]))
    with_comfort = product * (total + comfort * weights[-1]) / (base + weights[-1])
    without = F.lit(None).cast("double") if strict else product * F.try_divide(total, F.lit(base))
    return F.when(missing, without).otherwise(with_comfort)


def human_filtered(agent: Column, human: Column) -> Column:
    """1 where the human's metric is 0, else the agent's."""
    return F.when(human == 0, F.lit(1.0)).otherwise(agent)


def learnability(mean: Column, top: Column) -> Column:
    return (1 - mean) * (top - mean)


def soft_length_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to most - buffer, then linear down to -factor at most."""
    start = most - buffer
    return F.when(length <= start, F.lit(0.0)).when(length <= most, -(length - start) / F.lit(float(buffer)) * factor).otherwise(F.lit(-float(factor)))
