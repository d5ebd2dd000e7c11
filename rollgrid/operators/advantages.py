"""Group-relative advantages, returns, divergences and losses.

Outcome estimators are windows over the group key with one scalar reward for each row; they add ``advantages`` (and
``returns`` where they differ). Token-level ones fold arrays inside the row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.functions import arrays as A

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def estimator(name: str) -> Callable:
    """Register an estimator under a name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ESTIMATORS[name] = f
        return f

    return add


def advantage(df: DataFrame, name: str, **options) -> DataFrame:
    """Add the advantages of a registered estimator."""
    if name not in ESTIMATORS:
        raise NotImplementedError(f"unknown advantage estimator: {name}")
    return ESTIMATORS[name](df, **options)


@estimator("grpo")
def grpo(df: DataFrame, key: str = "uid", reward: str = "reward", eps: float = 1e-6) -> DataFrame:
    """(r - mean) / (sample std + eps); a group of one gives 0."""
    w = W.partitionBy(key)
    return df.withColumn("advantages", (F.col(reward) - F.avg(reward).over(w)) / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(1.0)) + eps))


@estimator("grpo_std_floor")
def std_floor(df: DataFrame, key: str = "uid", reward: str = "reward", floor: float = 0.05) -> DataFrame:
    """(r - mean) / max(std, floor)."""
    if floor <= 0:
        raise ValueError("the floor of the standard deviation must be positive")
    w = W.partitionBy(key)
    return df.withColumn("advantages", (F.col(reward) - F.avg(reward).over(w)) / F.greatest(F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)), F.lit(floor)))


@estimator("dr_grpo")
def centred(df: DataFrame, key: str = "uid", reward: str = "reward") -> DataFrame:
    """r - mean."""
    return df.withColumn("advantages", F.col(reward) - F.avg(reward).over(W.partitionBy(key)))


@estimator("rloo")
def leave_one_out(df: DataFrame, key: str = "uid", reward: str = "reward") -> DataFrame:
    """r minus the mean of the others. A group of one has no others and fails the query."""
    w = W.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    others = F.when(n > 1, F.try_divide(F.sum(reward).over(w) - F.col(reward), n - 1)).otherwise(F.raise_error(F.lit("leave-one-out needs groups of more than one")))
    return df.withColumn("advantages", F.col(reward) - others)


@estimator("grpo_passk")
def pass_at_k(df: DataFrame, key: str = "uid", reward: str = "reward", tie: str = "pos", eps: float = 1e-6) -> DataFrame:
    """Only the best row (of equal ones that of the smallest tie column) gets (best - second) / (std + eps)."""
    order = W.partitionBy(key).orderBy(F.col(reward).desc(), F.col(tie))
    w = W.partitionBy(key)
    second = F.lead(reward).over(order)
    value = F.when(F.row_number().over(order) == 1, (F.col(reward) - second) / (F.stddev_samp(reward).over(w) + eps)).otherwise(F.lit(0.0))
    return df.withColumn("advantages", F.coalesce(value, F.lit(0.0)))


@estimator("remax")
def remax(df: DataFrame, rewards: str = "token_rewards", mask: str = "mask", baseline: str = "baseline") -> DataFrame:
    """returns: reverse sums of token rewards; advantages: their total minus the baseline at each live token."""
    masked = F.zip_with(rewards, mask, lambda r, m: r * m)
    total = F.aggregate(F.col(rewards), F.lit(0.0), lambda a, r: a + r)
    return df.withColumns({"returns": A.discounted(masked, F.transform(mask, lambda m: F.lit(1)), 1.0), "advantages": F.transform(mask, lambda m: (total - F.col(baseline)) * m)})


def whitened(df: DataFrame, values: str, mask: str, name: str, eps: float = 1e-8) -> DataFrame:
    """Values minus their masked mean, over the root of the masked unbiased variance, across all rows."""
    flat = df.select(F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))).alias("z")).select("z.v", "z.m").where("m > 0")
    stats = flat.agg(F.avg("v").alias("_mean"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("_var"))
    return df.crossJoin(F.broadcast(stats)).withColumn(name, F.zip_with(values, mask, lambda v, m: (v - F.col("_mean")) / F.sqrt(F.col("_var") + eps) * m)).drop("_mean", "_var")  # by one row


@estimator("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, rewards: str = "token_rewards", mask: str = "mask", gamma: float = 1.0) -> DataFrame:
    """returns: discounted in reverse, reset by the mask; advantages: the returns whitened over all rows."""
    return whitened(df.withColumn("returns", A.discounted(F.col(rewards), F.col(mask), gamma)), "returns", mask, "advantages")


@estimator("gae")
def gae(df: DataFrame, rewards: str = "token_rewards", values: str = "values", mask: str = "mask", gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    raw = df.withColumn("_raw", A.gae(F.col(rewards), F.col(values), F.col(mask), gamma, lam))
    raw = raw.withColumn("returns", F.zip_with("_raw", values, lambda a, v: a + v))
    return whitened(raw, "_raw", mask, "advantages").drop("_raw")


def group_advantages(df: DataFrame, key: str = "uid", reward: str = "reward", eps: float = 1e-6) -> DataFrame:
    """Per group the mean absolute standardised and centred advantages."""
    both = centred(grpo(df, key, reward, eps).withColumnRenamed("advantages", "_a"), key, reward)
    return both.groupBy(key).agg(F.avg(F.abs("_a")).alias("abs_standardised"), F.avg(F.abs("advantages")).alias("abs_centred"))


def divergence(p: Column, q: Column, kind: str) -> Column:
    """Divergence of two log probabilities: kl, abs, mse or low_var_kl."""
    if kind == "kl":
        return p - q
    if kind == "abs":
        return F.abs(p - q)
    if kind == "mse":
        return 0.5 * (p - q) * (p - q)
    if kind == "low_var_kl":
        d = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), q - p))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(d) - d - 1))
    raise NotImplementedError(f"unknown divergence: {kind}")


def penalised(scores: Column, p: Column, q: Column, coefficient: float, mask: Column, kind: str = "kl") -> Column:
    """Token scores minus the coefficient times the masked divergence."""
    each = F.zip_with(F.zip_with(p, q, lambda a, b: divergence(a, b, kind)), mask, lambda d, m: d * m)
    return F.zip_with(scores, each, lambda s, d: s - coefficient * d)


@dataclass(frozen=True)
class FixedController:
    coefficient: float

    def updated(self, divergence: float, steps: int) -> FixedController:
        return self


@dataclass(frozen=True)
class AdaptiveController:
    """Coefficient that follows a target divergence, by at most a fifth of steps / horizon each time."""

    coefficient: float
    target: float
    horizon: float

    def updated(self, divergence: float, steps: int) -> AdaptiveController:
        error = max(-0.2, min(0.2, divergence / self.target - 1))
        return AdaptiveController(self.coefficient * (1 + error * steps / self.horizon), self.target, self.horizon)


def controller(kind: str, coefficient: float, target: float = 0.1, horizon: float = 10_000) -> FixedController | AdaptiveController:
    if kind == "fixed":
        return FixedController(coefficient)
    if kind == "adaptive":
        if horizon <= 0:
            raise ValueError("the horizon must be positive")
        return AdaptiveController(coefficient, target, horizon)
    raise ValueError(f"unknown controller: {kind}")


def policy_loss(
    df: DataFrame, old: str, new: str, advantages: str, mask: str, low: float = 0.2, high: float = 0.3, dual: float | None = 3.0, mode: str = "token",
    kind: str = "default", tau_positive: float = 1.0, tau_negative: float = 1.05,
) -> DataFrame:
    """Forward value of a policy objective: loss, shares of tokens clipped on either side, mean divergence, entropy.

    Kinds: default (clipped, dual-clipped where ``dual`` is set), gspo and gspo_token (one ratio for the sequence, the
    mean of its log ratios), cispo (clipped ratio as a weight of the log probability), sapo (sigmoid gates, a
    temperature for either sign). ``mode`` averages over all tokens, or over rows of their own means.
    """
    if kind not in ("default", "gspo", "gspo_token", "cispo", "sapo"):
        raise NotImplementedError(f"unknown loss: {kind}")
    if mode not in ("token", "seq"):
        raise NotImplementedError(f"unknown averaging: {mode}")
    each = df.withColumn("_row", F.monotonically_increasing_id())
    logs = A.masked_mean(F.zip_with(new, old, lambda n, o: n - o), F.col(mask))
    z = F.explode(F.arrays_zip(*[F.col(c).alias(n) for c, n in ((old, "o"), (new, "n"), (advantages, "a"), (mask, "m"))]))
    flat = each.select("_row", logs.alias("_seq"), z.alias("z")).select("_row", "_seq", "z.*").where("m > 0")
    d = F.col("n") - F.col("o")
    log_ratio = F.col("_seq") if kind.startswith("gspo") else d
    ratio = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), log_ratio)))
    clipped = F.exp(F.greatest(F.lit(math.log(1 - low)), F.least(F.lit(math.log(1 + high)), log_ratio)))
    a = F.col("a")
    none = F.lit(0.0)
    if kind == "cispo":
        loss, higher, lower = -a * F.col("n") * clipped, none, none
    elif kind == "sapo":
        gate = lambda tau: 4.0 / tau / (1 + F.exp(-tau * (ratio - 1)))
        loss, higher, lower = -a * F.when(a >= 0, gate(tau_positive)).otherwise(gate(tau_negative)), none, none
    else:
        plain, bounded = -a * ratio, -a * clipped
        worst = F.greatest(plain, bounded)
        higher = (bounded > plain).cast("double")
        loss, lower = worst, none
        if dual:
            loss = F.when(a < 0, F.least(worst, -a * dual)).otherwise(worst)
            lower = ((worst > -a * dual) & (a < 0)).cast("double")
    flat = flat.select("_row", loss.alias("loss"), higher.alias("higher"), lower.alias("lower"), (-d).alias("kl"), (-F.col("n")).alias("entropy"))
    names = ("loss", "higher", "lower", "kl", "entropy")
    if mode == "seq":
        flat = flat.groupBy("_row").agg(*[F.avg(c).alias(c) for c in names])
    return flat.agg(F.avg("loss").alias("loss"), F.avg("higher").alias("clipped_high"), F.avg("lower").alias("clipped_low"), F.avg("kl").alias("kl"), F.avg("entropy").alias("entropy"))


def value_loss(df: DataFrame, predicted: str, returns: str, values: str, mask: str, clip: float = 0.5) -> DataFrame:
    """Half the larger squared error of the value and the value clipped around the old one."""
    names = ((predicted, "p"), (returns, "r"), (values, "v"), (mask, "m"))
    flat = df.select(F.explode(F.arrays_zip(*[F.col(c).alias(n) for c, n in names])).alias("z")).select("z.*").where("m > 0")
    bounded = F.greatest(F.col("v") - clip, F.least(F.col("v") + clip, F.col("p")))
    a, b = F.pow(F.col("p") - F.col("r"), F.lit(2)), F.pow(bounded - F.col("r"), F.lit(2))
    return flat.agg((0.5 * F.avg(F.greatest(a, b))).alias("loss"), F.avg((a < b).cast("double")).alias("clipped"))


def full_divergence(log_p: Column, log_q: Column) -> Column:
    """Divergence of two whole distributions given by their log probabilities (arrays)."""
    return F.aggregate(F.zip_with(log_p, log_q, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda s, x: s + x)


def followed_controller(divergences: DataFrame, order: str, value: str, steps: str, start: float, target: float, horizon: float) -> DataFrame:
    """The coefficient of an adaptive controller after each step: a running product, which is a window of logarithms."""
    error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col(value) / target - 1))
    factor = F.log(1 + error * F.col(steps) / horizon)
    w = W.partitionBy(F.lit(0)).orderBy(order).rowsBetween(W.unboundedPreceding, 0)  # one row for each training step
    return divergences.withColumn("coefficient", start * F.exp(F.sum(factor).over(w)))
