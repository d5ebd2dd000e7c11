"""Statistics, filters and rankings over groups of scored rollouts (several rows for each token).

Each operator is one partial and final hash aggregation by the group key, or windows over it; nothing is gathered.
Groups are a few rows each by nature, so windows over a group are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.operators.storage import stored

from rollgrid.functions import scores as S


def reward(df: DataFrame, names: Sequence[str] = ("training_reward", "pdms_scaled", "overall")) -> Column:
    """The first reward column that a row has a value in. A frame with none of the columns fails."""
    there = [F.col(n) for n in names if n in df.columns]
    if not there:
        raise KeyError(f"none of {', '.join(names)} in {df.columns}")
    return F.coalesce(*there)


def group_stats(df: DataFrame, key: str = "token", measures: Sequence[str] = ("pdms", "pdms_scaled"), order: Sequence[str] = ()) -> DataFrame:
    """group_size and, for each measure, mean, sample std (NULL for one row) and range.

    The last bits of means and stds follow the order in which Spark adds, which changes with the files and tasks. With the
    columns of an ``order`` each group is added in it, so reruns agree; its rows are sent and sorted, not summed before.
    """
    if order:
        df = df.repartition(key).sortWithinPartitions(key, *order)
    aggregates = [F.count(F.lit(1)).alias("group_size")]
    for m in measures:
        aggregates += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), (F.max(m) - F.min(m)).alias(f"{m}_range")]
    return df.groupBy(key).agg(*aggregates)


def scene_filter(stats: DataFrame, measure: str = "pdms_scaled", p: float = 0.1, n_rollout: int = 8, group_size: int = 32, std_threshold: float = 0.01, conf: float = 0.1) -> DataFrame:
    """Groups with spread, likely to show both outcomes, whose std is near that of a two-valued reward."""
    mean, std, span = (F.col(f"{measure}_{x}") for x in ("mean", "std", "range"))
    usable = stats.where(std.isNotNull() & ~F.isnan(std) & (std > std_threshold) & (span > 1e-6)).withColumn("p_est", mean / span)
    both = usable.where(F.pow("p_est", F.lit(n_rollout)) + F.pow(1 - F.col("p_est"), F.lit(n_rollout)) < p)
    k = F.rint(F.col("p_est") * group_size)
    radicand = k * (group_size - k) / float(group_size * (group_size - 1))
    near = both.withColumn("pred_std", F.when(radicand >= 0, F.sqrt(radicand) * span))
    return near.where(F.abs(F.col("pred_std") - std) / std < conf)


def learnability_ranking(df: DataFrame, key: str = "token", value: Column | None = None) -> DataFrame:
    """Per group mean, std, maximum, difficulty, headroom and learnability, best first, ties by key."""
    value = reward(df, ("pdms_scaled", "overall")) if value is None else value
    stats = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.max(value).alias("best"))
    stats = stats.withColumns({"difficulty": 1 - F.col("mean"), "headroom": F.col("best") - F.col("mean"), "learnability": S.learnability(F.col("mean"), F.col("best"))})
    return stats.orderBy(F.col("learnability").desc(), F.col(key))


def top_budgets(ranking: DataFrame, budgets: Sequence[int], key: str = "token") -> dict[int, DataFrame]:
    """The first k groups of a ranking for each budget k, which must lie between 1 and the number of groups."""
    n = ranking.count()
    if bad := [k for k in budgets if not 1 <= k <= n]:
        raise ValueError(f"budgets outside 1..{n}: {bad}")
    return {k: ranking.select(key).limit(k) for k in budgets}


def group_summary(df: DataFrame, key: str = "token", value: str = "pdms_scaled", sets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per group the statistics of difficulty analysis, safe and parse rates, and a flag for each named set of keys."""
    safe = F.avg("safe") if "safe" in df.columns else F.lit(None).cast("double")
    parsed = F.avg(F.coalesce(F.col("parsed_ok"), F.lit(True)).cast("double")) if "parsed_ok" in df.columns else F.lit(1.0)
    out = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), safe.alias("safe_rate"), parsed.alias("parse_rate")
    )
    out = out.withColumns({"gap": F.col("max") - F.col("min"), "headroom": F.col("max") - F.col("mean"), "difficulty": 1 - F.col("mean"), "learnability": S.learnability(F.col("mean"), F.col("max"))})
    for name, members in (sets or {}).items():
        marks = members.select(F.col(members.columns[0]).alias(key)).distinct().withColumn(f"in_{name}", F.lit(True))
        out = out.join(marks, key, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return out


def subset_report(summary: DataFrame) -> DataFrame:
    """Means of the group measures, and the share of groups without any spread."""
    measures = [c for c in ("mean", "std", "gap", "headroom", "difficulty", "learnability", "safe_rate") if c in summary.columns]
    return summary.agg(F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(f"avg_{c}") for c in measures], F.avg((F.col("std") == 0).cast("double")).alias("zero_std_ratio"))


def rollout_report(df: DataFrame, key: str = "token", value: str = "pdms_scaled", std_threshold: float = 0.01, clip_length: int | None = None) -> DataFrame:
    """One row over all rollouts: shares of groups without and with little spread (std of one row is 0), overall mean
    and population std, percentiles, counts of failed parses and clipped responses."""
    groups = df.groupBy(key).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.avg(value).alias("mean"), F.max(value).alias("best"))
    first = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg((F.col("std") == 0).cast("double")).alias("zero_std_ratio"),
        F.avg((F.col("std") < std_threshold).cast("double")).alias("low_std_ratio"),
        F.avg(F.col("best") - F.col("mean")).alias("headroom"),
    )
    per_row = [F.count(F.lit(1)).alias("rollouts"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")]
    if "parsed_ok" in df.columns:
        per_row.append(F.sum((~F.coalesce(F.col("parsed_ok"), F.lit(True))).cast("long")).alias("parse_failures"))
    if clip_length is not None:
        per_row.append(F.sum((F.col("response_length") >= clip_length).cast("long")).alias("clipped"))
    shares = percentiles(df, value, {f"p{q}": q / 100 for q in (50, 90, 95, 99)})
    return df.agg(*per_row).crossJoin(F.broadcast(shares)).crossJoin(F.broadcast(first))  # one row each


def group_filter(df: DataFrame, key: str = "uid", value: str = "score", mode: str = "zero_variance", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The rows of groups with a mean strictly inside (low, high), or with any spread."""
    w = W.partitionBy(key)
    if mode == "mean":
        keep = (F.avg(value).over(w) > low) & (F.avg(value).over(w) < high)
    elif mode == "zero_variance":
        keep = F.max(value).over(w) != F.min(value).over(w)
    else:
        raise ValueError(f"unknown group filter mode: {mode}")
    return df.withColumn("_keep", keep).where("_keep").drop("_keep")


def persistent_failures(df: DataFrame, key: str = "token", safe: str = "safe", value: str = "pdms_scaled") -> DataFrame:
    """Keys all of whose rows are unsafe (a missing mark counts as unsafe) or whose best value is 0."""
    stats = df.groupBy(key).agg(F.bool_and(F.coalesce(F.col(safe).cast("double"), F.lit(0.0)) == 0).alias("never_safe"), F.max(value).alias("best"))
    return stats.where(F.col("never_safe") | (F.col("best") == 0)).select(key)


def best_of_n(df: DataFrame, key: str = "token", value: str = "score", tie: str = "pos") -> DataFrame:
    """The best row of each group; of equal ones that of the smallest tie column."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col(value).desc(), F.col(tie)))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def with_average_row(df: DataFrame, key: str = "token", name: str = "average_all_frames", columns: Sequence[str] | None = None) -> DataFrame:
    """The frame and one more row of column means; NaN is passed over, and valid is true if all rows are."""
    numeric = columns or [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c != key]
    means = [F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in numeric]
    if "valid" in df.columns:
        means.append(F.bool_and("valid").alias("valid"))
    return df.unionByName(df.agg(*means).withColumn(key, F.lit(name)), allowMissingColumns=True)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The frame with the 0-based number of each row in the order of some columns.

    Rows are dealt into ranges of all the order columns, as many as the session has shuffle partitions, so no task sees
    more than a range and ties of the first column are split by the others. Numbers count from the sums of the ranges
    before; the ranges are stored, so they cannot shift.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(placed.withColumn("_part", F.spark_partition_id()).withColumn("_inside", inside), "numbered")
    sums = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sums.select("_part", before.alias("_before")))  # one row for each range
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """0-based ranks, ties sharing their average, from counts of distinct values.

    Counts are dealt into ranges of values; they are summed inside the ranges and over the sums of the ranges, so no
    task sees all rows, nor all values. The rows are stored first: computed twice, sums of doubles may differ in their last
    bits, and values would not meet their own counts.
    """
    df = stored(df, "ranked")
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    counts = stored(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), "value-counts")
    sums = counts.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    offsets = F.broadcast(sums.select("_part", before.alias("_before")))
    inside = F.sum("_n").over(W.partitionBy("_part").orderBy(value))
    ranks = counts.join(offsets, "_part").withColumn(name, F.col("_before") + inside - (F.col("_n") + 1) / 2)
    return df.join(ranks.select(value, name), value)


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the exact percentiles of a column by name, linear between neighbours; NULL values take no part."""
    placed = numbered(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_value")), ["_value"], "_at")
    n = placed.count()
    out = []
    for name, share in shares.items():
        place = share * (n - 1)
        low = math.floor(place)
        at = lambda k: F.max(F.when(F.col("_at") == max(k, 0), F.col("_value")))
        out.append((at(low) + (at(min(low + 1, n - 1)) - at(low)) * (place - low)).alias(name))
    return placed.agg(*out)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; 0 where either side does not vary."""
    ranked = average_ranks(average_ranks(df.select(a, b), a, "_ra"), b, "_rb")
    sa, sb = F.stddev_pop("_ra"), F.stddev_pop("_rb")
    return ranked.agg(F.coalesce(F.try_divide(F.covar_pop("_ra", "_rb"), sa * sb), F.lit(0.0)).alias("spearman"))


def quantile_bins(df: DataFrame, by: str, key: str, bins: int = 5) -> DataFrame:
    """floor(index * bins / n) of each row in the order of (by, key)."""
    placed = numbered(df, [by, key], "_at")
    return placed.withColumn("bin", F.floor(F.col("_at") * bins / F.lit(max(df.count(), 1))).cast("int")).drop("_at")


def quantile_report(df: DataFrame, key: str, by: str, value: str, bins: int = 5) -> DataFrame:
    return quantile_bins(df, by, key, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("low"), F.max(by).alias("high"), F.avg(value).alias("mean"))


def diversity(df: DataFrame, key: str = "token", pos: str = "pos", poses: str = "poses", final: bool = False) -> DataFrame:
    """Mean distance of the pairs of parsed trajectories of one group; pairs of different lengths are passed over."""
    from rollgrid.functions import geometry as G

    usable = df.where(F.coalesce(F.col("parsed_ok"), F.lit(True))) if "parsed_ok" in df.columns else df
    usable = usable.select(key, pos, poses)
    a, b = usable.alias("a"), usable.alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{pos}") < F.col(f"b.{pos}")))
    distance = (G.final_distance if final else G.mean_distance)(F.col(f"a.{poses}"), F.col(f"b.{poses}"))
    return met.select(F.col(f"a.{key}").alias(key), distance.alias("d")).where("d is not null").groupBy(key).agg(F.avg("d").alias("distance"), F.count(F.lit(1)).alias("pairs"))


def bootstrap_ci(df: DataFrame, key: str, value: str, samples: int = 2000, seed: int = 0) -> DataFrame:
    """Mean and 95 % percentile interval of each group's values, resampled with a seeded generator."""

    def resample(group: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        x = np.sort(group[value].dropna().to_numpy(float))
        if not len(x):
            return pd.DataFrame({key: [group[key].iloc[0]], "mean": [None], "low": [None], "high": [None]})
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(samples)])
        return pd.DataFrame({key: [group[key].iloc[0]], "mean": [x.mean()], "low": [np.quantile(means, 0.025)], "high": [np.quantile(means, 0.975)]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, value).groupBy(key).applyInPandas(resample, f"{key} {kind}, mean double, low double, high double")


#: A prime below 2**31: its residues have products that fit in 64 bits. Multipliers of the hash of a row and replicate.
PRIME, MULTIPLIERS = 2**31 - 1, (48271, 69621, 40692)
#: Counts that a replicate may give a row at most; the chance of more is below 1e-10.
MOST_COUNT = 12


def poisson_counts(row: Column, replicate: Column, seed: int = 0) -> Column:
    """How often a replicate takes a row: Poisson of mean 1, by a hash of the whole number ``row`` and the replicate."""
    a, b, c = MULTIPLIERS
    mod = lambda x: F.pmod(x, F.lit(PRIME))
    begin = mod(mod(replicate.cast("long") + F.lit(seed + 1)) * a + 1)
    mixed = mod(mod(row.cast("long")) * b + begin)
    mixed = mod(mixed * mixed + begin)
    mixed = mod(mod(mixed * c) + mod(mixed * mixed))
    total, bounds = 0.0, []
    for k in range(MOST_COUNT):
        total += math.exp(-1) / math.factorial(k)
        bounds.append(int(total * PRIME))
    return sum(((mixed >= F.lit(b)).cast("int") for b in bounds), F.lit(0))


def poisson_bootstrap(df: DataFrame, key: str, value: str, row: str, samples: int = 1000, seed: int = 0) -> DataFrame:
    """Per group and replicate the mean of a resample: key, replicate, mean.

    Each replicate takes every row a Poisson number of times, by a hash, in place of drawing from a gathered group: a group
    needs two sums for each replicate, which tasks add up before anything moves, and reruns agree. ``row`` is a whole number
    that tells rows apart; null values take no part, and a replicate that takes no row has no mean.
    """
    each = df.where(F.col(value).isNotNull() & F.col(row).isNotNull()).select(key, F.col(value).cast("double").alias("_x"), F.col(row).alias("_row"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("replicate"))
    counts = each.withColumn("_w", poisson_counts(F.col("_row"), F.col("replicate"), seed))
    return counts.groupBy(key, "replicate").agg(F.try_divide(F.sum(F.col("_w") * F.col("_x")), F.sum("_w")).alias("mean"))


def poisson_ci(df: DataFrame, key: str, value: str, row: str, samples: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean of each group and the percentile interval of its resampled means: key, mean, low, high."""
    ends = poisson_bootstrap(df, key, value, row, samples, seed).groupBy(key).agg(*[F.percentile("mean", F.lit(q)).alias(n) for q, n in (((1 - level) / 2, "low"), ((1 + level) / 2, "high"))])  # ``samples`` means a group
    return df.groupBy(key).agg(F.avg(value).alias("mean")).join(ends, key)


def sampling_caps(grid: DataFrame, target: int, steps: int, trials: int = 20_000, seed: int = 0) -> DataFrame:
    """For rows (ratio, cap): the chance that cap batches of ``target`` groups give too few informative ones, the same
    for a run of ``steps`` steps, and the mean number of batches."""

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ratio, cap in zip(batch["ratio"], batch["cap"]):
                rng = np.random.default_rng(seed)
                kept = np.cumsum(rng.binomial(target, ratio, (trials, int(cap))), axis=1)
                filled = kept >= target
                failure = float((~filled[:, -1]).mean())
                attempts = np.where(filled.any(axis=1), filled.argmax(axis=1) + 1, int(cap))
                rows.append((ratio, int(cap), failure, 1 - (1 - failure) ** steps, float(attempts.mean())))
            yield pd.DataFrame(rows, columns=["ratio", "cap", "step_failure", "run_failure", "mean_attempts"])

    return grid.mapInPandas(simulate, "ratio double, cap int, step_failure double, run_failure double, mean_attempts double")


def pilot_report(log: DataFrame, parent: DataFrame, steps: int) -> DataFrame:
    """Sums, ratios and percentiles of a sampling pilot against its parent run; rows without sampling are no steps."""
    log = log.where(F.col("step").between(1, steps) & F.col("sampling").isNotNull())
    base = parent.where(F.col("step").between(1, steps)).agg(F.sum("timing_s.step").alias("parent_s"))
    s = "sampling."
    own = log.agg(
        F.count(F.lit(1)).alias("steps"),
        *[F.sum(f"{s}{c}").alias(c) for c in ("generated_groups", "kept_groups", "used_groups", "dropped_groups", "generation_batches")],
        F.avg(f"{s}raw_rollout_overhead").alias("mean_overhead"),
        F.max(f"{s}raw_rollout_overhead").alias("max_overhead"),
        F.sum("timing_s.step").alias("total_s"),
        F.percentile("timing_s.step", 0.5).alias("step_p50"),
        F.percentile("timing_s.step", 0.9).alias("step_p90"),
    )
    return own.crossJoin(F.broadcast(base)).withColumn("time_ratio", F.try_divide("total_s", "parent_s"))  # one row by one row


def length_metrics(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Mean, maximum, minimum and share at the limit of a length column; the limit defaults to the maximum."""
    limit = df.agg(F.max(column).alias("_limit")) if most is None else df.sparkSession.range(1).select(F.lit(most).alias("_limit"))
    return df.crossJoin(F.broadcast(limit)).agg(F.avg(column).alias("mean"), F.max(column).alias("max"), F.min(column).alias("min"), F.avg((F.col(column) == F.col("_limit")).cast("double")).alias("clip_ratio"))


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def histogram2d(df: DataFrame, x: str, y: str, per_unit: float, cap: int) -> DataFrame:
    """Counts of square cells, capped and scaled to at most 1."""
    cells = df.groupBy(F.floor(F.col(x) * per_unit).alias("cx"), F.floor(F.col(y) * per_unit).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("level", F.least(F.col("n"), F.lit(cap)) / F.lit(float(cap)))


def latest_by(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
