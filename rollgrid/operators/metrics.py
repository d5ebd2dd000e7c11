"""Training metrics: masked statistics over token arrays, timing and throughput."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(df: DataFrame, columns: Sequence[str], mask: str) -> DataFrame:
    """One row for each live token, with the columns' values at it."""
    names = [*columns, mask]
    z = F.explode(F.arrays_zip(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])).alias("z")
    return df.select(z).select(*[F.col(f"z.c{i}").alias(c) for i, c in enumerate(names)]).where(F.col(mask) > 0).drop(mask)


def spread(columns: Sequence[str]) -> list[Column]:
    return [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]


def data_metrics(df: DataFrame, scores: str, rewards: str, advantages: str, returns: str, mask: str, values: str | None = None) -> DataFrame:
    """One row: spread of the rows' score and reward sums and of live advantages and returns (and values, with the
    share of variance that they explain)."""
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    rows = df.select(total(scores).alias("score"), total(rewards).alias("reward")).agg(*spread(["score", "reward"]))
    live = [advantages, returns, *([values] if values else [])]
    flat = tokens(df, live, mask)
    more = [(1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance")] if values else []
    return rows.crossJoin(F.broadcast(flat.agg(*spread(live), *more)))  # one row by one row


def masked_moments(df: DataFrame, values: str, mask: str, eps: float = 1e-8) -> DataFrame:
    """Mean and unbiased variance of live values over all rows; of one value or none the variance is not corrected."""
    flat = tokens(df, [values], mask)
    return flat.agg((F.sum(values) / (F.count(values) + eps)).alias("mean"), F.when(F.count(values) > 1, F.var_samp(values)).otherwise(F.var_pop(values)).alias("variance"))


def average_loss(df: DataFrame, values: str, mask: str, mode: str = "token", eps: float = 1e-8) -> DataFrame:
    """Mean over all live tokens, or over rows of their own means."""
    if mode not in ("token", "seq"):
        raise NotImplementedError(f"unknown averaging: {mode}")
    sums = df.select(F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(mask, F.lit(0.0), lambda a, x: a + x).alias("n"))
    return sums.agg((F.sum("s") / (F.sum("n") + eps) if mode == "token" else F.avg(F.col("s") / (F.col("n") + eps))).alias("loss"))


def timing(sections: DataFrame, counts: dict[str, int]) -> DataFrame:
    """For rows (section, seconds): milliseconds for each token of the sections that ``counts`` knows."""
    n = F.coalesce(*[F.when(F.col("section") == k, F.lit(v)) for k, v in counts.items()], F.lit(None)) if counts else F.lit(None)
    return sections.withColumn("ms_per_token", F.try_divide(F.col("seconds") * 1000, n))


def throughput(steps: DataFrame, tokens_column: str, seconds: str, workers: int) -> DataFrame:
    return steps.withColumn("tokens_per_worker_second", F.try_divide(F.col(tokens_column), F.col(seconds) * workers))


def logged_sample(df: DataFrame, n: int, order: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the given columns: the same rows on each run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(n)


def worker_totals(reports: DataFrame) -> DataFrame:
    return reports.agg(F.sum("successes").alias("successes"), F.sum("failures").alias("failures"))


def within_length(df: DataFrame, text: str, most: int, count) -> DataFrame:
    """Rows whose text has at most ``most`` tokens by ``count``, a function of a list of texts, in Arrow batches."""
    @F.pandas_udf("long")
    def lengths(texts: pd.Series) -> pd.Series:
        return pd.Series(count([t or "" for t in texts]), dtype="int64")

    return df.where(lengths(F.col(text)) <= most)
