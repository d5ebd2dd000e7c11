"""Checks that stop a pipeline: duplicates, coverage, leakage, ranges. Each aggregates before it looks, and names at
most a few offenders in its error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 5


class GuardError(ValueError):
    """A data-quality check failed."""


def _fail_on(offenders: DataFrame, message: str) -> None:
    found = offenders.limit(SHOWN).collect()
    if found:
        raise GuardError(f"{message}: {', '.join(str(r[0]) for r in found)}")


def unique(df: DataFrame, key: str | Sequence[str], what: str = "keys") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    _fail_on(df.groupBy(*keys).count().where("count > 1"), f"duplicate {what}")
    return df


def covered(rows: DataFrame, manifest: DataFrame, key: str = "token", expected: int | None = None) -> DataFrame:
    """Exactly ``expected`` rows (or at least one) for every manifest key, and no others."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    wanted = manifest.select(F.col(manifest.columns[0] if key not in manifest.columns else key).alias(key)).distinct().withColumn("wanted", F.lit(True))
    both = counts.join(wanted, key, "full_outer")
    _fail_on(both.where("wanted is null").select(key), "rows outside the training manifest")
    _fail_on(both.where("n is null").select(key), "coverage: manifest keys without rows")
    if expected is not None:
        _fail_on(both.where(F.col("n") != expected).select(key), f"coverage: keys without exactly {expected} rows")
    return rows


def within_manifest(rows: DataFrame, manifest: DataFrame, key: str = "token") -> DataFrame:
    _fail_on(rows.join(manifest.select(key).distinct(), key, "left_anti").select(key), "keys outside the manifest")
    return rows


def required(rows: DataFrame, columns: Sequence[str], key: str = "token") -> DataFrame:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise GuardError(f"missing columns: {', '.join(missing)}")
    if columns:
        bad = F.col(columns[0]).isNull()
        for c in columns[1:]:
            bad = bad | F.col(c).isNull()
        _fail_on(rows.where(bad).select(key), "rows with missing metrics")
    return rows


def disjoint(a: DataFrame, b: DataFrame, key: str = "token") -> None:
    _fail_on(a.select(key).intersect(b.select(key)), "manifests overlap")


def subset(a: DataFrame, b: DataFrame, key: str = "token") -> None:
    _fail_on(a.select(key).subtract(b.select(key)), "keys that the larger manifest lacks")


def dense_steps(log: DataFrame, steps: int, column: str = "step") -> DataFrame:
    """Every step from 1 to ``steps`` exactly once."""
    inside = log.where(F.col(column).between(1, steps))
    unique(inside, column, "steps")
    all_steps = log.sparkSession.range(1, steps + 1).select(F.col("id").cast(dict(log.dtypes)[column]).alias(column))
    _fail_on(all_steps.join(inside.select(column), column, "left_anti"), "missing steps")
    return inside


def exactly(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    found = df.count()
    if found != n:
        raise GuardError(f"{found} {what} where {n} are expected")
    return df


def parallel(df: DataFrame, arrays: Sequence[str], key: str = "token") -> DataFrame:
    """Parallel arrays of one length in each row."""
    bad = F.lit(False)
    for c in arrays[1:]:
        bad = bad | ~F.size(c).eqNullSafe(F.size(arrays[0]))
    _fail_on(df.where(bad).select(key), f"arrays {', '.join(arrays)} differ in length")
    return df


def trajectories(df: DataFrame, column: str, poses: int, width: int = 3, key: str = "token") -> DataFrame:
    bad = (F.size(column) != poses) | F.exists(F.col(column), lambda p: F.size(p) != width)
    _fail_on(df.where(bad).select(key), f"trajectories that are not {poses} x {width}")
    return df
