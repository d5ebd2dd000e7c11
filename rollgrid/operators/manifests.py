"""Joins of rows with manifests: membership, routing, pending work, and paired comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.operators import guards


def members(rows: DataFrame, manifest: DataFrame, key: str = "token", field: str | None = None) -> DataFrame:
    """Rows whose key (or nested field) is in the manifest."""
    wanted = manifest.select(F.col(manifest.columns[0] if key not in manifest.columns else key).alias("_wanted")).distinct()
    return rows.join(wanted, F.col(field or key) == F.col("_wanted"), "left_semi")


def routed(rows: DataFrame, train: DataFrame, dev: DataFrame, key: str = "token", expected_train: int | None = None, expected_dev: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the train and of the dev manifest; rows of neither fail, as do manifests that overlap."""
    guards.disjoint(train, dev, key)
    known = train.select(key).unionByName(dev.select(key)).distinct()
    guards._fail_on(rows.join(known, key, "left_anti").select(key), "rows outside both manifests")
    out = members(rows, train, key), members(rows, dev, key)
    for part, manifest, n in ((out[0], train, expected_train), (out[1], dev, expected_dev)):
        guards.covered(part, manifest, key, n)
    return out


def pending(manifest: DataFrame, done: DataFrame, key: str = "token", log: str = "log_name") -> DataFrame:
    """Manifest keys that are not done, gathered by log; done keys outside the manifest fail."""
    guards.within_manifest(done, manifest, key)
    return manifest.join(done.select(key), key, "left_anti").groupBy(log).agg(F.sort_array(F.collect_list(key)).alias("tokens"))


def set_counts(a: DataFrame, b: DataFrame, key: str = "token") -> DataFrame:
    """Keys on both sides, on the left only and on the right only."""
    left, right = (x.select(key).distinct().withColumn(n, F.lit(1)) for x, n in ((a, "_a"), (b, "_b")))
    both = left.join(right, key, "full_outer")
    return both.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("_b").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("_a").isNull(), 1)).alias("right_only"))


def paired_differences(base: DataFrame, candidate: DataFrame, metrics: Sequence[str], key: str = "token", manifest: DataFrame | None = None) -> DataFrame:
    """One row per metric: mean of either side and of candidate - base over the keys, which must match one to one."""
    for side in (base, candidate):
        guards.unique(side, key)
        guards.required(side, metrics, key)
        if manifest is not None:
            guards.covered(side, manifest, key, 1)
    guards._fail_on(base.select(key).exceptAll(candidate.select(key)).unionByName(candidate.select(key).exceptAll(base.select(key))), "keys on one side only")
    return long_differences(base, candidate, metrics, key).groupBy("metric").agg(F.avg("base").alias("base"), F.avg("candidate").alias("candidate"), F.avg("difference").alias("difference"), F.count(F.lit(1)).alias("n"))


def long_differences(base: DataFrame, candidate: DataFrame, metrics: Sequence[str], key: str = "token") -> DataFrame:
    both = base.select(key, *[F.col(m).cast("double").alias(f"a_{m}") for m in metrics]).join(candidate.select(key, *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics]), key)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("base"), F.col(f"b_{m}").alias("candidate")) for m in metrics])).alias("z")
    return both.select(key, rows).select(key, "z.*").withColumn("difference", F.col("candidate") - F.col("base"))


def complete(files: DataFrame, builders: Sequence[str], key: str = "token", builder: str = "builder") -> DataFrame:
    """Keys for which every builder has left a file."""
    return files.where(F.col(builder).isin(list(builders))).groupBy(key).agg(F.countDistinct(builder).alias("n")).where(F.col("n") == len(set(builders))).select(key)


def two_stage_tokens(original: DataFrame, synthetic: DataFrame, wanted: DataFrame | None, key: str = "token") -> DataFrame | None:
    """Original tokens and the wanted ones of the synthetic; None without a list of wanted ones."""
    if wanted is None:
        return None
    return original.select(key).union(synthetic.select(key).intersect(wanted.select(key))).distinct()


def route_lanes(routes: DataFrame, blocks: DataFrame, connectors: DataFrame) -> DataFrame:
    """Lanes of each route (route, ids): ids once, in order, from blocks or else from connectors (id, lanes)."""
    each = routes.select("route", F.posexplode(F.array_distinct("ids")).alias("pos", "id"))
    b, c = blocks.select("id", F.col("lanes").alias("_b")), connectors.select("id", F.col("lanes").alias("_c"))
    found = each.join(b, "id", "left").join(c, "id", "left").withColumn("lanes", F.coalesce("_b", "_c"))
    return found.select("route", "pos", "id", F.explode("lanes").alias("lane"))
