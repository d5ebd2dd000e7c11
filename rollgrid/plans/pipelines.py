"""Whole chains as one plan: score files to filtered scenes, logs to a training log report, frames to scene scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.functions import scores as S
from rollgrid.operators import groups, guards, manifests, scenes
from rollgrid.sources import readers, writers
from rollgrid.sources.schemas import METRICS


def select_scenes(spark: SparkSession, folder: str, out: str | None = None, include: str | None = None, exclude: str | None = None, **filter_options) -> DataFrame:
    """Score CSVs of a folder, statistics for each token, the scene filter; the tokens that stay, written if asked."""
    scored = readers.score_columns(readers.score_files(spark, folder, include, exclude))
    kept = groups.scene_filter(groups.group_stats(scored), **filter_options)
    if out:
        writers.manifest(kept, out, mode="overwrite")
    return kept


def rank_rollouts(rollouts: DataFrame, manifest: DataFrame, expected: int | None = None) -> DataFrame:
    """The learnability ranking of rollouts that cover a manifest exactly."""
    guards.covered(rollouts, manifest, expected=expected)
    return groups.learnability_ranking(rollouts)


def hard_scenes(rollouts: DataFrame, proxy: DataFrame, full: DataFrame, expected: int = 4, limit: int | None = None) -> DataFrame:
    """Tokens of the proxy manifest (pos, token) that fail in all rollouts, in manifest order."""
    guards.subset(proxy, full)
    guards.covered(rollouts, proxy, expected=expected)
    failed = proxy.join(groups.persistent_failures(rollouts), "token", "left_semi").orderBy("pos")
    return failed.limit(limit) if limit else failed


def scored_summary(rows: DataFrame, comfort: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Final extended scores of scene rows (token, multiplicative_metrics_prod, weighted_metrics_array), with the mean row.

    ``comfort``: (token, extended_comfort) of the tokens that have an adjacent frame; others have none.
    """
    if comfort is not None:
        rows = scenes.updated(rows, comfort, "token")
    if "extended_comfort" not in rows.columns:
        rows = rows.withColumn("extended_comfort", F.lit(None).cast("double"))
    final = rows.withColumn("score", S.extended_score(F.col("multiplicative_metrics_prod"), F.col("weighted_metrics_array"), F.col("extended_comfort"), strict=strict))
    return groups.with_average_row(final)


def driving_scores(rows: DataFrame) -> DataFrame:
    """Plain and scaled scores from the five metrics."""
    m = [F.col(c) for c in METRICS]
    return rows.withColumns({"pdms": S.driving_score(*m), "pdms_scaled": S.scaled_score(*m)})


def training_split(rollouts: DataFrame, train: DataFrame, dev: DataFrame, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    return manifests.routed(rollouts, train, dev, expected_train=expected)
