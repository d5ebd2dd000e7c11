"""Frame windows, adjacency and two-stage scene scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FrameWindow:
    """History and future frames of a scene, and the hop to the next (by default a whole window)."""

    history: int = 4
    future: int = 10
    hop: int | None = None

    def __post_init__(self) -> None:
        if self.history < 1 or self.future < 0 or (self.hop is not None and self.hop < 1):
            raise ValueError("a window needs history >= 1, future >= 0 and hop >= 1")

    @property
    def size(self) -> int:
        return self.history + self.future


def hopping_windows(frames: DataFrame, window: FrameWindow, log: str = "log_name", order: Sequence[str] = ("idx",), columns: Sequence[str] = ("token",)) -> DataFrame:
    """Full windows of consecutive frames of each log: (log, order of the first frame, frames array<struct>).

    A partial window at the end of a log makes no row.
    """
    w = W.partitionBy(log).orderBy(*order)
    item = F.struct(*[F.col(c) for c in columns])
    marked = frames.withColumns({"_n": F.row_number().over(w) - 1, "frames": F.collect_list(item).over(w.rowsBetween(0, window.size - 1))})
    return marked.where((F.col("_n") % (window.hop or window.size) == 0) & (F.size("frames") == window.size)).select(log, *order, "frames")


def valid_scenes(windows: DataFrame, window: FrameWindow, tokens: DataFrame | None = None, route: str | None = None, token: str = "token") -> DataFrame:
    """Windows whose last history frame has a route and a wanted token."""
    now = F.element_at("frames", window.history)
    out = windows.withColumn(token, now[token])
    if route is not None:
        out = out.where(F.size(now[route]) > 0)
    if tokens is not None:
        out = out.join(tokens.select(F.col(tokens.columns[0]).alias(token)).distinct(), token, "left_semi")
    return out


def two_windows(frames: DataFrame, scene: str = "scene_token", order: str = "frame_idx", length: int = 4, column: str = "token") -> DataFrame:
    """Scenes of exactly length + 1 frames, as their first and last ``length`` frames."""
    whole = frames.groupBy(scene).agg(F.sort_array(F.collect_list(F.struct(order, column))).alias("f")).where(F.size("f") == length + 1)
    return whole.select(scene, F.explode(F.array(F.lit(0), F.lit(1))).alias("offset"), "f").select(scene, "offset", F.slice("f", F.col("offset") + 1, F.lit(length))[column].alias("frames"))


def adjacent(rows: DataFrame, log: str = "log_name", token: str = "token", time: str = "start_time", gap: float = 0.55, extra: Sequence[str] = ()) -> DataFrame:
    """Each row with the one just before it in its log, where that is at most ``gap`` away: now, prev, dt."""
    w = W.partitionBy(log).orderBy(time, token)
    out = rows.select(log, F.col(token).alias("now"), F.lag(token).over(w).alias("prev"), (F.col(time) - F.lag(time).over(w)).alias("dt"), *extra)
    return out.where(F.col("prev").isNotNull() & (F.abs("dt") <= gap))


def rolling_sums(rows: DataFrame, key: str, order: Sequence[str], value: str, length: int = 11) -> DataFrame:
    """The largest sum of ``length`` trailing rows of each key (fewer at the start)."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(-(length - 1), 0)
    return rows.withColumn("_sum", F.sum(value).over(w)).groupBy(key).agg(F.max("_sum").alias("largest"))


def longest_runs(rows: DataFrame, key: str, order: Sequence[str], flag: Column) -> DataFrame:
    """Length of the longest run of rows with the flag; rows where it is NULL are passed over and end no run."""
    w = W.partitionBy(key).orderBy(*order)
    seen = rows.withColumn("_flag", flag).where("_flag is not null")
    runs = seen.withColumn("_run", F.row_number().over(w) - F.sum(F.col("_flag").cast("int")).over(w))
    lengths = runs.groupBy(key, "_run").agg(F.sum(F.col("_flag").cast("int")).alias("_n"))
    return lengths.groupBy(key).agg(F.max("_n").alias("longest"))


def resampled(rows: DataFrame, key: str, time: str, value: str, step: int) -> DataFrame:
    """Values on the grid of multiples of ``step`` (seconds), linearly between neighbouring rows of one key.

    Grid points come from the gap between two rows only, so the plan is one window and an explode.
    """
    w = W.partitionBy(key).orderBy(time)
    gaps = rows.select(key, F.col(time).cast("double").alias("t0"), F.col(value).cast("double").alias("v0"), F.lead(F.col(time).cast("double")).over(w).alias("t1"), F.lead(F.col(value).cast("double")).over(w).alias("v1"))
    first = F.ceil(F.col("t0") / step).cast("long")
    last = F.ceil(F.col("t1") / step).cast("long") - 1  # the next row's own grid point belongs to its gap
    inner = gaps.where("t1 > t0").where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    return inner.select(key, (F.col("k") * step).alias("at"), (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("k") * step - F.col("t0")) / (F.col("t1") - F.col("t0"))).alias("value"))


def forward_filled(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def unwrapped(rows: DataFrame, key: str, order: Sequence[str], angle: str) -> DataFrame:
    """Angles without jumps of whole turns."""
    import math

    w = W.partitionBy(key).orderBy(*order)
    jump = F.coalesce(F.rint((F.col(angle) - F.lag(angle).over(w)) / (2 * math.pi)), F.lit(0.0))
    return rows.withColumn("_jump", jump).withColumn(angle, F.col(angle) - 2 * math.pi * F.sum("_jump").over(w)).drop("_jump")


def kernel_weights(pairs: DataFrame, key: str, distance: str, spread: float = 0.1) -> DataFrame:
    """exp(-d^2 / (2 spread)) normalised inside each key; uniform where the sum is about 0 or undefined."""
    w = W.partitionBy(key)
    raw = F.exp(-F.col(distance) * F.col(distance) / (2 * spread))
    total = F.sum("_raw").over(w)
    n = F.count(F.lit(1)).over(w)
    bad = total.isNull() | F.isnan(total) | (F.abs(total) <= 1e-8)
    return pairs.withColumn("_raw", raw).withColumn("weight", F.when(bad, 1.0 / n).otherwise(F.col("_raw") / total)).drop("_raw")


def weighted_means(rows: DataFrame, weight: str, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of each column; a total weight of 0 gives NULL and NaN values stay NaN."""
    return rows.groupBy(*key).agg(*[F.try_divide(F.sum(F.col(weight) * F.col(c)), F.sum(weight)).alias(c) for c in columns])


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``changes`` written over; NULL and NaN changes leave the old value."""
    names = [c for c in changes.columns if c != key]
    there = [c for c in names if c in rows.columns]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    out = rows.join(new, key, "left")
    kinds = dict(changes.dtypes)

    def value(c: str) -> Column:
        fresh = F.col(f"_new_{c}")
        return F.when(~F.isnan(fresh), fresh) if kinds[c] in ("double", "float") else fresh

    return out.withColumns({c: F.coalesce(value(c), F.col(c)) if c in there else value(c) for c in names}).drop(*[f"_new_{c}" for c in names])


def two_stage_scores(first: DataFrame, second: DataFrame, mapping: DataFrame, score: str = "score", weight: str = "weight") -> DataFrame:
    """One row per mapping and the parts of its score.

    ``mapping``: (now, prev, pairs array<struct<now, prev>>). Each side of a mapping is the product of its first-stage
    score and the weighted mean of its second-stage scores; the mapping's score is the mean of both sides, undefined
    sides passed over.
    """
    base = mapping.select(F.monotonically_increasing_id().alias("id"), "*").select("id", "now", "prev", "pairs")
    keyed = base.select(F.concat_ws("|", "now", "prev").alias("mapping"), "now", "prev", "pairs")
    sides = []
    for side in ("now", "prev"):
        members = keyed.select("mapping", F.explode_outer(F.col("pairs")[side]).alias("token"))
        mean = weighted_means(members.join(second.select("token", score, weight), "token"), weight, [score], ["mapping"]).withColumnRenamed(score, f"second_{side}")
        own = keyed.select("mapping", F.col(side).alias("token")).join(first.select("token", score), "token", "left").select("mapping", F.col(score).alias(f"first_{side}"))
        sides.append(own.join(mean, "mapping", "left").withColumn(f"side_{side}", F.col(f"first_{side}") * F.col(f"second_{side}")))
    out = sides[0].join(sides[1], "mapping")
    defined = F.filter(F.array("side_now", "side_prev"), lambda x: x.isNotNull() & ~F.isnan(x))
    return out.withColumn("score", F.try_divide(F.aggregate(defined, F.lit(0.0), lambda a, x: a + x), F.size(defined)))


def stage_columns(rows: DataFrame, columns: Sequence[str], kind: str = "frame_type", score: str | None = None) -> DataFrame:
    """Each column as {column}_stage_one where the kind is 0 and {column}_stage_two elsewhere, and the score in one."""
    out = rows
    for c in columns:
        out = out.withColumns({f"{c}_stage_one": F.when(F.col(kind) == 0, F.col(c)), f"{c}_stage_two": F.when(F.col(kind) != 0, F.col(c))})
    return out.withColumn("final_score", F.coalesce(f"{score}_stage_one", f"{score}_stage_two")) if score else out


def normalised_progress(proposals: DataFrame, token: str = "token", progress: str = "progress", gate: str = "gate", least: float = 5.0) -> DataFrame:
    """Progress over the best gated progress of the scene's proposals, 1 where that is no more than ``least``."""
    best = F.max(F.col(progress) * F.col(gate)).over(W.partitionBy(token))
    return proposals.withColumn("progress_score", F.when(best > least, F.least(F.lit(1.0), F.col(progress) / best)).otherwise(F.lit(1.0)))
