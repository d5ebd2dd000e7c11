"""Traffic, proposals and paths: agents moved in columns, plans unrolled by kernels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from rollgrid.functions import geometry as G
from rollgrid.operators import kernels


def constant_velocity(agents: DataFrame, steps: int, interval: float) -> DataFrame:
    """Agents (scene, agent, x, y, vx, vy, heading) at each step of straight motion."""
    each = agents.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    t = F.col("step") * interval
    return each.withColumns({"x": F.col("x") + F.col("vx") * t, "y": F.col("y") + F.col("vy") * t})


def replayed(tracks: DataFrame, overlapping: DataFrame) -> DataFrame:
    """Recorded tracks (scene, agent, ...) without the agents that overlap the vehicle at the start (scene, agent)."""
    return tracks.join(overlapping.select("scene", "agent").distinct(), ["scene", "agent"], "left_anti")


def observed(agents: DataFrame, overlapping: DataFrame, steps: int, interval: float) -> DataFrame:
    """Agents at each step of straight motion, without those that overlap the vehicle at the start."""
    return constant_velocity(replayed(agents, overlapping), steps, interval)


def leading(objects: DataFrame, proposals: DataFrame, prefix: str = "red_light", key: Sequence[str] = ("scene", "proposal")) -> DataFrame:
    """The object that each proposal follows: (scene, proposal, token, lead_progress, lead_velocity).

    ``objects`` (scene, proposal, token, progress, distance, speed, heading) lie in the corridor of a proposal;
    ``proposals`` have ego_progress, ego_heading and path_length. Of the objects ahead the nearest leads, of equal ones the
    smallest token, at its distance from the vehicle and the speed along it, which is 0 for a red light. Without any, the
    end of the path leads.
    """
    key = list(key)
    ahead = objects.join(proposals.select(*key, "ego_progress"), key).where(F.col("progress") > F.col("ego_progress"))
    nearest = ahead.groupBy(*key).agg(F.min(F.struct("distance", "token", "speed", "heading")).alias("o"))
    led = proposals.join(nearest, key, "left")
    along = F.when(F.startswith(F.col("o.token"), F.lit(prefix)), F.lit(0.0)).otherwise(F.col("o.speed") * F.cos(F.col("o.heading") - F.col("ego_heading")))
    return led.select(
        *key,
        F.col("o.token").alias("token"),
        F.coalesce(F.col("ego_progress") + F.col("o.distance"), F.col("path_length")).alias("lead_progress"),
        F.coalesce(along, F.lit(0.0)).alias("lead_velocity"),
    )


def mixed_traffic(simulated: DataFrame, recorded: DataFrame, types: Sequence[str], kind: str = "type") -> DataFrame:
    """Simulated agents of the given types and the recorded ones of all others."""
    return simulated.where(F.col(kind).isin(list(types))).unionByName(recorded.where(~F.col(kind).isin(list(types))), allowMissingColumns=True)


def agent_arrays(tracks: DataFrame, steps: int) -> DataFrame:
    """Per agent the poses of all steps, gaps filled from the last one known, and which steps were seen."""
    seen = tracks.groupBy("scene", "agent").agg(F.map_from_entries(F.collect_list(F.struct("step", G.pose(F.col("x"), F.col("y"), F.col("heading"))))).alias("m"))
    grid = seen.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("p", F.try_element_at("m", F.col("step").cast(dict(tracks.dtypes)["step"])))
    w = W.partitionBy("scene", "agent").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    filled = grid.withColumn("f", F.last("p", ignorenulls=True).over(w))
    item = F.struct("step", "f", F.col("p").isNotNull().alias("s"))
    out = filled.groupBy("scene", "agent").agg(F.sort_array(F.collect_list(item)).alias("a"))
    return out.select("scene", "agent", F.col("a")["f"].alias("poses"), F.col("a")["s"].alias("seen"))


def first_by_step(objects: DataFrame, order: str) -> DataFrame:
    """One object for each (scene, step, token): the first in order."""
    place = F.row_number().over(W.partitionBy("scene", "step", "token").orderBy(order))
    return objects.withColumn("_n", place).where("_n = 1").drop("_n")


def relevant(objects: DataFrame, vehicle: str, radius: float, collided: DataFrame | None = None) -> DataFrame:
    """Objects within a radius of the vehicle (columns ego_x, ego_y), without the vehicle itself and collided tracks."""
    near = objects.where((F.col("token") != vehicle) & (F.sqrt(F.pow(F.col("x") - F.col("ego_x"), F.lit(2)) + F.pow(F.col("y") - F.col("ego_y"), F.lit(2))) <= radius))
    return near if collided is None else near.join(collided.select("token").distinct(), "token", "left_anti")


def red_lights(lights: DataFrame, lanes: DataFrame, prefix: str = "red_light") -> DataFrame:
    """Polygons of route lanes (lane, ring) whose light (lane, status) is red, named prefix_lane."""
    return lights.where("status = 'RED'").join(lanes, "lane").select(F.concat_ws("_", F.lit(prefix), F.col("lane").cast("string")).alias("token"), "ring")


def proposals(scenes: DataFrame, offsets: Sequence[float], fractions: Sequence[float], limit: str = "speed_limit", fallback: float = 15.0) -> DataFrame:
    """Every lateral offset with every speed fraction: offset, target speed, proposal number."""
    pairs = F.array(*[F.struct(F.lit(i * len(fractions) + j).alias("proposal"), F.lit(float(o)).alias("offset"), F.lit(float(f)).alias("fraction")) for i, o in enumerate(offsets) for j, f in enumerate(fractions)])
    each = scenes.withColumn("_p", F.explode(pairs)).select("*", "_p.*").drop("_p")
    return each.withColumn("target", F.col("fraction") * F.coalesce(F.col(limit), F.lit(fallback)))


def unrolled(df: DataFrame, key: str, steps: int, interval: float) -> DataFrame:
    """Rows (key, proposal, path array of (x, y, heading), speed, target, lead gap and speed or NULL) as trajectories
    along their path, following the lead object if there is one."""

    def run(frames):
        for frame in frames:
            outs = []
            for path, offset, speed, target, gap, lead in zip(frame["path"], frame["offset"], frame["speed"], frame["target"], frame["lead_gap"], frame["lead_speed"]):
                points = np.array([[p["x"], p["y"], p["heading"]] for p in path], float)
                along = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(points[:, :2], axis=0).T))])
                times = np.arange(1, steps + 1) * interval
                free = pd.isna(gap)
                lead = 0.0 if free or pd.isna(lead) else lead
                ahead = np.full(steps, 1e9) if free else gap + lead * times
                rolled = kernels.follow(0.0, speed, ahead, np.full(steps, lead), target, interval)
                pose = kernels.resampled(along, points, rolled[:, 0], angles=[2])
                pose[:, 0] -= offset * np.sin(pose[:, 2])
                pose[:, 1] += offset * np.cos(pose[:, 2])
                outs.append([{"x": x, "y": y, "heading": h} for x, y, h in pose])
            yield pd.DataFrame({key: frame[key], "proposal": frame["proposal"], "poses": outs})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "proposal", "path", "offset", "speed", "target", "lead_gap", "lead_speed").mapInPandas(run, f"{key} {kind}, proposal int, poses array<struct<x:double,y:double,heading:double>>")


def braking(scored: DataFrame, safe_time: float = 2.0) -> Column:
    """Whether the best plan has to be overridden: a collision is near and no proposal avoids it."""
    return (F.col("time_to_collision") <= safe_time) & (F.col("best_score") <= 0)


def best_proposal(scored: DataFrame, key: str, score: str = "score", proposal: str = "proposal") -> DataFrame:
    """The proposal of the highest score; of equal ones the first."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col(score).desc(), proposal))
    return scored.withColumn("_n", place).where("_n = 1").drop("_n")


def with_traffic_score(rows: DataFrame, agents: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Each row with the mean scores of its scene's agents, prefixed traffic_; without agents NULL."""
    means = agents.groupBy(key).agg(*[F.avg(c).alias(f"traffic_{c}") for c in columns])
    return rows.join(means, key, "left")


def successes(df: DataFrame, f, key: str, schema: str) -> DataFrame:
    """f(row) for each row, with valid = true; a row on which it fails keeps its key, NULL results and valid = false.

    ``schema`` names the key and the results of ``f``.
    """
    kind = StructType.fromDDL(schema)

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                try:
                    rows.append({key: r[key], **f(r), "valid": True})
                except Exception:  # a failing scene must not stop the others
                    rows.append({key: r[key], "valid": False})
            if rows:
                yield pd.DataFrame(rows, columns=[*kind.names, "valid"])

    return df.mapInPandas(run, StructType([*kind.fields, StructField("valid", BooleanType(), False)]))
