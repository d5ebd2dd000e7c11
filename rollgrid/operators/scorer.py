"""The proposal scorer as DataFrame operators: areas, collisions, time to collision, lights, direction, lanes, progress.

A proposal is (scene, proposal), a state of it has a step as well. Geometry comes in as rows: points of the vehicle's box
and map polygons are joined over a grid, and ``contacts`` holds the objects that a box meets at a step. What a step-by-step
loop would carry on (a track that met the vehicle without fault is passed over from then on) is the least such step of
each track, so every metric is one or two aggregations that combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.functions import geometry as G
from rollgrid.operators import polygons, scenes, spatial

PROPOSAL = ["scene", "proposal"]
STATE = [*PROPOSAL, "step"]
#: Kinds of map polygons. Fixed values.
LANES = ("LANE", "LANE_CONNECTOR")
DRIVABLE = ("ROADBLOCK", "INTERSECTION", "DRIVABLE_AREA", "CARPARK_AREA")
#: Weights of progress, time to collision, lane keeping and comfort. Fixed values.
WEIGHTS = {"progress": 5.0, "ttc": 5.0, "lane_keeping": 2.0, "comfort": 2.0}
#: Metres of driving against traffic that cost half and all, and of progress that are compared. Fixed values.
DIRECTION, LEAST_PROGRESS = (2.0, 6.0), 5.0
#: Metres per second below which a vehicle stands; metres beside the centre line that may not last. Fixed values.
STOPPED, BESIDE = 5e-3, 0.5


def meet(a: Column, b: Column) -> Column:
    """Whether two rings of (x, y), concave ones too, share a point."""
    return polygons.intersects(polygons.edges(F.array(a)), polygons.edges(F.array(b)))


def contacts(boxes: DataFrame, objects: DataFrame, cell: float = 10.0) -> DataFrame:
    """Objects (scene, step, track, ring) that the boxes (scene, proposal, step, ring) of that step meet."""

    def gridded(df: DataFrame) -> DataFrame:
        xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
        cells = lambda v: F.explode(F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell)))
        return df.withColumn("_cx", cells(xs)).withColumn("_cy", cells(ys))

    met = gridded(boxes).join(gridded(objects).withColumnRenamed("ring", "other"), ["scene", "step", "_cx", "_cy"])
    return met.where(meet(F.col("ring"), F.col("other"))).drop("_cx", "_cy", "ring", "other").distinct()


def ego_areas(points: DataFrame, polygons: DataFrame, cell: float = 10.0, axle: bool = False) -> DataFrame:
    """Per state: several lanes, off the drivable area, against traffic, in an intersection.

    ``points`` are (scene, proposal, step, corner, x, y), corners 0 to 3, the centre as 4 and, for ``axle``, the rear axle
    as 5, which gives a column axle_crossing too; ``polygons`` are (gid, kind, on_route, ring).
    """
    pid = F.struct(*STATE, "corner").alias("pid")
    hits = spatial.points_in_polygons(points.select(pid, "x", "y"), polygons.select("gid", "ring"), cell)
    hits = hits.join(polygons.select("gid", "kind", "on_route"), "gid").select("pid.*", "gid", "kind", "on_route")
    return areas_of(points, hits, axle)


def areas_of(points: DataFrame, hits: DataFrame, axle: bool = False) -> DataFrame:
    """``ego_areas`` of points from the polygons that hold them: (scene, proposal, step, corner, gid, kind, on_route)."""
    each = _by_polygon(hits)
    lane, drivable = F.col("kind").isin(*LANES), F.col("kind").isin(*DRIVABLE)
    found = each.groupBy(*STATE).agg(
        F.sum((lane & (F.col("n") > 0)).cast("int")).alias("lanes"),
        F.max(F.when(lane, F.col("n"))).alias("most"),
        F.bit_or(F.when(drivable, F.col("corners")).otherwise(F.lit(0))).alias("covered"),
        F.max(lane & F.col("on_route") & F.col("centre")).alias("routed"),
        F.max((F.col("kind") == "INTERSECTION") & F.col("centre")).alias("crossing"),
        F.max((F.col("kind") == "INTERSECTION") & F.col("axle")).alias("axle_crossing"),
    )
    states = points.select(*STATE).distinct().join(found, STATE, "left")
    known = lambda c, value: F.coalesce(F.col(c), F.lit(value))
    return states.select(
        *STATE,
        ((known("lanes", 0) > 1) & (known("most", 0) != 4)).alias("multiple_lanes"),
        (known("covered", 0) != 15).alias("off_road"),
        (~known("routed", False)).alias("oncoming"),
        known("crossing", False).alias("crossing"),
        *([known("axle_crossing", False).alias("axle_crossing")] if axle else []),
    )


def _by_polygon(hits: DataFrame) -> DataFrame:
    """Corners and centre of each state inside each polygon."""
    bits = F.element_at(F.array(*[F.lit(1 << i) for i in range(4)], F.lit(0), F.lit(0)), F.col("corner").cast("int") + 1)
    grouped = hits.groupBy(*STATE, "gid", "kind", "on_route")
    return grouped.agg(F.sum((F.col("corner") < 4).cast("int")).alias("n"), F.bit_or(bits).alias("corners"), F.max(F.col("corner") == 4).alias("centre"), F.max(F.col("corner") == 5).alias("axle"))


def _considered(met: DataFrame, collided: DataFrame | None, steps: int | None, prefix: str) -> DataFrame:
    """Contacts but for red lights, tracks that met the vehicle before the start (scene, track), and steps from ``steps`` on."""
    out = met.where(~F.startswith(F.col("track").cast("string"), F.lit(prefix)))
    if collided is not None:
        out = out.join(collided.select("scene", "track").distinct(), ["scene", "track"], "left_anti")
    return out if steps is None else out.where(F.col("step") < steps)


def _faulty(met: DataFrame, fault: Column, order: Column) -> DataFrame:
    """Contacts at fault that come before the first one without fault of their proposal and track."""
    marked = met.withColumn("_fault", F.coalesce(fault, F.lit(False))).withColumn("_at", order)
    passed = F.min(F.when(~F.col("_fault"), F.col("_at"))).over(W.partitionBy(*PROPOSAL, "track"))
    return marked.withColumn("_passed", passed).where(F.col("_fault") & (F.col("_passed").isNull() | (F.col("_at") < F.col("_passed"))))


def no_fault(met: DataFrame, areas: DataFrame, proposals: DataFrame, collided: DataFrame | None = None, steps: int | None = None, prefix: str = "red_light") -> DataFrame:
    """Per proposal the least score of its collisions at fault (0 for agents, 0.5 for static objects, else 1), and the
    first step of one. Contacts have track, kind (see ``kernels.at_fault``) and agent. Red lights are no collisions, nor
    are tracks that met the vehicle before the start (``collided``: scene, track); the states before ``steps`` count."""
    each = _considered(met, collided, steps, prefix).join(areas.select(*STATE, "multiple_lanes", "off_road"), STATE, "left")
    fault = F.col("kind").isin("active_front", "stopped_track") | ((F.col("kind") == "active_lateral") & (F.col("multiple_lanes") | F.col("off_road")))
    found = _faulty(each, fault, F.col("step")).groupBy(*PROPOSAL).agg(F.min(F.when(F.col("agent"), 0.0).otherwise(0.5)).alias("score"), F.min("step").alias("first"))
    return proposals.select(*PROPOSAL).distinct().join(found, PROPOSAL, "left").select(*PROPOSAL, F.coalesce("score", F.lit(1.0)).alias("score"), "first")


def moved_boxes(states: DataFrame, later: list[int], interval: float) -> DataFrame:
    """Boxes (scene, proposal, step, ring, speed, heading) moved on straight for some numbers of steps: a row for each,
    with the column later, its step of origin as begin, and the step that it reaches."""
    each = states.withColumn("later", F.explode(F.array(*[F.lit(int(n)) for n in later])))
    gone = F.col("speed") * F.col("later") * F.lit(interval)
    ring = F.transform("ring", lambda p: F.struct((p["x"] + F.cos("heading") * gone).alias("x"), (p["y"] + F.sin("heading") * gone).alias("y")))
    return each.select(*PROPOSAL, F.col("step").alias("begin"), "later", (F.col("step") + F.col("later")).alias("step"), ring.alias("ring"), "speed", "heading")


def with_history(states: DataFrame, past: DataFrame) -> DataFrame:
    """States (scene, proposal, states: array by step) with the scene's past ones (scene, states), whose last is the first
    of the simulated, before them. Scenes without a past stay as they are."""
    joined = states.join(past.select("scene", F.col("states").alias("_past")), "scene", "left")
    whole = F.when(F.col("_past").isNull(), F.col("states")).otherwise(F.concat("_past", F.slice("states", F.lit(2), F.greatest(F.size("states") - 1, F.lit(0)))))
    return joined.withColumn("states", whole).drop("_past")


def time_to_collision(met: DataFrame, areas: DataFrame, proposals: DataFrame, stopped: float = STOPPED, collided: DataFrame | None = None, steps: int | None = None, prefix: str = "red_light") -> DataFrame:
    """Per proposal 0 where its box, moved on at its speed, meets a track that it would run into, else 1, and that step.

    Contacts have step, later (steps ahead), track, speed, ahead and behind. Vehicles that stand are passed over, and red
    lights and ``collided`` tracks, as in ``no_fault``. Where ``areas`` say whether the rear axle is in an intersection
    (axle_crossing), that decides, else its centre.
    """
    each = _considered(met, collided, steps, prefix).where(F.col("speed") >= stopped).join(areas, STATE, "left")
    loose = F.col("multiple_lanes") | F.col("off_road") | F.col("axle_crossing" if "axle_crossing" in areas.columns else "crossing")
    fault = F.col("ahead") | (loose & ~F.col("behind"))
    found = _faulty(each, fault, F.struct("step", "later")).groupBy(*PROPOSAL).agg(F.min("step").alias("first"))
    return proposals.select(*PROPOSAL).distinct().join(found, PROPOSAL, "left").select(*PROPOSAL, F.when(F.col("first").isNull(), 1.0).otherwise(0.0).alias("score"), "first")


def lights(met: DataFrame, proposals: DataFrame, prefix: str = "red_light") -> DataFrame:
    """Per proposal 0 where it meets a red light, else 1."""
    red = met.where(F.startswith(F.col("track"), F.lit(prefix))).select(*PROPOSAL).distinct().withColumn("_red", F.lit(True))
    return proposals.select(*PROPOSAL).distinct().join(red, PROPOSAL, "left").select(*PROPOSAL, F.when(F.col("_red"), 0.0).otherwise(1.0).alias("score"))


def on_road(areas: DataFrame) -> DataFrame:
    """Per proposal 0 where any state leaves the drivable area, else 1."""
    return areas.groupBy(*PROPOSAL).agg(F.when(F.max("off_road"), 0.0).otherwise(1.0).alias("score"))


def direction(centres: DataFrame, areas: DataFrame, horizon: int, bounds: tuple[float, float] = DIRECTION) -> DataFrame:
    """Per proposal 1, 0.5 or 0 by the most metres driven against traffic within a horizon of steps; centres are states
    with x and y. Intersections do not count."""
    w = W.partitionBy(*PROPOSAL).orderBy("step")
    moved = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2)))
    each = centres.withColumn("_m", F.coalesce(moved, F.lit(0.0))).join(areas.select(*STATE, "oncoming", "crossing"), STATE)
    against = F.when(F.col("oncoming") & ~F.col("crossing"), F.col("_m")).otherwise(0.0)
    sums = each.withColumn("_a", against).withColumn("_s", F.sum("_a").over(w.rowsBetween(-horizon, 0)))
    total = F.max("_s")
    return sums.groupBy(*PROPOSAL).agg(F.when(total < bounds[0], 1.0).when(total < bounds[1], 0.5).otherwise(0.0).alias("score"))


def lane_keeping(centres: DataFrame, areas: DataFrame, steps: int, beside: float = BESIDE) -> DataFrame:
    """Per proposal 0 where it stays more than ``beside`` off the centre line (column deviation) for ``steps`` states in a
    row, else 1. States in an intersection are passed over and end no run."""
    each = centres.join(areas.select(*STATE, "crossing"), STATE)
    flag = F.when(~F.col("crossing"), F.col("deviation") > beside)
    key = F.struct(*PROPOSAL).alias("key")
    runs = scenes.longest_runs(each.withColumn("key", key), "key", ["step"], flag)
    return runs.select("key.*", F.when(F.col(runs.columns[-1]) >= steps, 0.0).otherwise(1.0).alias("score"))


def progress(ends: DataFrame) -> DataFrame:
    """Metres along a centre line (array of points) from the first to the last centre (x0, y0, x1, y1), 0 at least."""
    along = G.projected(F.col("line"), F.col("x1"), F.col("y1")) - G.projected(F.col("line"), F.col("x0"), F.col("y0"))
    return ends.select(*PROPOSAL, F.greatest(along, F.lit(0.0)).alias("progress"))


def score_proposals(rows: DataFrame, least: float = LEAST_PROGRESS) -> DataFrame:
    """Per proposal the product of its gates (no_fault, on_road, direction, lights) times the weighted mean of progress, ttc,
    lane_keeping and comfort. Progress is compared with the best gated progress of the scene, if that is over ``least``."""
    gate = F.col("no_fault") * F.col("on_road") * F.col("direction") * F.col("lights")
    best = F.max(F.col("progress") * F.col("gate")).over(W.partitionBy("scene"))
    each = rows.withColumn("gate", gate).withColumn("_best", best)
    share = F.when(F.col("_best") > least, F.least(F.greatest(F.col("progress") / F.col("_best"), F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    values = {"progress": share, "ttc": F.col("ttc"), "lane_keeping": F.col("lane_keeping"), "comfort": F.col("comfort")}
    mean = sum((values[name] * w for name, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return each.select(*PROPOSAL, share.alias("progress"), (F.col("gate") * mean).alias("score"))
