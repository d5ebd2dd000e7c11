"""Proposals scored in one call, from their states, the objects around them, the map and a centre line.

Every metric is one of ``scorer``'s aggregations by proposal; here their inputs are made: the box of each state, the
polygons of its scene that hold its corners, the objects it meets now or when moved on, and its place beside the centre line.
Scenes are rows like all else, so a scene with many proposals or objects is spread over tasks. What several metrics read is
written once and read again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.functions import geometry as G
from rollgrid.operators import kernels, polygons, scorer
from rollgrid.operators.scorer import PROPOSAL, STATE
from rollgrid.operators.storage import stored

#: The vehicle's length and width, and its rear axle's distance from the centre. Fixed values.
VEHICLE = (5.176, 2.297, 1.461)
#: Metres per second up to which something stands; degrees within which something is ahead or behind. Fixed values.
STANDS, TOLERANCE = 5e-2, 30.0
#: Seconds looked ahead for collisions and the steps between looks, of driving against traffic, and beside the line. Fixed values.
AHEAD, LOOKS, AGAINST, ASIDE = 1.0, 3, 1.0, 2.0
#: Corners and polygons of one scene up to which a cell of the map is not split.
LEAST = 4096


def _bearing(x: Column, y: Column) -> tuple[Column, Column]:
    """Whether a point is ahead of and behind the rear axle (x, y, heading)."""
    dx, dy = x - F.col("x"), y - F.col("y")
    cosine = F.try_divide(dx * F.cos("heading") + dy * F.sin("heading"), F.sqrt(dx * dx + dy * dy))
    within = math.cos(math.radians(TOLERANCE))
    return F.coalesce(cosine > within, F.lit(False)), F.coalesce(cosine < -within, F.lit(False))


def vehicles(states: DataFrame, vehicle: tuple[float, float, float] = VEHICLE) -> DataFrame:
    """States (scene, proposal, step, state) as x, y, heading, speed, ring and centre of the vehicle's box."""
    at = lambda i: F.get("state", F.lit(i))
    out = states.select(*STATE, at(kernels.X).alias("x"), at(kernels.Y).alias("y"), at(kernels.HEADING).alias("heading"), F.hypot(at(kernels.VX), at(kernels.VY)).alias("speed"))
    length, width, rear = vehicle
    out = out.withColumn("_c", G.corners(F.struct("x", "y", "heading"), length, width, rear))
    return out.withColumns({"ring": F.slice("_c", 1, 4), "cx": F.get("_c", F.lit(4))["x"], "cy": F.get("_c", F.lit(4))["y"]}).drop("_c")


def areas(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Areas of each state by the polygons of its scene (scene, gid, kind, on_route, rings), the rear axle's intersection too."""
    axle = F.struct("x", "y")
    every = boxes.select(*STATE, F.posexplode(F.concat("ring", F.array(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")), axle))).alias("corner", "p"))
    points = every.select(*STATE, "corner", "p.x", "p.y")
    found = polygons.points_in(points.select("scene", F.struct("proposal", "step", "corner").alias("pid"), "x", "y"), regions.select("scene", "gid", "rings"), ["scene"], least=LEAST)
    hits = found.join(regions.select("scene", "gid", "kind", "on_route"), ["scene", "gid"]).select("scene", "pid.*", "gid", "kind", "on_route")
    return scorer.areas_of(points, hits, axle=True)


def collisions(boxes: DataFrame, objects: DataFrame) -> DataFrame:
    """(scene, proposal, step, track, agent, kind): the objects that each box meets, and how (see ``kernels.at_fault``)."""
    things = objects.select("scene", "step", "track", "agent", F.col("speed").alias("track_speed"), F.col("ring").alias("shape"), "ring")
    met = scorer.contacts(boxes.withColumn("box", F.col("ring")), things)
    middle = lambda c: F.aggregate("shape", F.lit(0.0), lambda s, p: s + p[c]) / F.size("shape")
    _, behind = _bearing(middle("x"), middle("y"))
    front = scorer.meet(F.array(F.get("box", F.lit(0)), F.get("box", F.lit(3))), F.col("shape"))
    kind = F.when(F.col("speed") <= STANDS, "stopped_ego").when(F.col("track_speed") <= STANDS, "stopped_track").when(behind, "active_rear").when(front, "active_front").otherwise("active_lateral")
    return met.select(*STATE, "track", "agent", kind.alias("kind"))


def approaches(boxes: DataFrame, objects: DataFrame, later: list[int], interval: float) -> DataFrame:
    """(scene, proposal, step, later, track, speed, ahead, behind): the objects that each box meets when moved on straight."""
    things = objects.select("scene", "step", "track", F.col("ring").alias("shape"), "ring")
    met = scorer.contacts(scorer.moved_boxes(boxes, later, interval), things).drop("step", "speed", "heading").withColumnRenamed("begin", "step")
    middle = lambda c: F.aggregate("shape", F.lit(0.0), lambda s, p: s + p[c]) / F.size("shape")
    ahead, behind = _bearing(middle("x"), middle("y"))
    return met.join(boxes.select(*STATE, "x", "y", "heading", "speed"), STATE).select(*STATE, "later", "track", "speed", ahead.alias("ahead"), behind.alias("behind"))


def scored(
    states: DataFrame, objects: DataFrame, regions: DataFrame, lines: DataFrame, collided: DataFrame | None = None, past: DataFrame | None = None,
    interval: float = 0.1, vehicle: tuple[float, float, float] = VEHICLE,
) -> DataFrame:
    """(scene, proposal, no_fault, on_road, direction, lights, progress, ttc, lane_keeping, comfort, score) of each proposal.

    ``states`` are (scene, proposal, step, state) with steps from 0, as many for all proposals, and states of eleven
    numbers; ``objects`` (scene, step, track, ring, speed, agent), boxes by step, among them red lights, whose tracks begin
    with "red_light"; ``regions`` (scene, gid, kind, on_route, rings); ``lines`` (scene, line); ``collided`` (scene, track)
    the tracks that met the vehicle before the start; ``past`` (scene, states) the states up to the first.

    Scenes without a past count as comfortable, and proposals wholly in intersections keep their lane. Scenes without a line
    give no row.
    """
    boxes = stored(vehicles(states, vehicle), "proposal-boxes")
    held = stored(areas(boxes, regions), "proposal-areas")
    who = boxes.select(*PROPOSAL).distinct()
    met = stored(collisions(boxes, objects), "proposal-contacts")
    later = list(range(0, int(AHEAD * 10), LOOKS))
    last = F.max("step").over(scorer.W.partitionBy(*PROPOSAL)) - max(later)
    open_ = boxes.withColumn("_last", last).where("step <= _last").drop("_last")
    near = approaches(open_, objects, later, interval)
    line = boxes.join(lines.select("scene", "line"), "scene")
    spot = G.at_distance(F.col("line"), G.projected(F.col("line"), F.col("cx"), F.col("cy")))
    beside = line.select(*STATE, F.col("cx").alias("x"), F.col("cy").alias("y"), spot.alias("_s")).select(*STATE, F.hypot(F.col("x") - F.col("_s.x"), F.col("y") - F.col("_s.y")).alias("deviation"))
    ends = boxes.groupBy(*PROPOSAL).agg(F.min_by(F.struct("cx", "cy"), "step").alias("a"), F.max_by(F.struct("cx", "cy"), "step").alias("b")).join(lines.select("scene", "line"), "scene")
    ends = ends.select(*PROPOSAL, "line", F.col("a.cx").alias("x0"), F.col("a.cy").alias("y0"), F.col("b.cx").alias("x1"), F.col("b.cy").alias("y1"))
    parts = {
        "no_fault": scorer.no_fault(met, held, who, collided),
        "on_road": scorer.on_road(held),
        "direction": scorer.direction(boxes.select(*STATE, F.col("cx").alias("x"), F.col("cy").alias("y")), held, round(AGAINST / interval)),
        "lights": scorer.lights(met, who),
        "ttc": scorer.time_to_collision(near, held, who, collided=collided),
        "lane_keeping": scorer.lane_keeping(beside, held, math.ceil(ASIDE / interval)),
    }
    rows = scorer.progress(ends)
    for name, part in parts.items():
        rows = rows.join(part.select(*PROPOSAL, F.col("score").alias(name)), PROPOSAL, "left").withColumn(name, F.coalesce(name, F.lit(1.0)))
    if past is None:
        rows = rows.withColumn("comfort", F.lit(1.0))
    else:
        whole = states.join(past.select("scene"), "scene", "left_semi").groupBy(*PROPOSAL).agg(F.sort_array(F.collect_list(F.struct("step", "state")))["state"].alias("states"))
        easy = kernels.comfort_by_proposal(scorer.with_history(whole, past), "scene", "proposal", "states", interval)
        rows = rows.join(easy.select(*PROPOSAL, F.col("comfortable").cast("double").alias("comfort")), PROPOSAL, "left").withColumn("comfort", F.coalesce("comfort", F.lit(1.0)))
    rows = stored(rows, "proposal-metrics")
    final = scorer.score_proposals(rows).withColumnRenamed("progress", "_share")
    return rows.drop("progress").join(final, PROPOSAL).select(*PROPOSAL, "no_fault", "on_road", "direction", "lights", F.col("_share").alias("progress"), "ttc", "lane_keeping", "comfort", "score")
