"""Driving corridors: sub-paths widened to rings, and the objects that stand in them.

The ring of a corridor runs along one side of the path and back along the other. Outer sides of bends get arcs, inner sides
pass through the bend's point, and both ends a square cap. So the ring winds around a point once for every stretch, bend
and cap that holds it, and under the rule "nonzero" its region is exactly their union, however the path crosses itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.functions import geometry as G
from rollgrid.functions.arrays import bound
from rollgrid.operators import polygons, simulation

#: Steps of an arc in a quarter turn.
QUARTER = 16


def _side(path: Column, unit: Column, half: Column) -> Column:
    """The points along the left of a path and around its end; ``unit`` holds the directions of its stretches."""

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def around(i: Column) -> Column:
        """From the end of stretch i to the start of the next, around the point between them."""
        p, u, v = F.element_at(path, i + 1), F.element_at(unit, i), F.element_at(unit, i + 1)
        bend = F.struct(p["x"].alias("x"), p["y"].alias("y"), u["x"].alias("ux"), u["y"].alias("uy"), (u["x"] * v["y"] - u["y"] * v["x"]).alias("cross"), (u["x"] * v["x"] + u["y"] * v["y"]).alias("dot"))

        def arc(b: Column) -> Column:
            angle = F.when(b["cross"] == 0, F.lit(-math.pi)).otherwise(F.atan2(b["cross"], b["dot"]))
            steps = F.ceil(-angle / (math.pi / 2 / QUARTER) - 1e-9).cast("int")
            turned = lambda a: point(b["x"] - half * (b["uy"] * F.cos(a) + b["ux"] * F.sin(a)), b["y"] - half * (b["uy"] * F.sin(a) - b["ux"] * F.cos(a)))
            every = lambda c: F.when(c["n"] > 1, F.transform(F.sequence(F.lit(1), F.greatest(c["n"] - 1, F.lit(1))), lambda j: bound(c["a"] * j / c["n"], turned))).otherwise(F.slice(path, 1, 0))
            return bound(F.struct(angle.alias("a"), steps.alias("n")), every)

        outer = lambda b: (b["cross"] < 0) | ((b["cross"] == 0) & (b["dot"] < 0))
        return bound(bend, lambda b: F.when(outer(b), arc(b)).otherwise(F.array(point(b["x"], b["y"]))))

    def stretch(i: Column) -> Column:
        p, q, u = F.element_at(path, i), F.element_at(path, i + 1), F.element_at(unit, i)
        beside = F.array(*[point(c["x"] - half * u["y"], c["y"] + half * u["x"]) for c in (p, q)])
        return F.concat(beside, F.when(i < F.size(unit), around(F.least(i, F.size(unit) - 1))).otherwise(F.slice(path, 1, 0)))

    last, u = F.element_at(path, -1), F.element_at(unit, -1)
    cap = F.array(*[point(last["x"] + half * (u["x"] - s * u["y"]), last["y"] + half * (u["y"] + s * u["x"])) for s in (1, -1)])
    return F.concat(F.flatten(F.transform(F.sequence(F.lit(1), F.size(unit)), stretch)), cap)


def _units(path: Column) -> Column:
    def of(q: Column, i: Column) -> Column:
        p = F.element_at(path, i + 1)
        way = F.struct((q["x"] - p["x"]).alias("x"), (q["y"] - p["y"]).alias("y"))
        return bound(way, lambda d: bound(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"]), lambda n: F.struct((d["x"] / n).alias("x"), (d["y"] / n).alias("y"))))

    return F.transform(F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), of)


def corridor(path: Column, half: Column) -> Column:
    """The ring around a path of (x, y), or null without a stretch. Repeated points count once."""
    apart = lambda p, q: (p["x"] != q["x"]) | (p["y"] != q["y"])
    once = F.filter(path, lambda p, i: (i == 0) | apart(p, F.get(path, F.greatest(i - 1, F.lit(0)))))
    side = lambda p: bound(_units(p), lambda u: _side(p, u, half))
    ring = lambda p: F.when(F.size(p) > 1, F.concat(side(p), bound(F.reverse(p), side)))
    return bound(once, ring)


def corridors(paths: DataFrame, half: float | Column) -> DataFrame:
    """``paths`` (..., path array of (x, y, ...), begin, end) with a column rings: the part of the path between the distances
    ``begin`` and ``end`` widened by ``half`` on each side. Paths without a stretch there are left out.

    The arcs of rings have ``QUARTER`` steps; the columns bends (the inner points of that part) and half give them exactly."""
    width = F.lit(float(half)) if isinstance(half, (int, float)) else half
    flat = F.transform("path", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    part = bound(flat, lambda p: G.between_distances(p, F.col("begin").cast("double"), F.col("end").cast("double")))
    ring = bound(part, lambda p: corridor(p, width))
    # a row without a ring gives none; as a generator the ring is computed once
    inner = bound(part, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0))))
    whole = paths.drop("rings").withColumns({"bends": F.when(F.size("path") > 1, inner), "half": width})
    return whole.withColumn("rings", F.explode(F.when(F.size("path") > 1, bound(ring, lambda r: F.when(r.isNotNull(), F.array(F.array(r)))))))


def reach(ego_progress: Column, target: Column, poses: int, interval: float) -> Column:
    """How far along its path a vehicle may come: its progress and the way at the largest target speed."""
    return ego_progress + F.abs(target) * poses * interval


def intersecting_objects(found: DataFrame, objects: DataFrame) -> DataFrame:
    """(scene, lateral, step, token): objects (scene, step, token, rings) that a corridor (scene, lateral, rings) meets.

    Where corridors have the columns bends and half, objects within ``half`` of a bend count too, so bends are round."""
    regions = polygons.boxed(objects.select("scene", "step", "token", "rings"), name="_f")
    exact = "bends" in found.columns and "half" in found.columns
    queries = polygons.boxed(found.select("scene", "lateral", "rings", *(["bends", "half"] if exact else [])))
    if exact:
        # arcs lie inside their circles by half * (1 - cos(pi / 4 / QUARTER)) at most
        short = F.col("half") * (1 - math.cos(math.pi / 4 / QUARTER) + 1e-9)
        queries = queries.withColumns({c: F.col(c) + (short if c.endswith("1") else -short) for c in polygons.BOX})
    met = polygons.pairs(queries, regions, ["scene"])
    touched = polygons.intersects(F.col("_e"), F.col("_f"), "nonzero")
    if exact:
        touched = touched | F.exists("bends", lambda p: polygons.distance(F.col("_f"), p["x"], p["y"], "nonzero") <= F.col("half"))
    return met.where(touched).select("scene", "lateral", "step", "token")


def leading_objects(found: DataFrame, vehicles: DataFrame, objects: DataFrame, collided: DataFrame | None = None) -> DataFrame:
    """What each proposal follows at each step: scene, proposal, step, token, lead_progress, lead_velocity.

    ``found`` are corridors (scene, lateral, path, rings); ``vehicles`` (scene, proposal, step, lateral, rings, ego_progress,
    ego_heading, path_length) and ``objects`` (scene, step, token, rings, x, y, speed, heading) stand at a step. Objects in
    the corridor but for ``collided`` (scene, token) have the progress of their centre along the path, and their distance
    from the vehicle is that of the two outlines. See ``simulation.leading``.
    """
    inside = intersecting_objects(found, objects)
    if collided is not None:
        inside = inside.join(collided.select("scene", "token").distinct(), ["scene", "token"], "left_anti")
    placed = inside.join(objects, ["scene", "step", "token"]).join(found.select("scene", "lateral", "path"), ["scene", "lateral"])
    placed = placed.withColumn("progress", G.projected(F.col("path"), F.col("x"), F.col("y"))).drop("path")
    met = placed.join(vehicles.select("scene", "step", "lateral", "proposal", F.col("rings").alias("_own"), "ego_progress"), ["scene", "step", "lateral"]).where(F.col("progress") > F.col("ego_progress"))
    met = met.withColumns({"_a": polygons.edges(F.col("_own")), "_b": polygons.edges(F.col("rings"))}).withColumn("distance", polygons.gap(F.col("_a"), F.col("_b")))
    key = ["scene", "proposal", "step"]
    return simulation.leading(met.select(*key, "token", "progress", "distance", "speed", "heading"), vehicles.select(*key, "ego_progress", "ego_heading", "path_length"), key=key)
