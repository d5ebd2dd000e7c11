"""Nearest places on polylines as a join, and lanes around a vehicle.

Lines are cut into short pieces, each in the cells of a grid that it touches. Every point looks into the nine cells around
it; what it finds within one cell's width is its nearest place, as anything outside the nine cells lies further off. Points
that find nothing so near look again on a grid twice as coarse, so a point meets pieces only up to a few times its
distance from the nearest, and the rounds are the doublings from the first width to the extent of the lines. The best
place of a point is an aggregation (``min_by``) that combines map-side; open points are written between rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.functions import geometry as G
from rollgrid.operators import graph, polygons
from rollgrid.operators.storage import stored


def segments(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, lid, seg, x0, y0, x1, y1, begin): the edges of each line (lid, path array of (x, y)) and the distance along the
    line at which they begin. A line of one point is one edge without length; lines without points have none."""
    path = F.col("path")
    each = lines.where(F.size(path) > 0).select(*by, "lid", F.when(F.size(path) > 1, path).otherwise(F.concat(path, path)).alias("path"))
    step = F.transform(F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))), lambda p, i: F.struct(F.element_at("path", i + 1)["x"].alias("x0"), F.element_at("path", i + 1)["y"].alias("y0"), p["x"].alias("x1"), p["y"].alias("y1")))
    each = each.select(*by, "lid", step.alias("steps"), G.path_progress(F.col("path")).alias("along"))
    out = each.select(*by, "lid", "along", F.posexplode("steps").alias("seg", "s"))
    return out.select(*by, "lid", "seg", "s.x0", "s.y0", "s.x1", "s.y1", F.element_at("along", F.col("seg") + 1).alias("begin"))


def _in_cells(found: DataFrame, size: float) -> DataFrame:
    """A row for each cell of the grid that a piece of an edge, no longer than a cell, touches with its box."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))
    n = F.greatest(F.ceil(length / F.lit(size)).cast("int"), F.lit(1))
    pieces = found.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    ends = {c: (at(f"{c}0", f"{c}1", F.col("_k")), at(f"{c}0", f"{c}1", F.col("_k") + 1)) for c in ("x", "y")}
    cells = {c: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)) for c, (a, b) in ends.items()}
    out = pieces.withColumn("_cx", F.explode(cells["x"])).withColumn("_cy", F.explode(cells["y"]))
    return out.drop("_n", "_k")


def nearest_places(points: DataFrame, lines: DataFrame, by: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """For each point (by, pid, x, y) the nearest place of all lines (by, lid, path): by, pid, lid, seg, along, px, py, distance.

    Equal distances go to the smallest lid, then the earliest edge. Points whose group (``by``) has no line, and points or
    lines without finite coordinates, give no row; pid must be unique in its group. ``width`` is the first grid's, by
    default the mean length of the edges.
    """
    keys = [*by, "pid"]
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    edges = segments(lines, by)
    for c in ("x0", "y0", "x1", "y1"):
        edges = edges.where(good(c))
    edges = stored(edges, "line-edges")
    left = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(good("x") & good("y"))
    if by:
        left = left.join(edges.select(*by).distinct(), list(by), "left_semi")
    left = stored(left, "open-points")
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))
    e = edges.agg(F.avg(length).alias("w"), *[f(c).alias(f"{n}{c}") for c in ("x0", "x1", "y0", "y1") for f, n in ((F.min, "low"), (F.max, "high"))]).first()
    p = left.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for f, n in ((F.min, "low"), (F.max, "high"))]).first()
    kinds = f"{', '.join(f'{n} {t}' for n, t in left.select(*keys).dtypes)}, lid {dict(lines.dtypes)['lid']}, seg int, along double, px double, py double, distance double"
    if e["w"] is None or p["lowx"] is None:
        return points.sparkSession.createDataFrame([], kinds)
    extent = max(max(e["highx0"], e["highx1"], p["highx"]) - min(e["lowx0"], e["lowx1"], p["lowx"]), max(e["highy0"], e["highy1"], p["highy"]) - min(e["lowy0"], e["lowy1"], p["lowy"]))
    size = width or max(e["w"], extent / 2**20) or 1.0
    found = None
    for _ in range(64):
        cells = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size) - 1, F.floor(F.col(c) / size) + 1))  # noqa: B023, E731
        looked = left.withColumn("_cx", cells("x")).withColumn("_cy", cells("y"))
        dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        square = dx * dx + dy * dy
        share = F.coalesce(F.least(F.greatest(F.try_divide((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy, square), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        met = looked.join(_in_cells(edges, size), [*by, "_cx", "_cy"]).withColumn("_t", share)
        place = met.withColumns({"px": F.col("x0") + F.col("_t") * dx, "py": F.col("y0") + F.col("_t") * dy, "along": F.col("begin") + F.col("_t") * F.sqrt(square)})
        place = place.withColumn("distance", F.sqrt(F.pow(F.col("px") - F.col("x"), F.lit(2)) + F.pow(F.col("py") - F.col("y"), F.lit(2))))
        best = place.groupBy(*keys).agg(F.min_by(F.struct("lid", "seg", "along", "px", "py", "distance"), F.struct("distance", "lid", "seg")).alias("b"))
        whole = size > extent  # nine such cells hold everything
        best = stored(best if whole else best.where(F.col("b.distance") <= size), "nearest-places")
        found = best if found is None else found.unionByName(best)
        left = stored(left.join(best, keys, "left_anti"), "open-points")
        if whole or left.isEmpty():
            break
        size *= 2
    return found.select(*keys, "b.*")


def nearest_pose(poses: Column, x: Column, y: Column) -> Column:
    """Of an array of poses (x, y, heading) the one nearest to a point, the first of equal ones."""
    gap = F.transform(poses, lambda p, i: F.struct((F.pow(p["x"] - x, F.lit(2)) + F.pow(p["y"] - y, F.lit(2))).alias("d"), i.alias("i"), p.alias("p")))
    return F.array_min(F.transform(gap, lambda g: F.struct(g["d"], g["i"], g["p"]["x"].alias("x"), g["p"]["y"].alias("y"), g["p"]["heading"].alias("heading"))))


def intersecting_lanes(states: DataFrame, lanes: DataFrame) -> DataFrame:
    """(scene, state, lane, heading_error): lanes on the route that hold a state's rear axle, edges included.

    ``states`` are (scene, state, x, y, heading), ``lanes`` (scene, lane, on_route, rings, poses). The heading error is the
    absolute angle between the state and the nearest pose of the lane's centre line.
    """
    points = states.select("scene", F.col("state").alias("pid"), "x", "y")
    regions = lanes.where("on_route").select("scene", F.col("lane").alias("gid"), "rings")
    held = polygons.points_in(points, regions, ["scene"], edge=True).toDF("scene", "state", "lane")
    each = held.join(lanes.select("scene", "lane", "poses"), ["scene", "lane"]).join(states, ["scene", "state"])
    error = F.abs(G.wrapped(nearest_pose(F.col("poses"), F.col("x"), F.col("y"))["heading"] - F.col("heading")))
    return each.select("scene", "state", "lane", error.alias("heading_error"))


def starting_lanes(states: DataFrame, lanes: DataFrame) -> DataFrame:
    """(scene, state, lane, on_route): the lane that each state starts from.

    Of the route's lanes that hold the rear axle (x, y) the one of the least heading error; without any, the first route
    lane that holds the centre (cx, cy) strictly, else the nearest route lane to the centre. Ties go to the smallest lane.
    """
    key = ["scene", "state"]
    first = intersecting_lanes(states, lanes).select(*key, "lane", F.lit(True).alias("on_route"), F.lit(False).alias("contains"), "heading_error", F.lit(0.0).alias("distance"))
    rest = states.join(first.select(*key).distinct(), key, "left_anti")
    points = rest.select("scene", F.col("state").alias("pid"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    route = lanes.where("on_route").select("scene", F.col("lane").alias("gid"), "rings")
    held = polygons.points_in(points, route, ["scene"]).toDF("scene", "state", "lane")
    second = held.select(*key, "lane", F.lit(False).alias("on_route"), F.lit(True).alias("contains"), F.lit(0.0).alias("heading_error"), F.lit(0.0).alias("distance"))
    lone = points.join(held.select("scene", F.col("state").alias("pid")).distinct(), ["scene", "pid"], "left_anti")
    outline = route.select("scene", F.col("gid").alias("lid"), F.explode("rings").alias("ring")).select("scene", "lid", F.concat("ring", F.slice("ring", 1, 1)).alias("path"))
    third = nearest_places(lone, outline, ["scene"]).select("scene", F.col("pid").alias("state"), F.col("lid").alias("lane"), F.lit(False).alias("on_route"), F.lit(False).alias("contains"), F.lit(0.0).alias("heading_error"), "distance")
    states_of = first.unionByName(second).unionByName(third).withColumn("key", F.struct(*key))
    return graph.nearest_lane(states_of, "key").select(*key, "lane", "on_route")
