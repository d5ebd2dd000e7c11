"""Spatial joins over a uniform grid, nearest neighbours and point filters.

A theta join of geometries becomes an equi-join of grid cells (each geometry enters the cells its bounding box
touches) followed by the exact predicate, so nothing is compared with everything.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.operators import polygons as P


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 10.0) -> DataFrame:
    """Pairs (point id, polygon id): points (pid, x, y) strictly inside rings (gid, ring array<struct<x, y>>); no edge counts."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = polygons.withColumns({"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})
    boxed = boxed.withColumn("_e", P.edges(F.array("ring"))).drop("ring")
    gridded = boxed.withColumn("_cx", F.explode(_cells(F.col("_x0"), F.col("_x1"), cell))).withColumn("_cy", F.explode(_cells(F.col("_y0"), F.col("_y1"), cell)))
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    near = placed.join(gridded, ["_cx", "_cy"]).where(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")))
    return near.where(P.inside(F.col("_e"), F.col("x"), F.col("y"))).select("pid", "gid").distinct()


def _widest(a: DataFrame, b: DataFrame, cell: float) -> list[tuple[float, int]]:
    """For each axis the smallest cells and how often they are doubled: at most ``cell`` wide, up to the longest side of a box."""
    sides = a.select("_x0", "_x1", "_y0", "_y1").unionByName(b.select("_x0", "_x1", "_y0", "_y1"))
    longest = sides.agg(F.max(F.col("_x1") - F.col("_x0")), F.max(F.col("_y1") - F.col("_y0"))).first()
    out = []
    for side in longest:
        if side is None or not 0 < side < math.inf:
            out.append((cell, 0))
        else:
            k = max(0, math.ceil(math.log2(side / cell)))
            out.append((side / 2**k, k))
    return out


def boxes_overlapping(a: DataFrame, b: DataFrame, cell: float = 10.0) -> DataFrame:
    """Pairs (aid, bid) of axis-aligned boxes that share a point: boxes (id, x0, x1, y0, y1), or boxes by their middle and
    size (id, x, y, width, height), which are compared by the distance of their middles, without the rounding of edges.

    Each box of ``a`` stands in one cell, that of its lower left corner, on a grid of cells about its size; the boxes of ``b``
    enter the cells of each such grid from which a box can reach them. So a pair meets once, and most that meet are pairs.
    """
    middles = "width" in a.columns

    def sided(df: DataFrame, side: str) -> DataFrame:
        if not middles:
            out = df.select(*[F.col(c).alias(f"{side}{c}") for c in ("id", "x0", "x1", "y0", "y1")])
            ends = {f"_{c}": F.col(f"{side}{c}") for c in ("x0", "x1", "y0", "y1")}
        else:
            out = df.select(*[F.col(c).alias(f"{side}{c}") for c in ("id", "x", "y", "width", "height")])
            half = lambda c, s: F.col(f"{side}{s}") / 2 + (F.abs(f"{side}{c}") + F.col(f"{side}{s}")) * 1e-12  # noqa: E731  (more than any rounding)
            ends = {f"_{c}{n}": F.col(f"{side}{c}") + sign * half(c, s) for c, s in (("x", "width"), ("y", "height")) for n, sign in ((0, -1), (1, 1))}
        return out.withColumns(ends).where("_x0 <= _x1 and _y0 <= _y1")

    left, right = sided(a, "a"), sided(b, "b")
    grids = dict(zip("xy", _widest(left, right, cell)))

    def level(c: str) -> Column:
        """The finest cells of which the box touches two at most."""
        size, most = grids[c]
        two = lambda k: F.floor(F.col(f"_{c}1") / (size * 2**k)) - F.floor(F.col(f"_{c}0") / (size * 2**k)) <= 1
        return F.coalesce(*[F.when(two(k), F.lit(k)) for k in range(most + 1)], F.lit(most + 1))

    at = lambda c, end: F.floor(F.col(f"_{c}{end}") / (F.lit(grids[c][0]) * F.pow(F.lit(2.0), F.col(f"_k{c}"))))
    left = left.withColumns({"_kx": level("x"), "_ky": level("y")})
    placed = left.withColumns({"_cx": at("x", 0), "_cy": at("y", 0)}).drop("_x0", "_x1", "_y0", "_y1")
    levels = [tuple(r) for r in left.select("_kx", "_ky").distinct().collect()]  # a few: no more than doublings on each axis
    if not levels:
        return left.crossJoin(right.limit(0)).select("aid", "bid")
    every = F.explode(F.array(*[F.struct(F.lit(x).alias("_kx"), F.lit(y).alias("_ky")) for x, y in levels]))
    gridded = right.withColumn("_k", every).withColumns({"_kx": F.col("_k._kx"), "_ky": F.col("_k._ky")})
    for c in "xy":
        gridded = gridded.withColumn(f"_c{c}", F.explode(F.sequence(at(c, 0) - 1, at(c, 1))))
    # sorted and shuffled: a small table would go to the few tasks that read the other one, which make all the pairs
    met = placed.join(gridded.drop("_k", "_x0", "_x1", "_y0", "_y1").hint("merge"), ["_kx", "_ky", "_cx", "_cy"])
    if middles:
        near = lambda c, s: F.abs(F.col(f"a{c}") - F.col(f"b{c}")) <= (F.col(f"a{s}") + F.col(f"b{s}")) / 2
        return met.where(near("x", "width") & near("y", "height")).select("aid", "bid")
    return met.where("ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1").select("aid", "bid")


def nearest(objects: DataFrame, x: float | Column, y: float | Column, limits: dict[str, int], kind: str = "type", order: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The k nearest objects of each listed type, k by type, in each group of ``by`` (scene, say); ties by the order column.

    ``x`` and ``y`` are one place, or columns that ``objects`` hold, such as the vehicle's. Objects without a distance or of
    no listed type are left out; limits below 1 give none. Each task keeps the largest k of a group and type before
    anything moves (a limit on the rank that Spark applies below the exchange), so a group sends k rows for each task.
    """
    x, y = (F.lit(v) if isinstance(v, (int, float)) else v for v in (x, y))
    limits = {t: k for t, k in limits.items() if k > 0}
    if not limits:
        return objects.withColumn("distance", F.lit(0.0)).limit(0)
    distance = F.sqrt(F.pow(F.col("x") - x, F.lit(2)) + F.pow(F.col("y") - y, F.lit(2)))
    ranked = objects.where(F.col(kind).isin(list(limits))).withColumn("distance", distance).where(F.col("distance").isNotNull())
    place = F.row_number().over(W.partitionBy(*by, kind).orderBy("distance", order))
    near = ranked.withColumn("_n", place).where(F.col("_n") <= max(limits.values()))
    most = F.coalesce(*[F.when(F.col(kind) == t, F.lit(k)) for t, k in limits.items()])
    return near.where(F.col("_n") <= most).drop("_n")


def nearest_to_vehicles(objects: DataFrame, vehicles: DataFrame, limits: dict[str, int], static: int = 0, by: Sequence[str] = ("scene",), order: str = "id") -> DataFrame:
    """``nearest`` around the vehicle (by, x, y) of each scene: dynamic objects by type, and ``static`` objects of all other
    types together. Objects have type and agent (whether they move); objects of scenes without a vehicle are left out."""
    around = objects.join(vehicles.select(*by, F.col("x").alias("ego_x"), F.col("y").alias("ego_y")), list(by))
    kind = F.when(F.col("agent"), F.concat(F.lit("agent "), F.col("type"))).otherwise(F.lit("static"))
    every = {**{f"agent {t}": k for t, k in limits.items()}, "static": static}
    return nearest(around.withColumn("_kind", kind), F.col("ego_x"), F.col("ego_y"), every, "_kind", order, by).drop("_kind", "ego_x", "ego_y")


def padded_agents(agents: DataFrame, scene: str, k: int, order: str = "distance") -> DataFrame:
    """Exactly k agents (x, y, heading, length, width) for each scene, nearest first, the rest zero with valid = false."""
    item = F.struct(F.col(order).alias("_o"), F.struct("x", "y", "heading", "length", "width", F.lit(True).alias("valid")).alias("a"))
    near = agents.withColumn("_n", F.row_number().over(W.partitionBy(scene).orderBy(order))).where(F.col("_n") <= k)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "heading", "length", "width")], F.lit(False).alias("valid"))
    return near.groupBy(scene).agg(F.sort_array(F.collect_list(item))["a"].alias("_a")).select(scene, F.concat("_a", F.array_repeat(zero, F.lit(k) - F.size("_a"))).alias("agents"))


def in_box(points: DataFrame, x: tuple[float, float], y: tuple[float, float], z: tuple[float, float]) -> DataFrame:
    """Points strictly inside a box."""
    out = points
    for c, (low, high) in (("x", x), ("y", y), ("z", z)):
        out = out.where((F.col(c) > low) & (F.col(c) < high))
    return out


def of_types(tracks: Column, types: list[str]) -> Column:
    """The tracks (array of structs with a type) of some types."""
    return F.filter(tracks, lambda t: t["type"].isin(types))


def preferred(candidates: DataFrame, key: str, preference: Column, distance: Column, order: str) -> DataFrame:
    """The best candidate of each key: lowest preference class, then distance, then the order column."""
    place = F.row_number().over(W.partitionBy(key).orderBy(preference, distance, F.col(order)))
    return candidates.withColumn("_n", place).where("_n = 1").drop("_n")


def mean_pairwise_distance(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Mean squared distance of the pairs of each key without making pairs: it is (2 n Σ|v|² - 2 |Σv|²) / (n (n - 1))."""
    flat = vectors.select(key, F.posexplode(column).alias("i", "v"))
    sums = flat.groupBy(key, "i").agg(F.sum(F.col("v").cast("double")).alias("s"), F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("q"), F.count(F.lit(1)).alias("n"))
    totals = sums.groupBy(key).agg(F.max("n").alias("n"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    return totals.select(key, "n", F.try_divide(2 * F.col("n") * F.col("q") - 2 * F.col("ss"), F.col("n") * (F.col("n") - 1)).alias("mean_squared"))
