"""Probes of general regions: rings with holes, concave or self-crossing, over an index that splits dense cells.

A region is an array of rings, each an array of (x, y). Under the rule "even-odd" a point belongs to it if a ray from it
crosses an odd number of edges, so holes are rings like any others; under "nonzero" if the rings wind around it, which is
the union of overlapping loops. Edges belong to the region. Regions without points take no part, nor do rows whose
coordinates are null or not finite.

Theta joins become equi-joins of the leaves of a quadtree. Cells that hold more than a share of all geometries (by the
middles of their boxes, counted in one aggregation) are split, so there are at most ``CELLS`` split cells on each of
``DEPTH`` levels whatever the data, and their keys go to all tasks. A geometry goes to all leaves that its box touches;
a pair is taken in the one leaf that holds the lower left corner of the boxes' common part, so nothing is met twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.functions.arrays import bound

#: Cells that are split on a level, at most; levels; geometries that are never worth splitting.
CELLS, DEPTH, LEAST = 10_000, 12, 64
#: Edges of a region with which batches of pairs go to numpy; larger ones are measured row by row.
EDGES = 256
#: Pairs of edge and point that are measured at once.
PAIRS = 1 << 20
BOX = ["_x0", "_y0", "_x1", "_y1"]
#: Layers of the map. Fixed values.
ROADBLOCKS = {"ROADBLOCK": "LANE", "ROADBLOCK_CONNECTOR": "LANE_CONNECTOR"}
AREAS = ("INTERSECTION", "CARPARK_AREA")


# predicates over edges


def edges(rings: Column) -> Column:
    """All edges (x0, y0, x1, y1) of the rings, closed."""

    def of(ring: Column) -> Column:
        after = lambda i: F.element_at(ring, F.when(i + 1 < F.size(ring), i + 2).otherwise(F.lit(1)))
        return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), after(i)["x"].alias("x1"), after(i)["y"].alias("y1")))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), of))


def _side(e: Column, x: Column, y: Column) -> Column:
    """Positive left of the edge, negative right of it, 0 on its line."""
    return (e["x1"] - e["x0"]) * (y - e["y0"]) - (x - e["x0"]) * (e["y1"] - e["y0"])


def on_edge(e: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies on one of the edges."""
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    return F.exists(e, lambda s: (_side(s, x, y) == 0) & between(x, s["x0"], s["x1"]) & between(y, s["y0"], s["y1"]))


def _wound(e: Column, x: Column, y: Column, rule: str) -> Column:
    down = F.lit(-1 if rule == "nonzero" else 1)
    turn = lambda s: F.when((s["y0"] <= y) & (s["y1"] > y) & (_side(s, x, y) > 0), F.lit(1)).when((s["y0"] > y) & (s["y1"] <= y) & (_side(s, x, y) < 0), down).otherwise(F.lit(0))
    n = F.aggregate(e, F.lit(0), lambda total, s: total + turn(s))
    if rule == "nonzero":
        return n != 0
    if rule != "even-odd":
        raise ValueError(f"unknown rule {rule}")
    return n % 2 == 1


def inside(e: Column, x: Column, y: Column, rule: str = "even-odd") -> Column:
    """Whether (x, y) lies strictly inside the region of these edges."""
    return _wound(e, x, y, rule) & ~on_edge(e, x, y)


def covers(e: Column, x: Column, y: Column, rule: str = "even-odd") -> Column:
    """Whether (x, y) lies inside the region or on an edge of it."""
    return _wound(e, x, y, rule) | on_edge(e, x, y)


def distance(e: Column, x: Column, y: Column, rule: str = "even-odd") -> Column:
    """Distance from (x, y) to the region, 0 in it."""

    def to(s: Column) -> Column:
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
        length = dx * dx + dy * dy
        share = F.when(length > 0, F.least(F.greatest(F.try_divide((x - s["x0"]) * dx + (y - s["y0"]) * dy, length), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        return F.sqrt(F.pow(s["x0"] + share * dx - x, F.lit(2)) + F.pow(s["y0"] + share * dy - y, F.lit(2)))

    return F.when(covers(e, x, y, rule), F.lit(0.0)).otherwise(F.array_min(F.transform(e, to)))


def flat(e: Column) -> Column:
    """The edges as one array of numbers, four for each, which go to numpy without an object for each."""
    return F.flatten(F.transform(e, lambda s: F.array(s["x0"], s["y0"], s["x1"], s["y1"])))


def _to_edges(e: Sequence, x: np.ndarray, y: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For edges (x0, y0, x1, y1) and points: their turns about them, whether they hold them, and the distance."""
    x0, y0, x1, y1 = e
    dx, dy = x1 - x0, y1 - y0
    ax, ay = x - x0, y - y0
    side = dx * ay - ax * dy
    up, down = (y0 <= y) & (y1 > y) & (side > 0), (y0 > y) & (y1 <= y) & (side < 0)
    on = (side == 0) & (x >= np.minimum(x0, x1)) & (x <= np.maximum(x0, x1)) & (y >= np.minimum(y0, y1)) & (y <= np.maximum(y0, y1))
    length = dx * dx + dy * dy
    share = np.divide(ax * dx + ay * dy, length, out=np.zeros(np.broadcast(x, dx).shape), where=length > 0)
    share = np.minimum(np.maximum(share, 0.0), 1.0)
    gap = np.sqrt((x0 + share * dx - x) ** 2 + (y0 + share * dy - y) ** 2)
    return up.astype(np.int64) + (-1 if rule == "nonzero" else 1) * down, on, gap


def _settled(turns: np.ndarray, on: np.ndarray, gap: np.ndarray, rule: str) -> np.ndarray:
    return np.where((turns != 0 if rule == "nonzero" else turns % 2 == 1) | on, 0.0, gap)


def far(e: np.ndarray, x: np.ndarray, y: np.ndarray, rule: str = "even-odd") -> np.ndarray:
    """``distance`` in numpy from points to the region of the edges (x0, y0, x1, y1), rows of ``e``."""
    most = max(1, PAIRS // len(e))
    if len(x) > most:
        return np.concatenate([far(e, x[i : i + most], y[i : i + most], rule) for i in range(0, len(x), most)])
    turns, on, gap = _to_edges(e.T[:, :, None], x, y, rule)
    return _settled(turns.sum(axis=0), on.any(axis=0), np.fmin.reduce(gap, axis=0), rule)


def distances(numbers: Column, x: Column, y: Column, rule: str = "even-odd") -> Column:
    """``distance`` for many rows at once, from edges made ``flat``; filters on it do not compute it again."""

    def measured(e: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        n = np.diff(e.offsets.to_numpy()) // 4
        x, y = (np.repeat(v.to_numpy(zero_copy_only=False), n) for v in (x, y))
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        turns, on, gap = _to_edges(e.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).T, x, y, rule)
        return pa.array(_settled(np.add.reduceat(turns, begin), np.logical_or.reduceat(on, begin), np.fmin.reduceat(gap, begin), rule))

    return F.arrow_udf(measured, "double").asNondeterministic()(numbers, x, y)


def _cross(a: Column, b: Column) -> Column:
    """Whether two edges share a point: each straddles the line of the other, and their boxes meet."""
    apart = lambda low, high: (F.greatest(a[low], a[high]) < F.least(b[low], b[high])) | (F.greatest(b[low], b[high]) < F.least(a[low], a[high]))
    straddles = lambda s, t: F.signum(_side(s, t["x0"], t["y0"])) * F.signum(_side(s, t["x1"], t["y1"])) <= 0
    return ~apart("x0", "x1") & ~apart("y0", "y1") & straddles(a, b) & straddles(b, a)


def intersects(a: Column, b: Column, rule: str = "even-odd") -> Column:
    """Whether two regions, given by their edges, share a point: edges meet, or a corner of one lies in the other."""
    return F.exists(a, lambda s: F.exists(b, lambda t: _cross(s, t))) | F.exists(a, lambda s: _wound(b, s["x0"], s["y0"], rule)) | F.exists(b, lambda s: _wound(a, s["x0"], s["y0"], rule))


def gap(a: Column, b: Column, rule: str = "even-odd") -> Column:
    """Distance between two regions, 0 where they share a point."""
    to = lambda e, others: F.array_min(F.transform(e, lambda s: distance(others, s["x0"], s["y0"], rule)))
    return F.when(intersects(a, b, rule), F.lit(0.0)).otherwise(F.least(to(a, b), to(b, a)))


def within(a: Column, b: Column, rule: str = "even-odd") -> Column:
    """Whether no point of region ``a`` lies outside region ``b``; common edges are allowed.

    Edges are cut where they meet the others' lines; between two cuts an edge is wholly in or out. No part of a's edges
    may lie outside b, nor on an edge of b with a's inner side where b is not, and no part of b's edges (a hole, say)
    strictly inside a.
    """

    def parts(e: Column, others: Column) -> Column:
        def of(s: Column) -> Column:
            dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
            # where the lines of the others' edges, and their corners on this line, cut the edge
            turn = lambda t: dx * (t["y1"] - t["y0"]) - dy * (t["x1"] - t["x0"])
            cut = lambda t: F.try_divide((t["x0"] - s["x0"]) * (t["y1"] - t["y0"]) - (t["y0"] - s["y0"]) * (t["x1"] - t["x0"]), turn(t))
            corner = lambda t: F.try_divide((t["x0"] - s["x0"]) * dx + (t["y0"] - s["y0"]) * dy, dx * dx + dy * dy)
            at = F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform(others, cut), F.transform(others, corner))
            ordered = F.array_sort(F.array_distinct(F.filter(at, lambda v: v.isNotNull() & (v >= 0) & (v <= 1))))
            middles = bound(ordered, lambda o: F.transform(F.slice(o, F.lit(2), F.size(o) - 1), lambda v, i: (v + F.element_at(o, i + 1)) / 2))
            step = F.try_divide(F.lit(1e-7) * (1 + F.abs(s["x0"]) + F.abs(s["y0"])), F.sqrt(dx * dx + dy * dy))
            return F.transform(middles, lambda v: F.struct((s["x0"] + v * dx).alias("x"), (s["y0"] + v * dy).alias("y"), F.coalesce(-dy * step, F.lit(0.0)).alias("nx"), F.coalesce(dx * step, F.lit(0.0)).alias("ny")))

        return F.flatten(F.transform(e, of))

    near = lambda e, p: F.exists(e, lambda s: F.abs(_side(s, p["x"], p["y"])) <= 1e-9 * (1 + F.abs(s["x1"] - s["x0"]) + F.abs(s["y1"] - s["y0"])) * (1 + F.abs(p["x"]) + F.abs(p["y"])))

    def astray(p: Column, sign: int) -> Column:
        """Whether a common edge has a's inner side where b is not (a fills a hole of b, say)."""
        x, y = p["x"] + sign * p["nx"], p["y"] + sign * p["ny"]
        return _wound(a, x, y, rule) & ~_wound(b, x, y, rule)

    out = F.exists(parts(a, b), lambda p: F.when(near(b, p), astray(p, 1) | astray(p, -1)).otherwise(~_wound(b, p["x"], p["y"], rule)))
    hole = F.exists(parts(b, a), lambda p: _wound(a, p["x"], p["y"], rule) & ~near(a, p))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~out & ~hole


# the index


@dataclass
class Quad:
    """A quadtree: the lower left corner and size of its root, and the sorted keys of the cells that are split."""

    x: float
    y: float
    width: float
    height: float
    split: np.ndarray

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The cell on the deepest level, as whole numbers."""
        most = (1 << DEPTH) - 1
        at = lambda v, low, size: F.least(F.greatest(F.floor((v - low) / size * (most + 1)), F.lit(0)), F.lit(most)).cast("int")
        return at(x, self.x, self.width), at(y, self.y, self.height)


def quad(*frames: DataFrame, cells: int = CELLS, least: int = LEAST) -> Quad | None:
    """The tree over the boxes (columns ``BOX``) of all frames, or None if there are none."""
    boxes = reduce(DataFrame.unionByName, (f.select(*BOX) for f in frames))
    b = boxes.agg(F.min("_x0").alias("x"), F.min("_y0").alias("y"), F.max("_x1").alias("x1"), F.max("_y1").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    if not b["n"]:
        return None
    tree = Quad(b["x"], b["y"], max(b["x1"] - b["x"], 1e-300), max(b["y1"] - b["y"], 1e-300), np.empty(0, np.int64))
    gx, gy = tree.place((F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2)
    counted = boxes.groupBy(gx.alias("gx"), gy.alias("gy")).agg(F.count(F.lit(1)).alias("n"))
    each = counted.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), DEPTH - F.col("_level"))).cast("int")
    sums = each.groupBy("_level", up("gx").alias("_cx"), up("gy").alias("_cy")).agg(F.sum("n").alias("n"))
    split = sums.where(F.col("n") > max(least, b["n"] // cells)).select("_level", "_cx", "_cy").toPandas()  # cells * DEPTH rows at most
    tree.split = np.sort(key_of(split["_level"].to_numpy(np.int64), split["_cx"].to_numpy(np.int64), split["_cy"].to_numpy(np.int64)))
    return tree


def key_of(level: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (level << 40) | (x << 20) | y


def leaves_of(split: np.ndarray, box: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for all leaves that boxes of whole numbers touch, level by level from the root, for all rows at once."""
    row = np.arange(len(box[0]))
    x = y = np.zeros(len(row), np.int64)
    rows, keys = [], []
    for level in range(DEPTH + 1):
        key = key_of(np.int64(level), x, y)
        at = np.minimum(np.searchsorted(split, key), max(len(split) - 1, 0))
        deeper = split[at] == key if len(split) else np.zeros(len(key), bool)
        rows.append(row[~deeper])
        keys.append(key[~deeper])
        row, x, y = (np.repeat(v[deeper], 4) for v in (row, x, y))
        if not len(row):
            break
        quarter = np.tile(np.arange(4), len(row) // 4)
        x, y, size = 2 * x + quarter // 2, 2 * y + quarter % 2, 1 << (DEPTH - level - 1)
        touched = (box[0][row] < (x + 1) * size) & (box[2][row] >= x * size) & (box[1][row] < (y + 1) * size) & (box[3][row] >= y * size)
        row, x, y = row[touched], x[touched], y[touched]
    return np.concatenate(rows), np.concatenate(keys)


def in_leaves(df: DataFrame, tree: Quad, points: bool = False) -> DataFrame:
    """A row for each leaf that the box of a row touches, and the box in whole numbers. Only these numbers go to Python.

    Boxes of ``points`` are points, which stand in one leaf each."""
    split = tree.split

    @F.pandas_udf("long")
    def leaf(x: pd.Series, y: pd.Series) -> pd.Series:
        at = tuple(v.to_numpy(np.int64) for v in (x, y))
        row, key = leaves_of(split, (*at, *at))
        out = np.empty(len(x), np.int64)
        out[row] = key
        return pd.Series(out)

    @F.pandas_udf("array<long>")
    def leaves(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        row, key = leaves_of(split, tuple(v.to_numpy(np.int64) for v in (x0, y0, x1, y1)))
        order = np.argsort(row, kind="stable")
        return pd.Series(np.split(key[order], np.searchsorted(row[order], np.arange(1, len(x0)))))

    (a, b), (c, d) = tree.place(F.col("_x0"), F.col("_y0")), tree.place(F.col("_x1"), F.col("_y1"))
    out = df.withColumns({"_gx0": a, "_gy0": b, "_gx1": c, "_gy1": d})
    if points:
        return out.withColumn("_leaf", leaf("_gx0", "_gy0"))
    return out.withColumn("_leaf", F.explode(leaves("_gx0", "_gy0", "_gx1", "_gy1")))


def pairs(a: DataFrame, b: DataFrame, by: Sequence[str] = (), cells: int = CELLS, least: int = LEAST, points: bool = False) -> DataFrame:
    """Rows of ``a`` and ``b`` (with ``BOX`` and no other common names but ``by``) whose boxes share a point, once each.
    With ``points`` the boxes of ``a`` are points."""
    tree = quad(a, b, cells=cells, least=least)
    if tree is None:
        return a.join(b.drop(*BOX), list(by), "inner").limit(0) if by else a.crossJoin(b.drop(*BOX).limit(0))
    box = [*BOX, "_gx0", "_gy0", "_gx1", "_gy1"]
    other = in_leaves(b, tree)
    met = in_leaves(a, tree, points).join(other.withColumnsRenamed({c: f"{c}b" for c in box}), [*by, "_leaf"])
    met = met.where((F.col("_x0") <= F.col("_x1b")) & (F.col("_x0b") <= F.col("_x1")) & (F.col("_y0") <= F.col("_y1b")) & (F.col("_y0b") <= F.col("_y1")))
    level = F.shiftright("_leaf", 40)
    own = {"_gx": F.shiftright("_leaf", 20).bitwiseAND(F.lit((1 << 20) - 1)), "_gy": F.col("_leaf").bitwiseAND(F.lit((1 << 20) - 1))}
    corner = lambda g: F.floor(F.greatest(F.col(f"{g}0"), F.col(f"{g}0b")) / F.pow(F.lit(2), DEPTH - level)) == own[g]
    return met.where(corner("_gx") & corner("_gy")).drop("_leaf", *box, *(f"{c}b" for c in box))


def finite(df: DataFrame) -> DataFrame:
    """Rows whose boxes are there."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(reduce(lambda p, q: p & q, (good(c) for c in BOX)))


def boxed(df: DataFrame, rings: str = "rings", name: str = "_e") -> DataFrame:
    """``df`` with the boxes and, in place of the rings, the edges of its regions."""
    every = lambda f: F.transform(F.col(name), lambda s: s[f])
    out = df.withColumn(name, edges(F.col(rings))).where(F.size(name) > 0)
    return finite(out.withColumns({"_x0": F.array_min(every("x0")), "_y0": F.array_min(every("y0")), "_x1": F.array_max(every("x0")), "_y1": F.array_max(every("y0"))}).drop(rings))


# probes


def met(queries: DataFrame, regions: DataFrame, predicate: str = "intersects", by: Sequence[str] = (), rule: str = "even-odd", cells: int = CELLS, least: int = LEAST) -> DataFrame:
    """(by, qid, gid): regions (gid, rings) that each query region (qid, rings) meets.

    ``predicate`` is "intersects", "within" (the query lies in the region) or "boxes" (their boxes share a point). ``by``
    names columns, such as scene and step, in which both sides must agree.
    """
    found = pairs(boxed(queries.select(*by, "qid", "rings")), boxed(regions.select(*by, "gid", "rings"), name="_f"), by, cells, least)
    if predicate == "intersects":
        found = found.where(intersects(F.col("_e"), F.col("_f"), rule))
    elif predicate == "within":
        found = found.where(within(F.col("_e"), F.col("_f"), rule))
    elif predicate != "boxes":
        raise ValueError(f"unknown predicate {predicate}")
    return found.select(*by, "qid", "gid")


def _at(points: DataFrame, radius: float = 0.0) -> DataFrame:
    r = F.lit(float(radius))
    return finite(points.withColumns({"_x0": F.col("x") - r, "_y0": F.col("y") - r, "_x1": F.col("x") + r, "_y1": F.col("y") + r}))


def points_in(points: DataFrame, regions: DataFrame, by: Sequence[str] = (), rule: str = "even-odd", edge: bool = False, cells: int = CELLS, least: int = LEAST) -> DataFrame:
    """(by, pid, gid): points (pid, x, y) strictly inside regions (gid, rings), or on an edge too."""
    found = pairs(_at(points.select(*by, "pid", "x", "y")), boxed(regions.select(*by, "gid", "rings")), by, cells, least, True)
    return found.where((covers if edge else inside)(F.col("_e"), F.col("x"), F.col("y"), rule)).select(*by, "pid", "gid")


def in_layer(points: DataFrame, regions: DataFrame, layer: str, by: Sequence[str] = ()) -> DataFrame:
    """Points (by, pid, x, y) with a column in_layer: whether a region (gid, kind, rings) of the layer holds them strictly."""
    held = points_in(points, regions.where(F.col("kind") == layer), by).select(*by, "pid").distinct().withColumn("in_layer", F.lit(True))
    return points.join(held, [*by, "pid"], "left").withColumn("in_layer", F.coalesce("in_layer", F.lit(False)))


def near(points: DataFrame, regions: DataFrame, radius: float, by: Sequence[str] = (), rule: str = "even-odd") -> DataFrame:
    """(by, pid, gid, distance): regions no further than ``radius`` from points (pid, x, y).

    The boxes of the smaller side are widened by the radius: where many points meet few regions, leaves are far smaller
    than the radius, and a widened point would enter hundreds of them.
    """
    at, held = points.select(*by, "pid", "x", "y"), boxed(regions.select(*by, "gid", "rings"))
    shape = held.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_e")).alias("edges")).first()
    few, small = points.count() < shape["n"], (shape["edges"] or 0) <= EDGES
    if not few:
        wide = F.lit(float(radius)) + (F.abs("_x0") + F.abs("_x1") + F.abs("_y0") + F.abs("_y1") + radius) * 1e-12  # more than any rounding
        held = held.withColumns({c: F.col(c) + (wide if c.endswith("1") else -wide) for c in BOX})
    if small:
        held = held.withColumn("_e", flat(F.col("_e")))
    found = pairs(_at(at, radius if few else 0.0), held, by, points=not few)
    return found.withColumn("distance", (distances if small else distance)(F.col("_e"), F.col("x"), F.col("y"), rule)).where(F.col("distance") <= radius).select(*by, "pid", "gid", "distance")


def drivable_map(centres: DataFrame, features: DataFrame, radius: float = 50.0) -> DataFrame:
    """The map around each vehicle: (pid, gid, kind, rings) of all features within ``radius`` of (pid, x, y).

    ``features`` are (gid, kind, rings, lanes), lanes an array of (gid, rings). Roadblocks give themselves and their lanes,
    connectors their lanes only, intersections and car parks themselves.
    """
    found = near(centres, features, radius).join(features.where(F.col("kind").isin(*ROADBLOCKS, *AREAS)), "gid")
    whole = found.where(F.col("kind") != "ROADBLOCK_CONNECTOR").select("pid", F.col("gid").cast("string").alias("gid"), "kind", "rings")
    kind = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(ROADBLOCKS[k])), ROADBLOCKS, F)
    lanes = found.where(F.col("kind").isin(*ROADBLOCKS)).select("pid", kind.alias("kind"), F.explode("lanes").alias("l"))
    return whole.unionByName(lanes.select("pid", F.col("l.gid").cast("string").alias("gid"), "kind", F.col("l.rings").alias("rings")))
