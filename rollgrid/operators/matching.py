"""Map matching: the lanes along which a vehicle's states run."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.functions.arrays import bound
from rollgrid.operators import polygons
from rollgrid.operators.storage import stored

KEY = ["scene", "agent"]
#: Lanes, and edges and ways of all of them, up to which a map goes to all tasks.
LANES, PARTS = 1_000, 65_536


def _finite(states: DataFrame) -> DataFrame:
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return states.select(*KEY, "step", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(good("x") & good("y"))


def first_lanes(states: DataFrame, lanes: DataFrame, radius: float = 10.0) -> DataFrame:
    """(scene, agent, lane, distance): the lane nearest to the first state of each agent, of equal ones the smallest.

    ``states`` are (scene, agent, step, x, y), each step once, ``lanes`` (scene, lane, rings). The first state is the one of the
    least step with finite coordinates. Agents with no lane within ``radius`` of it give no row.
    """
    return _nearest(_first(_finite(states)), lanes, radius)


def _first(held: DataFrame) -> DataFrame:
    """The step and place of the first state of each agent, stored, as they are read several times."""
    first = held.groupBy(*KEY).agg(F.min(F.struct("step", "x", "y")).alias("_p"))
    return stored(first.select(*KEY, F.col("_p.step").alias("_first"), "_p.x", "_p.y"), "first-states")


def _nearest(first: DataFrame, lanes: DataFrame, radius: float) -> DataFrame:
    points = first.select("scene", F.col("agent").alias("pid"), "x", "y")
    held = polygons.near(points, lanes.select("scene", F.col("lane").alias("gid"), "rings"), radius, ["scene"])
    best = held.groupBy("scene", "pid").agg(F.min(F.struct("distance", "gid")).alias("_b"))
    return best.select("scene", F.col("pid").alias("agent"), F.col("_b.gid").alias("lane"), F.col("_b.distance").alias("distance"))


def matched(states: DataFrame, lanes: DataFrame, edges: DataFrame, radius: float = 10.0) -> DataFrame:
    """(scene, agent, step, lane, distance): for each state the nearest of the lane the agent starts on and that lane's
    successors by ``edges`` (scene, src, dst).

    Of equally near lanes a successor goes before the first lane, then the smallest. The first state is on the first lane.
    Agents with no lane within ``radius`` of their first state, and states without finite coordinates, give no row.

    A map of few lanes (``LANES``, ``PARTS``) goes to all tasks, and states move once, to the task of their agent, which
    sorts them. With larger ones first lanes are searched through ``polygons.near`` and joined to the states.
    """
    lanes = lanes.where(F.col("scene").isNotNull() & F.col("lane").isNotNull())
    shapes = polygons.boxed(lanes.select("scene", "lane", "rings")).withColumn("_e", polygons.flat(F.col("_e")))
    size = shapes.agg(F.count(F.lit(1)).alias("lanes"), F.sum(F.size("_e") / 4).alias("edges"), F.max(F.size("_e") / 4).alias("most")).first()
    if size["lanes"] <= LANES and (size["edges"] or 0) <= PARTS:
        small = _small_map(shapes, edges, lanes.schema["lane"].dataType.simpleString())
        if small is not None:
            return _matched_on(small, _finite(states), shapes, radius)
    held = stored(_finite(states), "states")
    first = _first(held)
    begin = stored(_nearest(first, lanes, radius).select(*KEY, F.col("lane").alias("src")).join(first.select(*KEY, "_first"), KEY), "first-lanes")
    ways = edges.select("scene", "src", F.col("dst").alias("lane")).distinct()
    some = begin.select("scene", "src").distinct()
    own = some.select("scene", "src", F.col("src").alias("lane"), F.lit(1).alias("_own")).unionByName(some.join(ways, ["scene", "src"]).withColumn("_own", F.lit(0)))
    own = own.groupBy("scene", "src", "lane").agg(F.min("_own").alias("_own"))
    small = (size["most"] or 0) <= polygons.EDGES
    shapes = shapes if small else polygons.boxed(lanes.select("scene", "lane", "rings"))
    own = own.join(shapes.select("scene", "lane", "_e"), ["scene", "lane"])
    each = held.join(begin, KEY).join(own, ["scene", "src"]).where((F.col("step") != F.col("_first")) | (F.col("lane") == F.col("src")))
    measured = each.select(*KEY, "step", "lane", "_own", (polygons.distances if small else polygons.distance)(F.col("_e"), F.col("x"), F.col("y")).alias("distance"))
    best = measured.groupBy(*KEY, "step").agg(F.min(F.struct("distance", "_own", "lane")).alias("_b"))
    return best.select(*KEY, "step", "_b.lane", "_b.distance")


@dataclass
class SmallMap:
    """Lanes in their order by number, from 0: scenes, boxes, edges, and the lanes that may follow each, with itself."""

    scene: np.ndarray
    box: np.ndarray
    edges: list[np.ndarray]
    after: list[list[int]]
    same: list[set[int]]

    def first(self, scene: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
        """The nearest lane within the radius, of equal ones the smallest, or -1."""
        lane, best = np.full(len(x), -1), np.full(len(x), np.inf)
        for i, (x0, y0, x1, y1) in enumerate(self.box):
            wide = radius + (abs(x0) + abs(y0) + abs(x1) + abs(y1) + radius) * 1e-12  # more than any rounding
            at = np.flatnonzero((scene == self.scene[i]) & (x >= x0 - wide) & (x <= x1 + wide) & (y >= y0 - wide) & (y <= y1 + wide))
            if len(at):
                d = polygons.far(self.edges[i], x[at], y[at])
                better = (d <= radius) & (d < best[at])
                lane[at[better]], best[at[better]] = i, d[better]
        return lane

    def nearest(self, begin: np.ndarray, first: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lane and distance of each state of agents that begin on a lane; their first states stay on it."""
        lane, best = np.full(len(x), -1), np.full(len(x), np.inf)
        order = np.argsort(begin, kind="stable")
        starts, cuts = np.unique(begin[order], return_index=True)
        for i, rows in zip(starts, np.split(order, cuts[1:])):
            for j in self.after[i] if i >= 0 else ():
                at = rows if j in self.same[i] else rows[~first[rows]]
                if len(at):
                    d = polygons.far(self.edges[j], x[at], y[at])
                    better = (lane[at] < 0) | (d < best[at]) | (np.isnan(best[at]) & ~np.isnan(d))  # distances may overflow
                    lane[at[better]], best[at[better]] = j, d[better]
        return lane, best


def _numbered(shapes: DataFrame) -> DataFrame:
    """The lanes of a small map with the numbers of their scene and their own, both in order from 0."""
    return shapes.withColumns({"_s": F.dense_rank().over(W.orderBy("scene")) - 1, "_n": F.row_number().over(W.orderBy("scene", "lane")) - 1})


def _small_map(shapes: DataFrame, edges: DataFrame, kind: str) -> SmallMap | None:
    """The lanes of ``shapes``, or None if too many ways join them."""
    ends = shapes.select("scene", "lane").distinct()
    ways = edges.select("scene", F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).distinct()
    for end in ("src", "dst"):
        ways = ways.join(F.broadcast(ends.withColumnRenamed("lane", end)), ["scene", end], "left_semi")
    pairs = ways.select("scene", "src", "dst").limit(PARTS + 1).collect()
    if len(pairs) > PARTS:
        return None
    rows = sorted(_numbered(shapes).collect(), key=lambda r: r["_n"])
    numbers, follow = {}, {}
    for r in rows:
        numbers.setdefault((r["scene"], r["lane"]), []).append(r["_n"])
    for p in pairs:
        follow.setdefault((p["scene"], p["src"]), set()).update(numbers[p["scene"], p["dst"]])
    same = [set(numbers[r["scene"], r["lane"]]) for r in rows]
    after = [sorted(follow.get((r["scene"], r["lane"]), ())) for r in rows]  # of equal ones a successor goes before the lane itself
    after = [[*a, *sorted(s - set(a))] for a, s in zip(after, same)]
    box = np.array([[r[c] for c in polygons.BOX] for r in rows], float).reshape(-1, 4)
    return SmallMap(np.array([r["_s"] for r in rows], int), box, [np.array(r["_e"], float).reshape(-1, 4) for r in rows], after, same)


def _matched_on(small: SmallMap, held: DataFrame, shapes: DataFrame, radius: float) -> DataFrame:
    """``matched`` on a map that all tasks have: states are sent once, to the task of their agent, and put on lanes there."""
    numbered = _numbered(shapes.select("scene", "lane"))
    given = held.sparkSession.sparkContext.broadcast(small)

    def on(scene: pa.Array, x: pa.Array, y: pa.Array, x0: pa.Array, y0: pa.Array, first: pa.Array) -> pa.Array:
        scene, x, y, x0, y0, first = (v.to_numpy(zero_copy_only=False) for v in (scene, x, y, x0, y0, first))
        new = np.concatenate([[True], (scene[1:] != scene[:-1]) | (x0[1:] != x0[:-1]) | (y0[1:] != y0[:-1])])[: len(x)]  # an agent's states follow each other
        begin = given.value.first(scene[new], x0[new], y0[new], radius)[np.cumsum(new) - 1]
        lane, distance = given.value.nearest(begin, first.astype(bool), x, y)
        return pa.StructArray.from_arrays([pa.array(lane, pa.int32()), pa.array(distance, pa.float64())], ["n", "distance"])

    scenes = numbered.select("scene", "_s").distinct()
    begin = F.first(F.struct("step", "x", "y")).over(W.partitionBy(*KEY).orderBy("step", "x", "y"))
    states = held.where(F.col("agent").isNotNull()).withColumn("_p", begin).join(F.broadcast(scenes), "scene")
    first = ~F.coalesce(F.col("step") != F.col("_p.step"), F.lit(False))
    put = F.arrow_udf(on, "n int, distance double").asNondeterministic()(F.col("_s"), F.col("x"), F.col("y"), F.col("_p.x"), F.col("_p.y"), first)
    out = states.select(*KEY, "step", put.alias("_b")).where("_b.n >= 0").select(*KEY, "step", F.col("_b.n").alias("_n"), "_b.distance")
    return out.join(F.broadcast(numbered.select("_n", "lane")), "_n").select(*KEY, "step", "lane", "distance")


def walked(states: DataFrame, lanes: DataFrame, edges: DataFrame, radius: float = 10.0) -> DataFrame:
    """(scene, agent, step, lane): as ``matched``, but along the lanes: after each state the successors of the lane it is on
    may follow, and every lane the agent has been on.

    Only lanes within ``radius`` of a state count; where none of them may follow, the agent stays on its lane. Of equally
    near lanes a successor goes before a lane it has been on, then the smallest. The states of an agent are folded in their
    order, in one array, so an agent's states must fit a row.
    """
    t = lanes.schema["lane"].dataType.simpleString()
    none = F.expr(f"cast(array() as array<{t}>)")
    held = stored(_finite(states).where(F.col("agent").isNotNull()), "states")
    points = held.select("scene", F.struct("agent", "step").alias("pid"), "x", "y")
    close = polygons.near(points, lanes.select("scene", F.col("lane").alias("gid"), "rings"), radius, ["scene"])
    follow = edges.groupBy("scene", F.col("src").cast(t).alias("lane")).agg(F.collect_set(F.col("dst").cast(t)).alias("_next"))
    close = close.select("scene", "pid.agent", "pid.step", F.col("gid").alias("lane"), "distance").join(follow, ["scene", "lane"], "left")
    option = F.struct("distance", "lane", F.coalesce("_next", none).alias("next"))
    # every state has a row without an option, so those far from all lanes stay; lists leave nulls out
    rows = close.select(*KEY, "step", option.alias("_o")).unionByName(held.select(*KEY, "step"), allowMissingColumns=True)
    steps = rows.repartition(*KEY).groupBy(*KEY, "step").agg(F.collect_list("_o").alias("options"))
    folded = steps.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("step", "options"))).alias("_steps"))
    folded = folded.withColumn("_begin", F.array_min(F.element_at("_steps", 1)["options"])).where(F.col("_begin").isNotNull())
    zero = F.struct(F.array("_begin.lane").alias("path"), F.col("_begin.next").alias("next"))

    def on(state, step):
        may = F.filter(step["options"], lambda o: F.array_contains(state["next"], o["lane"]) | F.array_contains(state["path"], o["lane"]))
        ranked = F.transform(may, lambda o: F.struct(o["distance"].alias("distance"), F.when(F.array_contains(state["next"], o["lane"]), 0).otherwise(1).alias("own"), o["lane"].alias("lane"), o["next"].alias("next")))
        lane = lambda best: F.coalesce(best["lane"], F.element_at(state["path"], -1))
        return bound(F.array_min(ranked), lambda best: F.struct(F.concat(state["path"], F.array(lane(best))).alias("path"), F.coalesce(best["next"], state["next"]).alias("next")))

    rest = F.slice("_steps", F.lit(2), F.greatest(F.size("_steps") - 1, F.lit(0)))
    out = folded.select(*KEY, F.col("_steps.step").alias("_at"), F.aggregate(rest, zero, on)["path"].alias("_path"))
    return out.select(*KEY, F.explode(F.arrays_zip("_at", "_path")).alias("_z")).select(*KEY, F.col("_z._at").alias("step"), F.col("_z._path").alias("lane"))


def paths(matches: DataFrame) -> DataFrame:
    """(path_id, path): the lanes of each agent in the order of its states, as ``graph.centreline`` takes them."""
    step = F.sort_array(F.collect_list(F.struct("step", "lane")))
    return matches.groupBy(F.struct(*KEY).alias("path_id")).agg(step["lane"].alias("path"))
