"""Searches over lane and road graphs (nodes, edges with src, dst and optional cost)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.operators.storage import stored


def reached(edges: DataFrame, starts: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """(start, node, depth): the least number of edges from each start, up to a depth.

    One join for each level, which is written and read again, so that no plan holds more than one level; the search ends
    where a level finds nothing new.
    """
    src, dst = ("dst", "src") if backward else ("src", "dst")
    steps = stored(edges.select(F.col(src).alias("node"), F.col(dst).alias("_next")).distinct(), "graph-steps")
    seen = front = stored(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct(), "graph-level")
    for level in range(1, depth + 1):
        following = front.join(steps, "node").select("start", F.col("_next").alias("node")).distinct()
        front = following.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level))
        front = stored(front, "graph-level")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, queries: DataFrame, graph: str = "graph", delta: float | None = None) -> DataFrame:
    """For queries (graph, src, dst): the cheapest path, its cost, and whether the target was found.

    Edges are (graph, src, dst, cost), graphs of any size; costs are 0 or more, and edges without a cost are left out. Of
    paths of equal cost that of fewer edges is taken, then the smallest in the order of its nodes. Where the target cannot
    be reached, the path leads to the reached node that is the most edges away (of these the cheapest, then the smallest).

    Delta stepping: every node that a start has reached has a label of cost, edges and path. In each round the open labels
    within ``delta`` of the cheapest (all, by default) are carried over their edges, the least label of each node is an
    aggregation, and nodes whose label fell are open again. Labels are written and read again, so no plan holds more than a
    round, and no task sees a whole graph.
    """
    if not edges.where(F.col("cost") < 0).isEmpty():
        raise ValueError("costs must not be negative")
    key = [graph, "start", "node"]
    steps = edges.where(F.col("cost").isNotNull()).groupBy(graph, F.col("src").alias("node"), F.col("dst").alias("_next")).agg(F.min(F.col("cost").cast("double")).alias("_cost"))
    steps = stored(steps, "graph-steps")
    node = edges.schema["src"].dataType.simpleString()
    zero = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("edges"), F.array(F.col("src").cast(node)).alias("path"))
    known = left = stored(queries.select(graph, F.col("src").cast(node).alias("start"), F.col("src").cast(node).alias("node"), zero.alias("label")).distinct(), "graph-labels")
    while not left.isEmpty():
        bound = None if delta is None else left.agg(F.min("label.cost")).first()[0] + delta
        active, later = (left, None) if bound is None else (left.where(F.col("label.cost") <= bound), left.where(F.col("label.cost") > bound))
        following = F.struct((F.col("label.cost") + F.col("_cost")).alias("cost"), (F.col("label.edges") + 1).alias("edges"), F.concat("label.path", F.array("_next")).alias("path"))
        reached_ = active.join(steps, [graph, "node"]).select(graph, "start", F.col("_next").alias("node"), following.alias("label")).groupBy(*key).agg(F.min("label").alias("label"))
        better = reached_.join(known.withColumnRenamed("label", "_old"), key, "left").where(F.col("_old").isNull() | (F.col("label") < F.col("_old"))).drop("_old")
        better = stored(better, "graph-better")
        known = stored(known.unionByName(better).groupBy(*key).agg(F.min("label").alias("label")), "graph-labels")
        # a label that has fallen meanwhile is open with its new value only
        left = better if later is None else stored(later.unionByName(better).groupBy(*key).agg(F.min("label").alias("label")), "graph-open")
    asked = queries.select(graph, F.col("src").cast(node).alias("src"), F.col("dst").cast(node).alias("dst"))
    hit = asked.join(known.select(graph, F.col("start").alias("src"), F.col("node").alias("dst"), "label"), [graph, "src", "dst"], "left")
    furthest = known.groupBy(graph, F.col("start").alias("src")).agg(F.max("label.edges").alias("_most"))
    ends = known.withColumnRenamed("start", "src").join(furthest, [graph, "src"]).where(F.col("label.edges") == F.col("_most"))
    ends = ends.groupBy(graph, "src").agg(F.min_by("label", F.struct("label.cost", "node")).alias("_end"))
    out = hit.join(ends, [graph, "src"]).withColumn("_l", F.coalesce("label", "_end"))
    return out.select(graph, "src", "dst", F.col("_l.path").alias("path"), F.col("_l.cost").alias("cost"), F.col("label").isNotNull().alias("found"))


def without_loops(routes: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Routes (route, ids) cut before the first id that overlaps an earlier one; overlaps: (route, a, b)."""
    each = routes.select("route", F.posexplode("ids").alias("pos", "id"))
    x, y = each.alias("x"), each.alias("y")
    pairs = overlaps.select("route", F.col("a").alias("one"), F.col("b").alias("two")).unionByName(overlaps.select("route", F.col("b").alias("one"), F.col("a").alias("two"))).distinct()
    met = x.join(pairs, (F.col("x.route") == pairs["route"]) & (F.col("x.id") == pairs["one"])).join(y, (F.col("y.route") == F.col("x.route")) & (F.col("y.id") == pairs["two"]) & (F.col("y.pos") > F.col("x.pos")))
    cut = met.groupBy(F.col("x.route").alias("route")).agg(F.min("y.pos").alias("cut"))
    return routes.join(cut, "route", "left").select("route", F.when(F.col("cut").isNull(), F.col("ids")).otherwise(F.slice("ids", F.lit(1), F.col("cut"))).alias("ids"))


def centreline(paths: DataFrame, lanes: DataFrame) -> DataFrame:
    """Poses of the lanes (lane, poses) of a path (path_id, path) one after the other."""
    each = paths.select("path_id", F.posexplode("path").alias("pos", "lane")).join(lanes, "lane")
    return each.groupBy("path_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("pos", "poses")))["poses"]).alias("poses"))


def nearest_lane(candidates: DataFrame, key: str) -> DataFrame:
    """Of lanes (key, lane, on_route, contains, heading_error, distance): on the route the least heading error, else one
    that contains the point, else the nearest."""
    preference = F.when(F.col("on_route"), 0).when(F.col("contains"), 1).otherwise(2)
    measure = F.when(F.col("on_route"), F.col("heading_error")).otherwise(F.col("distance"))
    place = F.row_number().over(W.partitionBy(key).orderBy(preference, measure, "lane"))
    return candidates.withColumn("_n", place).where("_n = 1").drop("_n")
