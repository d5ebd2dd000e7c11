"""Routes over a graph of blocks: shortest links by two searches that meet, and the repair of broken routes.

A search for many pairs at once advances level by level. Each round carries the smaller of the two frontiers (from the
starts onwards, or from the ends back) over its edges, so nodes are visited only up to half of a path away from either
end. A frontier's row holds the way it came, which the greatest number of nodes of a path bounds. Levels are written and read
again, so no plan holds more than one; pairs that have met, or have nowhere to go, are open no longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.operators import graph
from rollgrid.operators.storage import stored

KEY = ["graph", "query"]


def links(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(graph, query, path): for each query the shortest path of at most ``most`` nodes from any of its starts to any of its
    ends, of equally short ones the smallest in the order of its nodes; queries without one have no row.

    ``edges`` are (graph, src, dst), ``starts`` and ``ends`` (graph, query, node). Rows with a null are left out, and
    repeated rows count once. A node that is both start and end is a path by itself.
    """
    whole = lambda df: df.where(" and ".join(f"{c} is not null" for c in df.columns)).distinct()
    steps = stored(whole(edges.select("graph", "src", "dst")), "route-steps")
    front = [stored(whole(df.select(*KEY, "node")).withColumn("path", F.array("node")), "route-level") for df in (starts, ends)]
    seen = [df.drop("path") for df in front]
    open_ = front[0].select(*KEY).distinct().join(front[1].select(*KEY).distinct(), KEY, "left_semi")
    sizes = [df.count() for df in front]
    found, one = None, 0
    for nodes in range(1, most + 1):
        if nodes > 1:
            one = 0 if sizes[0] <= sizes[1] else 1
            here, there = ("src", "dst") if one == 0 else ("dst", "src")
            ahead = front[one].join(open_, KEY, "left_semi").join(steps.select("graph", F.col(here).alias("node"), F.col(there).alias("_next")), ["graph", "node"])
            way = F.concat("path", F.array("_next")) if one == 0 else F.concat(F.array("_next"), "path")
            level = ahead.select(*KEY, F.col("_next").alias("node"), way.alias("path")).groupBy(*KEY, "node").agg(F.min("path").alias("path"))
            front[one] = stored(level.join(seen[one], [*KEY, "node"], "left_anti"), "route-level")
            sizes[one] = front[one].count()
            if not sizes[one]:
                break
            seen[one] = seen[one].unionByName(front[one].drop("path"))
        # a node where both frontiers meet lies in the middle of a shortest path
        other = front[1].select(*KEY, "node", F.expr("slice(path, 2, size(path))").alias("_rest"))
        met = front[0].join(other, [*KEY, "node"]).groupBy(*KEY).agg(F.min(F.concat("path", "_rest")).alias("path"))
        alive = front[one].select(*KEY).distinct()
        state = stored(open_.join(alive, KEY, "left_semi").join(met, KEY, "left"), "route-state")
        ended = state.where("path is not null")
        found = ended if found is None else found.unionByName(ended)
        open_ = state.where("path is null").select(*KEY)
        if open_.isEmpty():
            break
    return found


def _after(ids: Column, last: Column) -> Column:
    """The ids behind the first place of ``last``."""
    return F.slice(ids, F.array_position(ids, last).cast("int") + 1, F.size(ids))


def begun(routes: DataFrame, starts: DataFrame, edges: DataFrame, backward: int = 15, forward: int = 30) -> DataFrame:
    """Routes (graph, route, ids) that begin where their vehicle stands: see ``repaired``."""
    key = ["graph", "route"]
    off = routes.join(starts, key).where((F.size("ids") > 0) & F.col("start").isNotNull() & ~F.coalesce(F.array_contains("ids", F.col("start")), F.lit(False)))
    off = stored(off.select("graph", F.col("route").alias("query"), "ids", "start", "candidates"), "route-off")
    before = links(edges, off.select(*KEY, F.explode("candidates").alias("node")), off.select(*KEY, F.element_at("ids", 1).alias("node")), backward)
    lost = off.join(before, KEY, "left_anti")
    onto = links(edges, lost.select(*KEY, F.col("start").alias("node")), lost.select(*KEY, F.explode(F.slice("ids", 1, 3)).alias("node")), forward)
    ways = before.select("graph", F.col("query").alias("route"), F.col("path").alias("_before"), F.lit(None).cast(before.schema["path"].dataType).alias("_onto"))
    ways = ways.unionByName(onto.select("graph", F.col("query").alias("route"), F.lit(None).cast(before.schema["path"].dataType).alias("_before"), F.col("path").alias("_onto")))
    prepended = F.concat(F.slice("_before", F.lit(1), F.size("_before") - 1), "ids")
    joined = F.concat("_onto", _after(F.col("ids"), F.element_at("_onto", -1)))
    ids = F.when(F.col("_before").isNotNull(), prepended).when(F.col("_onto").isNotNull(), joined).otherwise(F.col("ids"))
    return routes.join(ways, key, "left").select(*key, ids.alias("ids"))


def bridged(routes: DataFrame, edges: DataFrame, forward: int = 30) -> DataFrame:
    """Routes (graph, route, ids) with the blocks that lead from each id to the next where no edge does. Each missing link is
    searched once, however many routes lack it; what cannot be linked in ``forward`` nodes stays as it is."""
    key = ["graph", "route"]
    each = routes.select(*key, "ids", F.posexplode("ids").alias("pos", "src")).select(*key, "pos", "src", F.get("ids", F.col("pos") + 1).alias("dst"))
    gaps = each.select("graph", "src", "dst").where("src <> dst").distinct().join(edges.select("graph", "src", "dst"), ["graph", "src", "dst"], "left_anti")
    gaps = stored(gaps.withColumn("query", F.struct("src", "dst")), "route-gaps")
    found = links(edges, gaps.select(*KEY, F.col("src").alias("node")), gaps.select(*KEY, F.col("dst").alias("node")), forward)
    between = found.select("graph", "query.src", "query.dst", F.expr("slice(path, 2, size(path) - 2)").alias("_mid"))
    step = F.struct("pos", F.when(F.col("_mid").isNull(), F.array("src")).otherwise(F.concat(F.array("src"), "_mid")).alias("ids"))
    whole = each.join(between, ["graph", "src", "dst"], "left").groupBy(*key).agg(F.flatten(F.sort_array(F.collect_list(step))["ids"]).alias("_ids"))
    return routes.join(whole, key, "left").select(*key, F.coalesce("_ids", "ids").alias("ids"))


def unlooped(routes: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Routes (graph, route, ids) cut before the first id that overlaps an earlier one, by the overlaps (graph, a, b) of their
    graph. A pair of an id with itself tells that its second visit is a loop."""
    name = F.struct("graph", "route")
    flat = routes.select("graph", "route", F.explode(F.array_distinct("ids")).alias("id"))
    both = overlaps.select("graph", "a", "b").unionByName(overlaps.select("graph", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    own = flat.join(both, (flat["graph"] == both["graph"]) & (F.col("id") == F.col("a"))).select(F.struct(flat["graph"], "route").alias("route"), "a", "b")
    cut = graph.without_loops(routes.select(name.alias("route"), "ids"), own)
    return cut.select("route.graph", "route.route", "ids")


def repaired(routes: DataFrame, starts: DataFrame, edges: DataFrame, overlaps: DataFrame | None = None, backward: int = 15, forward: int = 30) -> DataFrame:
    """(graph, route, ids): routes that begin at their vehicle, without gaps and loops.

    ``routes`` are (graph, route, ids), ``starts`` (graph, route, start, candidates): the block a vehicle stands on and the
    blocks it may as well be on; ``edges`` (graph, src, dst). In this order:

    1. Where the start is not on the route, the shortest path of at most ``backward`` blocks from any candidate to the
       route's first block goes before the route. Without one, the shortest path of at most ``forward`` blocks from the start
       to one of the first three takes the place of the route up to there. Without either the route stays.
    2. Blocks that no edge links get the shortest path between them, of at most ``forward`` blocks with both ends.
    3. The route ends before the first block that overlaps an earlier one.

    Of equally short paths the smallest in the order of its blocks is taken. Routes without ids, and routes without a
    start, are kept; a route must be there once in its graph.
    """
    out = stored(begun(routes, starts, edges, backward, forward), "route-begun")
    out = bridged(out, edges, forward)
    return out if overlaps is None else unlooped(stored(out, "route-bridged"), overlaps)
