"""Registered queries over repaired routes, matched lanes and scene files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.operators import matching, routes, storage
from rollgrid.plans.catalog import query, rounded, table
from rollgrid.sources import frames

#: Blocks of the routes' graph: each has two successors.
BLOCKS = 1009

ROUTES = f"""
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey % {BLOCKS} AS src, unnest([(2 * (c_custkey % {BLOCKS}) + 1) % {BLOCKS}, (3 * (c_custkey % {BLOCKS}) + 2) % {BLOCKS}]) AS dst FROM customer),
r AS (SELECT o_custkey AS route, list(o_orderkey * 7 % {BLOCKS} ORDER BY o_orderkey) AS ids, o_custkey * 11 % {BLOCKS} AS start FROM orders GROUP BY o_custkey),
off AS (SELECT * FROM r WHERE NOT list_contains(ids, start)),
w1(route, path, goal) AS (SELECT route, [unnest([start, (start + 1) % {BLOCKS}])], ids[1] FROM off
  UNION ALL SELECT route, list_append(path, dst), goal FROM w1 JOIN e ON src = path[-1] WHERE len(path) < 6 AND path[-1] <> goal),
p1 AS (SELECT route, min({{'n': len(path), 'p': path}}).p AS path FROM w1 WHERE path[-1] = goal GROUP BY 1),
w2(route, path, goals) AS (SELECT route, [start], ids[1:3] FROM off WHERE route NOT IN (SELECT route FROM p1)
  UNION ALL SELECT route, list_append(path, dst), goals FROM w2 JOIN e ON src = path[-1] WHERE len(path) < 7 AND NOT list_contains(goals, path[-1])),
p2 AS (SELECT route, min({{'n': len(path), 'p': path}}).p AS path FROM w2 WHERE list_contains(goals, path[-1]) GROUP BY 1),
b AS (SELECT route, CASE WHEN p1.path IS NOT NULL THEN list_concat(p1.path[1:-2], ids)
    WHEN p2.path IS NOT NULL THEN list_concat(p2.path, ids[list_position(ids, p2.path[-1]) + 1:]) ELSE ids END AS ids
  FROM r LEFT JOIN p1 USING (route) LEFT JOIN p2 USING (route)),
s AS (SELECT route, unnest(range(1, len(ids) + 1)) AS pos, unnest(ids) AS a, unnest(list_append(ids[2:], NULL)) AS z FROM b),
g AS (SELECT DISTINCT a, z FROM s WHERE a <> z AND (a, z) NOT IN (SELECT src, dst FROM e)),
w3(a, z, path) AS (SELECT a, z, [a] FROM g UNION ALL SELECT a, z, list_append(path, dst) FROM w3 JOIN e ON src = path[-1] WHERE len(path) < 7 AND path[-1] <> z),
p3 AS (SELECT a, z, min({{'n': len(path), 'p': path}}).p AS path FROM w3 WHERE path[-1] = z GROUP BY 1, 2),
f AS (SELECT route, flatten(list(coalesce(path[1:-2], [a]) ORDER BY pos)) AS ids FROM s LEFT JOIN p3 USING (a, z) GROUP BY 1),
x AS (SELECT route, unnest(range(1, len(ids) + 1)) AS pos, unnest(ids) AS id FROM f),
c AS (SELECT y.route, min(y.pos) AS cut FROM x JOIN x AS y ON x.route = y.route AND x.pos < y.pos AND x.id % 50 = 0 AND y.id % 50 = 0 AND abs(x.id - y.id) <= 50 GROUP BY 1)
SELECT route, array_to_string(CASE WHEN cut IS NULL THEN ids ELSE ids[1:cut - 1] END, ',') AS ids FROM f LEFT JOIN c USING (route)"""


@query(ROUTES)
def repaired_routes(spark, sf_dir):
    """The orders of each customer as a route over blocks: begun at the customer's block, linked and cut before loops."""
    here = F.lit(0).alias("graph")
    block = F.col("c_custkey") % BLOCKS
    ways = F.explode(F.array((block * 2 + 1) % BLOCKS, (block * 3 + 2) % BLOCKS)).alias("dst")
    edges = table(spark, sf_dir, "customer").select(here, block.alias("src"), ways)
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("route"))
    ids = F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") * 7 % BLOCKS).alias("id"))))["id"]
    each = orders.agg(ids.alias("ids")).select(here, "route", "ids")
    start = F.col("route") * 11 % BLOCKS
    starts = each.select("graph", "route", start.alias("start"), F.array(start, (start + 1) % BLOCKS).alias("candidates"))
    joints = spark.range(0, BLOCKS, 50).select(here, F.col("id").alias("a"), F.explode(F.array("id", F.col("id") + 50)).alias("b"))
    out = routes.repaired(each, starts, edges, joints, backward=6, forward=7)
    return out.select("route", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def lanes_and_states(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as two rows of lanes, and line items as states of their order, which drives along them."""
    n = F.col("n_nationkey")
    x0, y0 = F.floor(n / 2) * 40, (n % 2) * 7.3
    ring = F.array(*[F.struct((x0 + dx).cast("double").alias("x"), (y0 + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (45, 0), (45, 4), (0, 4))])
    nations = table(spark, sf_dir, "nation")
    lanes = nations.select(F.lit(0).alias("scene"), n.alias("lane"), F.array(ring).alias("rings"))
    edges = nations.select(F.lit(0).alias("scene"), n.alias("src"), F.explode(F.array(n + 2, n + 3 - 2 * (n % 2))).alias("dst"))
    x = F.col("l_orderkey") * 13 % 400 + F.col("l_linenumber") * 17.01 + F.col("l_discount") * 10
    y = F.col("l_partkey") % 190 / 10 - 4.123
    sent = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").repartition("l_orderkey")  # by agent, as matching takes them
    rows = sent.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_discount").alias("l_discount"))
    items = rows.select(F.lit(0).alias("scene"), F.col("l_orderkey").alias("agent"), F.col("l_linenumber").alias("step"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    return items, lanes, edges


LANES = """
l AS (SELECT n_nationkey AS lane, n_nationkey // 2 * 40 AS x0, n_nationkey % 2 * 7.3::DOUBLE AS y0 FROM nation),
e AS (SELECT n_nationkey AS src, unnest([n_nationkey + 2, n_nationkey + 3 - 2 * (n_nationkey % 2)]) AS dst FROM nation),
s AS (SELECT l_orderkey AS agent, l_linenumber AS step, l_orderkey * 13 % 400 + l_linenumber * 17.01::DOUBLE + l_discount * 10::DOUBLE AS x, l_partkey % 190 / 10.0::DOUBLE - 4.123::DOUBLE AS y FROM (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)),
d AS (SELECT agent, step, lane, sqrt(pow(greatest(x0 - x, x - x0 - 45, 0.0::DOUBLE), 2) + pow(greatest(y0 - y, y - y0 - 4, 0.0::DOUBLE), 2)) AS distance FROM s, l),
f AS (SELECT agent, min({'d': distance, 'l': lane}).l AS lane FROM (SELECT *, min(step) OVER (PARTITION BY agent) AS least FROM d) WHERE step = least AND distance <= 10 GROUP BY 1),"""


@query(f"""
WITH {LANES}
c AS (SELECT agent, lane AS src, lane, 1 AS own FROM f UNION ALL SELECT agent, src, dst, 0 FROM f JOIN e ON src = lane),
m AS (SELECT agent, step, min({{'d': distance, 'o': own, 'l': lane}}) AS b FROM c JOIN d USING (agent, lane) WHERE own = 1 OR step <> (SELECT min(step) FROM d AS t WHERE t.agent = c.agent) GROUP BY 1, 2)
SELECT agent, step, b.l AS lane, round(b.d, 6) AS distance FROM m""")
def matched_lanes(spark, sf_dir):
    """States of orders, matched to the lane they start on and its successors."""
    return rounded(matching.matched(*lanes_and_states(spark, sf_dir)).drop("scene"))


@query(f"""
WITH RECURSIVE {LANES}
o AS (SELECT d.agent, d.step, d.lane, distance FROM d WHERE distance <= 10),
k AS (SELECT agent, step, row_number() OVER (PARTITION BY agent ORDER BY step) AS n FROM s),
w(agent, n, lane, been) AS (SELECT agent, 1::BIGINT, lane, [lane] FROM f UNION ALL
  SELECT agent, n, lane, list_append(been, lane) FROM (
    SELECT w.agent, k.n, coalesce(min(CASE WHEN e.dst IS NOT NULL OR list_contains(w.been, o.lane) THEN {{'d': o.distance, 'o': CASE WHEN e.dst IS NULL THEN 1 ELSE 0 END, 'l': o.lane}} END).l, w.lane) AS lane, w.been
    FROM w JOIN k ON k.agent = w.agent AND k.n = w.n + 1 LEFT JOIN o ON o.agent = k.agent AND o.step = k.step LEFT JOIN e ON e.src = w.lane AND e.dst = o.lane
    GROUP BY w.agent, k.n, w.lane, w.been))
SELECT w.agent, k.step, w.lane FROM w JOIN k USING (agent, n)""")
def walked_lanes(spark, sf_dir):
    """States of orders, matched along the lanes they can drive."""
    return matching.walked(*lanes_and_states(spark, sf_dir)).drop("scene")


def event_logs(spark, sf_dir) -> str:
    """The events as logs of frames, one folder of JSON lines for each kind; their path."""
    path = f"{storage.folder(spark)}/frame-logs-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("log_name"), F.col("event_id").cast("string").alias("token"), "user_id", F.array("value", F.col("user_id").cast("double")).alias("pose"))
    rows.write.partitionBy("log_name").json(path)
    return path


@query("SELECT event_type AS log_name, event_id::VARCHAR AS token, value AS x FROM events")
def logged_frames(spark, sf_dir):
    """Events as frames of logs, read in byte ranges by the data source."""
    out = frames.frames(spark, event_logs(spark, sf_dir), "log_name string, token string, pose array<double>")
    return out.select("log_name", "token", F.element_at("pose", 1).alias("x"))


@query("""
SELECT s.supplier, count(e.event_id)::BIGINT AS frames, round(sum(e.value), 4) AS total
FROM (SELECT s_suppkey::VARCHAR AS supplier, s_suppkey FROM supplier) AS s LEFT JOIN (SELECT * FROM events WHERE event_type IN ('click', 'purchase')) AS e ON e.user_id = s.s_suppkey GROUP BY 1""")
def frames_of_logs(spark, sf_dir):
    """Frames of the logs that the filter names, by supplier: the other logs' files are not opened."""
    logs = frames.frames(spark, event_logs(spark, sf_dir), "log_name string, user_id long, pose array<double>").where(F.col("log_name").isin("click", "purchase"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("user_id"))
    each = suppliers.join(logs, "user_id", "left").groupBy(F.col("user_id").cast("string").alias("supplier"))
    return rounded(each.agg(F.count("log_name").alias("frames"), F.sum(F.element_at("pose", 1)).alias("total")), 4)
