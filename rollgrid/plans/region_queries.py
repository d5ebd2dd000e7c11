"""Registered queries over regions, lines, corridors and nearest objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.operators import corridors, polygons, polylines, scorer, spatial
from rollgrid.plans.catalog import query, rounded, table


def corner(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(points: list[tuple[Column, float]]) -> Column:
    return F.array(*[corner(x, F.lit(y)) for x, y in points])


def yards(spark, sf_dir) -> DataFrame:
    """A U-shaped region for each nation, with a hole in its left arm."""
    at = lambda *pairs: ring([(F.col("n_nationkey") * 400 - 1000 + dx, y) for dx, y in pairs])
    outer = at((0, 0), (900, 0), (900, 20), (600, 20), (600, 8), (300, 8), (300, 20), (0, 20))
    hole = at((50, 2), (200, 2), (200, 6), (50, 6))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gid"), F.array(outer, hole).alias("rings"))


YARDS = "SELECT n_nationkey AS gid, n_nationkey * 400 - 1000 AS lx FROM nation"


@query(f"""
SELECT c_custkey AS pid, gid FROM (SELECT c_custkey, c_acctbal + 0.003 AS x, c_nationkey * 0.9 + 0.13 AS y FROM customer), ({YARDS})
WHERE x > lx AND x < lx + 900 AND y > 0 AND y < 20 AND NOT (x >= lx + 300 AND x <= lx + 600 AND y >= 8) AND NOT (x >= lx + 50 AND x <= lx + 200 AND y >= 2 AND y <= 6)""")
def points_in_regions(spark, sf_dir):
    """Customers strictly inside concave regions with holes."""
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_acctbal") + 0.003).alias("x"), (F.col("c_nationkey") * 0.9 + 0.13).alias("y"))
    return polygons.points_in(points, yards(spark, sf_dir))


def customer_boxes(spark, sf_dir) -> DataFrame:
    x, y = F.col("c_acctbal") + 0.003, F.col("c_nationkey") * 0.9 + 0.13
    box = F.array(*[corner(x + dx, y + dy) for dx, dy in ((-60, -0.7), (60, -0.7), (60, 0.7), (-60, 0.7))])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.array(box).alias("rings"))


BOXES = "SELECT c_custkey AS qid, c_acctbal + 0.003 - 60 AS x0, c_acctbal + 0.003 + 60 AS x1, c_nationkey * 0.9 + 0.13 - 0.7 AS y0, c_nationkey * 0.9 + 0.13 + 0.7 AS y1 FROM customer"


@query(f"""
SELECT qid, gid FROM ({BOXES}), ({YARDS})
WHERE ((x0 <= lx + 300 AND x1 >= lx AND y0 <= 20 AND y1 >= 0) OR (x0 <= lx + 900 AND x1 >= lx + 600 AND y0 <= 20 AND y1 >= 0) OR (x0 <= lx + 900 AND x1 >= lx AND y0 <= 8 AND y1 >= 0))
  AND NOT (x0 > lx + 50 AND x1 < lx + 200 AND y0 > 2 AND y1 < 6)""")
def regions_met(spark, sf_dir):
    """Boxes that share a point with a concave region; a box in the notch or in the hole does not."""
    return polygons.met(customer_boxes(spark, sf_dir), yards(spark, sf_dir))


@query(f"""
SELECT qid, gid FROM ({BOXES}), ({YARDS})
WHERE x0 >= lx AND x1 <= lx + 900 AND y0 >= 0 AND y1 <= 20 AND NOT (x0 < lx + 600 AND x1 > lx + 300 AND y1 > 8) AND NOT (x0 < lx + 200 AND x1 > lx + 50 AND y0 < 6 AND y1 > 2)""")
def regions_within(spark, sf_dir):
    """Boxes that lie wholly in a concave region with a hole."""
    return polygons.met(customer_boxes(spark, sf_dir), yards(spark, sf_dir), "within")


@query("""
WITH s AS (SELECT n_nationkey AS lid, unnest([0, 1]) AS seg, n_nationkey * 400 - 1000 + unnest([0, 200]) AS x0, n_nationkey + unnest([0, 3]) AS y0, n_nationkey * 400 - 1000 + unnest([200, 500]) AS x1, n_nationkey + unnest([3, -2]) AS y1 FROM nation),
p AS (SELECT c_custkey AS pid, c_acctbal AS x, c_nationkey * 1.3::DOUBLE AS y FROM customer),
t AS (SELECT pid, x, y, lid, seg, x0, y0, x1, y1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) AS t FROM p, s),
d AS (SELECT pid, lid, seg, sqrt(pow(x0 + t * (x1 - x0) - x, 2) + pow(y0 + t * (y1 - y0) - y, 2)) AS d, t FROM t)
SELECT pid, lid, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, lid, seg) AS n FROM d) WHERE n = 1""")
def nearest_lines(spark, sf_dir):
    """The nearest of all two-legged lines for each customer."""
    n = F.col("n_nationkey")
    path = F.array(*[corner(n * 400 - 1000 + dx, n + dy) for dx, dy in ((0, 0), (200, 3), (500, -2))])
    lines = table(spark, sf_dir, "nation").select(n.alias("lid"), path.alias("path"))
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 1.3).alias("y"))
    return rounded(polylines.nearest_places(points, lines).select("pid", "lid", "distance"))


@query("""
WITH o AS (SELECT c_nationkey AS scene, c_custkey AS token, c_acctbal / 30 - 2 AS x0, c_acctbal / 30 + 2 AS x1, c_custkey % 37 - 17.01 AS y0, c_custkey % 37 - 13.01 AS y1 FROM customer)
SELECT scene, 0 AS lateral, 0 AS step, token FROM o
WHERE (x0 <= 200 AND x1 >= -2 AND y0 <= 12 AND y1 >= -12) OR (x0 <= 212 AND x1 >= 188 AND y0 <= 37 AND y1 >= 0)
  OR pow(greatest(x0 - 200, 200 - x1, 0.0::DOUBLE), 2) + pow(greatest(y0, -y1, 0.0::DOUBLE), 2) <= 144""")
def corridor_objects(spark, sf_dir):
    """Customers as boxes in the bent corridor of their nation."""
    path = F.array(*[corner(F.lit(x), F.lit(y)) for x, y in ((0, 0), (200, 0), (200, 90))])
    paths = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scene"), F.lit(0).alias("lateral"), path.alias("path"), F.lit(10.0).alias("begin"), F.lit(225.0).alias("end"))
    x, y = F.col("c_acctbal") / 30, F.col("c_custkey") % 37 - 15.01
    box = F.array(*[corner(x + dx, y + dy) for dx, dy in ((-2, -2), (2, -2), (2, 2), (-2, 2))])
    objects = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene"), F.lit(0).alias("step"), F.col("c_custkey").alias("token"), F.array(box).alias("rings"))
    return corridors.intersecting_objects(corridors.corridors(paths, 12.0), objects)


@query("""
SELECT scene, type, round(distance, 6) AS distance FROM (
  SELECT l_suppkey AS scene, l_returnflag AS type, sqrt(pow(l_quantity - 25, 2) + pow(l_extendedprice / 1000 - 30, 2)) AS distance,
    row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY sqrt(pow(l_quantity - 25, 2) + pow(l_extendedprice / 1000 - 30, 2))) AS n FROM lineitem)
WHERE n <= CASE type WHEN 'A' THEN 3 WHEN 'R' THEN 5 ELSE 2 END""")
def nearest_by_scene(spark, sf_dir):
    """Line items as objects of their supplier's scene: the nearest of each type."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scene"), F.col("l_returnflag").alias("type"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(spatial.nearest(rows, 25.0, 30.0, {"A": 3, "R": 5, "N": 2}, by=["scene"]).select("scene", "type", "distance"))


@query("""
WITH c AS (SELECT l_orderkey AS scene, l_suppkey % 3 AS proposal, l_linenumber AS step, CASE WHEN l_partkey % 5 = 0 THEN 'red_light_' ELSE 'track_' END || l_partkey % 4 AS track, l_partkey % 2 = 0 AS agent,
             l_returnflag = 'R' OR (l_returnflag = 'A' AND l_quantity > 25) AS fault FROM lineitem),
f AS (SELECT *, min(CASE WHEN NOT fault THEN step END) OVER (PARTITION BY scene, proposal, track) AS passed FROM c WHERE track NOT LIKE 'red_light%' AND NOT (track = 'track_3' AND scene % 2 = 0) AND step < 5),
h AS (SELECT scene, proposal, min(CASE WHEN agent THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) AS score, min(step) AS first FROM f WHERE fault AND (passed IS NULL OR step < passed) GROUP BY 1, 2)
SELECT scene, proposal, coalesce(score, 1.0::DOUBLE) AS score, first FROM (SELECT DISTINCT scene, proposal FROM c) LEFT JOIN h USING (scene, proposal)""")
def considered_collisions(spark, sf_dir):
    """Collisions without red lights, without a track that stood in the vehicle's way before the start, over four states."""
    lines = table(spark, sf_dir, "lineitem")
    scene, proposal, step = F.col("l_orderkey").alias("scene"), (F.col("l_suppkey") % 3).alias("proposal"), F.col("l_linenumber").alias("step")
    track = F.concat(F.when(F.col("l_partkey") % 5 == 0, "red_light_").otherwise("track_"), (F.col("l_partkey") % 4).cast("string"))
    kind = F.when((F.col("l_returnflag") == "R") | ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25)), "active_front").otherwise("active_rear")
    met = lines.select(scene, proposal, step, track.alias("track"), kind.alias("kind"), (F.col("l_partkey") % 2 == 0).alias("agent"))
    areas = met.select("scene", "proposal", "step").distinct().withColumns({"multiple_lanes": F.lit(False), "off_road": F.lit(False)})
    before = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("scene"), F.lit("track_3").alias("track"))
    return scorer.no_fault(met, areas, met, before, 5)
