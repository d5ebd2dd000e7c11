"""Regions, lines and corridors against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollgrid.operators import corridors as K
from rollgrid.operators import polygons as P
from rollgrid.operators import polylines as N
from rollgrid.operators import scorer, spatial

RINGS = "array<array<struct<x:double,y:double>>>"


def edges(rings):
    return [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]


def side(e, x, y):
    return (e[2] - e[0]) * (y - e[1]) - (x - e[0]) * (e[3] - e[1])


def on_edge(rings, x, y):
    return any(side(e, x, y) == 0 and min(e[0], e[2]) <= x <= max(e[0], e[2]) and min(e[1], e[3]) <= y <= max(e[1], e[3]) for e in edges(rings))


def odd(rings, x, y):
    return sum((e[1] > y) != (e[3] > y) and x < (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1]) + e[0] for e in edges(rings)) % 2 == 1


def wavy(rng, x, y, size, corners):
    """A ring whose corners lie at different distances around a middle: mostly concave."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + size * rng.uniform(0.2, 1) * math.cos(a), y + size * rng.uniform(0.2, 1) * math.sin(a)) for a in turns]


def plain_crossing(a, b):
    sign = lambda v: (v > 0) - (v < 0)
    boxes = max(a[0], a[2]) >= min(b[0], b[2]) and max(b[0], b[2]) >= min(a[0], a[2]) and max(a[1], a[3]) >= min(b[1], b[3]) and max(b[1], b[3]) >= min(a[1], a[3])
    return boxes and sign(side(a, *b[:2])) * sign(side(a, *b[2:])) <= 0 and sign(side(b, *a[:2])) * sign(side(b, *a[2:])) <= 0


def plain_meets(a, b):
    return any(plain_crossing(s, t) for s in edges(a) for t in edges(b)) or any(odd(b, *e[:2]) for e in edges(a)) or any(odd(a, *e[:2]) for e in edges(b))


def regions(rng, n, holes=True):
    out = []
    for i in range(n):
        x, y, size = rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([1, 3, 10, 40])
        rings = [wavy(rng, x, y, size, rng.randrange(3, 9))]
        if holes and i % 3 == 0:
            rings.append(wavy(rng, x, y, size / 4, 4))
        out.append((i, rings))
    return out


@pytest.mark.parametrize("cells, least", [(10, 4), (10_000, 64)])
def test_points_in_concave_regions(spark, cells, least):
    rng = random.Random(cells)
    held = regions(rng, 60)
    points = [(i, rng.uniform(-5, 105), rng.uniform(-5, 105)) for i in range(400)] + [(400 + i, 50.0, 50.0) for i in range(300)]  # a dense place
    got = P.points_in(spark.createDataFrame(points, "pid int, x double, y double"), spark.createDataFrame(held, f"gid int, rings {RINGS}"), cells=cells, least=least)
    rows = [(r.pid, r.gid) for r in got.collect()]
    assert sorted(rows) == sorted((p, g) for p, x, y in points for g, rings in held if odd(rings, x, y) and not on_edge(rings, x, y)) and len(set(rows)) == len(rows)


def test_regions_that_meet(spark):
    rng = random.Random(4)
    a, b = regions(rng, 80), regions(rng, 80)
    rows = [(r.qid, r.gid) for r in P.met(spark.createDataFrame(a, f"qid int, rings {RINGS}"), spark.createDataFrame(b, f"gid int, rings {RINGS}"), cells=20, least=4).collect()]
    want = [(q, g) for q, x in a for g, y in b if plain_meets(x, y)]
    assert sorted(rows) == sorted(want) and 50 < len(want) < 3000


def test_regions_within_others(spark):
    """Against a sample of points: a region lies in another if no point of it lies outside."""
    rng = random.Random(8)
    outer = regions(rng, 30)
    inner = [(i, [wavy(rng, sum(p[0] for p in outer[i % 30][1][0]) / len(outer[i % 30][1][0]), sum(p[1] for p in outer[i % 30][1][0]) / len(outer[i % 30][1][0]), rng.choice([0.2, 1, 4]), 5)]) for i in range(40)]
    got = {(r.qid, r.gid) for r in P.met(spark.createDataFrame(inner, f"qid int, rings {RINGS}"), spark.createDataFrame(outer, f"gid int, rings {RINGS}"), "within").collect()}
    for i, a in inner:
        x0, x1, y0, y1 = (f(p[k] for p in a[0]) for k in (0, 1) for f in (min, max))
        sample = [(x, y) for x in np.linspace(x0, x1, 15) for y in np.linspace(y0, y1, 15) if odd(a, x, y)]
        for g, b in outer:
            out = sum(not odd(b, x, y) for x, y in sample)
            assert (i, g) not in got or out == 0
            assert (i, g) in got or out > 0 or not sample or any(plain_crossing(s, t) for s in edges(a) for t in edges(b))
    assert got


def test_edges_corners_and_holes(spark):
    square = lambda x, y, s: [(float(x), float(y)), (float(x + s), float(y)), (float(x + s), float(y + s)), (float(x), float(y + s))]
    notched = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    held = spark.createDataFrame([("L", [notched]), ("hole", [square(10, 0, 6), square(12, 2, 2)]), ("none", []), ("null", None), ("hollow", [[]]), ("nan", [[(float("nan"), 0.0), (1.0, 1.0)]])], f"gid string, rings {RINGS}")
    asked = {"notch": square(2, 2, 1), "in": square(0.25, 0.25, 0.5), "corner": square(1, 1, 1), "in the hole": square(12.5, 2.5, 1), "solid": square(10, 0, 1), "over the hole": square(11, 1, 4), "fills the hole": square(12, 2, 2), "same": notched}
    queries = spark.createDataFrame([(k, [v]) for k, v in asked.items()], f"qid string, rings {RINGS}")
    found = {p: {(r.qid, r.gid) for r in P.met(queries, held, p).collect()} for p in ("intersects", "within")}
    assert found["intersects"] == {("in", "L"), ("corner", "L"), ("same", "L"), ("solid", "hole"), ("over the hole", "hole"), ("fills the hole", "hole")}
    assert found["within"] == {("in", "L"), ("same", "L"), ("solid", "hole")}
    points = spark.createDataFrame([(1, 0.0, 2.0), (2, 0.5, 2.0), (3, 13.0, 3.0), (4, 12.0, 3.0), (5, None, 1.0), (6, 11.0, 1.0)], "pid int, x double, y double")
    assert {(r.pid, r.gid) for r in P.points_in(points, held).collect()} == {(2, "L"), (6, "hole")}
    assert {(r.pid, r.gid) for r in P.points_in(points, held, edge=True).collect()} == {(1, "L"), (2, "L"), (4, "hole"), (6, "hole")}
    assert P.points_in(points.limit(0), held).count() == 0 and P.met(queries, held.limit(0)).count() == 0
    kinds = held.withColumn("kind", F.lit("LANE"))
    assert {r.pid: r.in_layer for r in P.in_layer(points, kinds, "LANE").collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert {(r.pid, r.gid, round(r.distance, 6)) for r in P.near(points, held, 1.5).collect()} == {(1, "L", 0.0), (2, "L", 0.0), (3, "hole", 1.0), (4, "hole", 0.0), (6, "hole", 0.0)}


def test_pairs_stay_in_their_group(spark):
    one = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]
    a = spark.createDataFrame([("s", 1, one), ("t", 2, one)], f"scene string, qid int, rings {RINGS}")
    assert {(r.scene, r.qid, r.gid) for r in P.met(a, a.withColumnRenamed("qid", "gid"), by=["scene"]).collect()} == {("s", 1, 1), ("t", 2, 2)}


def test_a_box_in_a_notch_is_no_contact(spark):
    notched = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    rows = spark.createDataFrame([(notched, [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0)]), (notched, [(0.5, 2.0), (3.0, 2.0), (3.0, 3.0)])], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert [r[0] for r in rows.select(scorer.meet(F.col("a"), F.col("b"))).collect()] == [False, True]


def test_drivable_map(spark):
    lane = lambda g, x: (g, [[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0)]])
    rows = [("b", "ROADBLOCK", lane("", 0.0)[1], [lane("b1", 0.0), lane("b2", 500.0)]), ("c", "ROADBLOCK_CONNECTOR", lane("", 5.0)[1], [lane("c1", 5.0)]), ("i", "INTERSECTION", lane("", 9.0)[1], []), ("far", "CARPARK_AREA", lane("", 90.0)[1], []), ("w", "WALKWAY", lane("", 0.0)[1], [])]
    features = spark.createDataFrame(rows, f"gid string, kind string, rings {RINGS}, lanes array<struct<gid:string,rings:{RINGS}>>")
    got = P.drivable_map(spark.createDataFrame([(1, 0.0, 0.0)], "pid int, x double, y double"), features)
    assert {(r.gid, r.kind) for r in got.collect()} == {("b", "ROADBLOCK"), ("b1", "LANE"), ("b2", "LANE"), ("c1", "LANE_CONNECTOR"), ("i", "INTERSECTION")}


# lines


def plain_distance(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    q = dx * dx + dy * dy
    t = min(1, max(0, ((x - a[0]) * dx + (y - a[1]) * dy) / q)) if q else 0
    return math.hypot(a[0] + t * dx - x, a[1] + t * dy - y)


@pytest.mark.parametrize("width", [None, 8.0])
def test_nearest_places(spark, width):
    rng = random.Random(6)
    lines = [(rng.choice("ab"), i, [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.choice([0, 1, 2, 6]))]) for i in range(40)]
    points = [(rng.choice("abc"), i, rng.uniform(-150, 250), rng.uniform(-150, 250)) for i in range(150)] + [("a", 999, None, 1.0)]
    got = N.nearest_places(spark.createDataFrame(points, "scene string, pid int, x double, y double"), spark.createDataFrame(lines, "scene string, lid int, path array<struct<x:double,y:double>>"), ["scene"], width).collect()
    want = {}
    for s, i, x, y in points:
        found = [(plain_distance(x, y, path[k], path[min(k + 1, len(path) - 1)]), l, k) for t, l, path in lines if t == s and x is not None for k in range(max(min(len(path), 1), len(path) - 1))]
        if found:
            want[i] = min(found)
    assert {r.pid: (round(r.distance, 6), r.lid) for r in got} == {i: (round(d, 6), l) for i, (d, l, _) in want.items()}
    for r in got:
        path = next(p for _, l, p in lines if l == r.lid)
        assert math.isclose(r.along, sum(math.dist(p, q) for p, q in zip(path[: r.seg + 1], path[1 : r.seg + 1])) + math.dist(path[r.seg], (r.px, r.py)), abs_tol=1e-6)


def test_starting_lanes(spark):
    strip = lambda y: [[(0.0, y), (20.0, y), (20.0, y + 2), (0.0, y + 2)]]
    line = lambda y, h: [(float(x), y + 1, h) for x in range(0, 21, 5)]
    lanes = [("s", 1, True, strip(0.0), line(0.0, 0.5)), ("s", 2, True, strip(1.0), line(1.0, -0.1)), ("s", 3, False, strip(0.0), line(0.0, 0.0)), ("s", 4, True, strip(30.0), line(30.0, 0.0)), ("s", 5, True, strip(29.0), line(29.0, 0.0)), ("t", 6, True, strip(0.0), line(0.0, 0.0))]
    states = [("s", 1, 5.0, 1.5, 0.0, 5.0, 1.5), ("s", 2, 50.0, 50.0, 0.0, 3.0, 30.5), ("s", 3, 5.0, 20.0, 0.0, 5.0, 20.0), ("t", 4, 5.0, -9.0, 0.0, 5.0, -9.0), ("z", 5, 0.0, 0.0, 0.0, 0.0, 0.0)]
    lanes = spark.createDataFrame(lanes, f"scene string, lane int, on_route boolean, rings {RINGS}, poses array<struct<x:double,y:double,heading:double>>")
    states = spark.createDataFrame(states, "scene string, state int, x double, y double, heading double, cx double, cy double")
    assert {(r.state, r.lane, round(r.heading_error, 6)) for r in N.intersecting_lanes(states, lanes).collect()} == {(1, 1, 0.5), (1, 2, 0.1)}
    assert {(r.state, r.lane, r.on_route) for r in N.starting_lanes(states, lanes).collect()} == {(1, 2, True), (2, 4, False), (3, 5, False), (4, 6, False)}


# corridors


def plain_in_corridor(path, half, x, y):
    """In a rectangle beside a stretch, within the width of an inner point, or in the cap at an end."""
    stretches = list(zip(path, path[1:]))
    for n, (a, b) in enumerate(stretches):
        length = math.dist(a, b)
        u = ((b[0] - a[0]) / length, (b[1] - a[1]) / length)
        along, off = (x - a[0]) * u[0] + (y - a[1]) * u[1], (y - a[1]) * u[0] - (x - a[0]) * u[1]
        low, high = (-half if n == 0 else 0), length + (half if n == len(stretches) - 1 else 0)
        if low <= along <= high and abs(off) <= half:
            return True
    return any(math.dist(p, (x, y)) <= half for p in path[1:-1])


@pytest.mark.parametrize("seed", range(2))
def test_corridors_by_brute_force(spark, seed):
    """Containment and area of bent, repeated and self-crossing paths."""
    rng = random.Random(seed)
    half = 1.5
    path = [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(7)] if seed else [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (2.0, 10.0), (2.0, -6.0), (2.0, 4.0)]
    rows = spark.createDataFrame([(1, path[:3] + path[2:], 0.0, 1e9)], "lateral int, path array<struct<x:double,y:double>>, begin double, end double")
    points = dict(enumerate((float(x), float(y)) for x in np.arange(-3.03, 23, 0.61) for y in np.arange(-9.03, 23, 0.61)))
    regions = K.corridors(rows, half).select(F.col("lateral").alias("gid"), "rings")
    held = P.points_in(spark.createDataFrame([(i, *p) for i, p in points.items()], "pid int, x double, y double"), regions, rule="nonzero", edge=True)
    inside = {r.pid for r in held.collect()}
    got = {i: i in inside for i in points}
    wrong = [p for i, p in points.items() if got[i] != plain_in_corridor(path, half, *p)]
    # an arc of sixteen steps a quarter lies inside the circle by half * (1 - cos(pi / 64)) at most
    assert all(min(math.dist(p, q) for q in path) > half * math.cos(math.pi / 64) - 1e-9 and plain_in_corridor(path, half, *p) for p in wrong) and len(wrong) < 0.01 * len(points) + 2
    assert abs(sum(got.values()) - sum(plain_in_corridor(path, half, *p) for p in points.values())) <= 0.01 * sum(got.values())


def test_objects_in_corridors(spark):
    box = lambda x, y, s=1.0: [[(x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s)]]
    paths = spark.createDataFrame([("s", 0, [(0.0, 0.0), (40.0, 0.0)], 5.0, 25.0), ("s", 1, [(0.0, 10.0), (40.0, 10.0)], 5.0, 25.0), ("s", 2, [(1.0, 1.0)], 0.0, 9.0), ("s", 3, [(1.0, 1.0), (1.0, 1.0)], 0.0, 9.0)], "scene string, lateral int, path array<struct<x:double,y:double>>, begin double, end double")
    found = K.corridors(paths, 1.0)
    assert sorted(r.lateral for r in found.collect()) == [0, 1]
    objects = spark.createDataFrame([("s", 1, "car", box(20.0, 1.5), 20.0, 1.5, 4.0, 0.0), ("s", 1, "near", box(12.0, 0.0), 12.0, 0.0, 2.0, 0.0), ("s", 1, "past", box(5.0, 0.0), 5.0, 0.0, 2.0, 0.0), ("s", 2, "red_light_7", box(18.0, 0.0), 18.0, 0.0, 9.0, 0.0), ("s", 1, "off", box(20.0, 5.0), 20.0, 5.0, 1.0, 0.0), ("t", 1, "other", box(20.0, 0.0), 20.0, 0.0, 1.0, 0.0)], f"scene string, step int, token string, rings {RINGS}, x double, y double, speed double, heading double")
    assert {(r.lateral, r.step, r.token) for r in K.intersecting_objects(found, objects).collect()} == {(0, 1, "car"), (0, 1, "near"), (0, 1, "past"), (0, 2, "red_light_7")}
    vehicles = spark.createDataFrame([("s", p, t, p // 2, box(7.0, 10.0 * (p // 2)), 7.0, 0.0, 40.0) for p in range(3) for t in (1, 2)], f"scene string, proposal int, step int, lateral int, rings {RINGS}, ego_progress double, ego_heading double, path_length double")
    got = K.leading_objects(found, vehicles, objects, spark.createDataFrame([("s", "near")], "scene string, token string"))
    assert {(r.proposal, r.step): (r.token, round(r.lead_progress, 6), r.lead_velocity) for r in got.collect()} == {(p, 1): ("car", 18.0, 4.0) for p in (0, 1)} | {(p, 2): ("red_light_7", 16.0, 0.0) for p in (0, 1)} | {(2, t): (None, 40.0, 0.0) for t in (1, 2)}
    first = K.leading_objects(found, vehicles, objects)
    assert {r.token for r in first.where("step = 1 and proposal < 2").collect()} == {"near"}


def test_bends_of_corridors_are_round(spark):
    """Small boxes just inside the circle of a bend, between the steps of its arc, are met; those just outside are not."""
    path = [(0.0, 0.0), (200.0, 0.0), (200.0, 90.0)]
    found = K.corridors(spark.createDataFrame([("s", 0, path, 10.0, 225.0)], "scene string, lateral int, path array<struct<x:double,y:double>>, begin double, end double"), 12.0)
    box = lambda x, y: [[(x, y), (x + 1, y), (x + 1, y - 1), (x, y - 1)]]
    at = lambda k, r: (200 + r * math.cos(-(k + 0.5) * math.pi / 32), r * math.sin(-(k + 0.5) * math.pi / 32))
    rows = [("s", 0, f"{name}{k}", box(*at(k, r))) for k in range(1, 15) for name, r in (("in", 11.9999), ("out", 12.0001))]
    got = K.intersecting_objects(found, spark.createDataFrame(rows, f"scene string, step int, token string, rings {RINGS}"))
    assert {r.token for r in got.collect()} == {f"in{k}" for k in range(1, 15)}


# nearest objects


def test_nearest_objects_of_each_scene(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.choice(["car", "bike", "cone", "sign"]), rng.choice([0.0, 1.0, 2.0]), rng.uniform(0, 50)) for s in range(3) for i in range(80)] + [(9, 1, "car", 0.0, 0.0), (0, 500, "car", None, 0.0)]
    rows = [(*r, r[2] in ("car", "bike")) for r in rows]
    objects = spark.createDataFrame(rows, "scene int, id int, type string, x double, y double, agent boolean")
    vehicles = spark.createDataFrame([(s, float(s), 10.0 * s) for s in range(3)], "scene int, x double, y double")
    found = spatial.nearest_to_vehicles(objects, vehicles, {"car": 5, "bike": 2}, static=7)
    want = set()
    for s in range(3):
        own = [(math.hypot(r[3] - s, r[4] - 10.0 * s), r[1], r[2]) for r in rows if r[0] == s and r[3] is not None]
        want |= {(s, r[1]) for k, n in (("car", 5), ("bike", 2)) for r in sorted(r for r in own if r[2] == k)[:n]} | {(s, r[1]) for r in sorted(r for r in own if r[2] in ("cone", "sign"))[:7]}
    assert {(r.scene, r.id) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # below the exchange and above it


# grids


def test_no_point_on_an_edge_is_inside(spark):
    ring = [(0.0, 0.0), (30.0, 0.0), (30.0, 20.0), (0.0, 20.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in (-1, 0, 15, 30, 31) for y in (-1, 0, 10, 20, 21))] + [(99, None, 1.0)]
    rings = spark.createDataFrame([("a", ring), ("b", ring[::-1])], "gid string, ring array<struct<x:double,y:double>>")
    got = spatial.points_in_polygons(spark.createDataFrame(points, "pid int, x double, y double"), rings)
    assert sorted((r.pid, r.gid) for r in got.collect()) == [(12, "a"), (12, "b")]


def test_boxes_by_their_middles(spark):
    """Middles as far apart as the boxes are wide, whose edges would round apart."""
    rng = random.Random(4)
    rows = [(i, round(rng.choice([0, 300, 600]) + rng.randint(0, 30) / 100, 2), float(rng.randint(0, 3)), 300.0, 1.0) for i in range(300)]
    boxes = spark.createDataFrame(rows, "id int, x double, y double, width double, height double")
    got = sorted((r.aid, r.bid) for r in spatial.boxes_overlapping(boxes, boxes, 100.0).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if abs(a[1] - b[1]) <= 300 and abs(a[2] - b[2]) <= 1)
    assert got == want and any((a[1] + 150 >= b[1] - 150) != (b[1] - a[1] <= 300) for a in rows for b in rows)


@pytest.mark.parametrize("cell", [0.5, 10.0, 1e4])
def test_boxes_of_all_sizes_meet_once(spark, cell):
    rng = random.Random(5)

    def box(i):
        x, y, w, h = rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice([0, 0.01, 1, 7, 40]), rng.choice([0, 0.5, 3, 25])
        x, y = (round(x), round(y)) if i % 3 else (x, y)
        return (i, float(x), float(x + w), float(y), float(y + h))

    one, two = [box(i) for i in range(150)], [box(i) for i in range(150)] + [(999, None, 1.0, 0.0, 1.0)]
    kind = "id int, x0 double, x1 double, y0 double, y1 double"
    got = spatial.boxes_overlapping(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind), cell).collect()
    want = sorted((a[0], b[0]) for a in one for b in two if b[1] is not None and a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4])
    assert sorted((r.aid, r.bid) for r in got) == want
    assert spatial.boxes_overlapping(spark.createDataFrame([], kind), spark.createDataFrame(two, kind), cell).count() == 0


def test_states_stand_in_one_leaf(spark):
    """Many points beside few regions: none is sent to the leaves of its surroundings, and distances are those of plain loops."""
    rng = random.Random(8)
    rings = {g: [[(x, y), (x + 45.0, y), (x + 45.0, y + 4.0), (x, y + 4.0)]] for g, (x, y) in enumerate((20.0 * i, 7.3 * (i % 2)) for i in range(12))}
    rings[99] = [[(0.0, 0.0), (30.0, 0.0), (0.0, 30.0)], [(5.0, 5.0), (8.0, 5.0), (5.0, 8.0)]]
    points = [(i, rng.uniform(-20, 260), rng.uniform(-20, 30)) for i in range(1500)] + [(9001, 30.0, -10.0), (9002, None, 1.0)]
    regions = spark.createDataFrame(list(rings.items()), f"gid int, rings {RINGS}")
    got = P.near(spark.createDataFrame(points, "pid int, x double, y double"), regions, 10.0)

    def far(r, x, y):
        inside = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for ring in r for a, b in zip(ring, ring[1:] + ring[:1])) % 2
        return 0.0 if inside else min(plain_distance(x, y, a, b) for ring in r for a, b in zip(ring, ring[1:] + ring[:1]))

    want = {(i, g): far(r, x, y) for i, x, y in points if x is not None for g, r in rings.items()}
    assert {(r.pid, r.gid): round(r.distance, 9) for r in got.collect()} == {k: round(d, 9) for k, d in want.items() if d <= 10.0}
    at = P._at(spark.createDataFrame(points, "pid int, x double, y double"))
    tree = P.quad(at, least=4)
    assert len(tree.split) > 100 and P.in_leaves(at, tree, True).count() == 1501
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("leaf(") and plan.count("leaves(")
