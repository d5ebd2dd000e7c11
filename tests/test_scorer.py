"""The scorer's geometry and folds by hand; its queries are held against SQL in test_entry."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from rollgrid.operators import kernels, scorer

RING = "array<struct<x:double,y:double>>"


def box(x, y, heading=0.0, length=4.0, width=2.0):
    c, s = np.cos(heading), np.sin(heading)
    return [(float(x + c * a - s * b), float(y + s * a + c * b)) for a, b in ((length / 2, width / 2), (-length / 2, width / 2), (-length / 2, -width / 2), (length / 2, -width / 2))]


def plain_meet(a, b):
    """Two boxes share a point if corners lie inside the other or edges cross, on a fine grid of their outlines."""
    inside = lambda p, ring: all((q[0] - r[0]) * (p[1] - r[1]) - (q[1] - r[1]) * (p[0] - r[0]) <= 0 for r, q in zip(ring, ring[1:] + ring[:1])) or all((q[0] - r[0]) * (p[1] - r[1]) - (q[1] - r[1]) * (p[0] - r[0]) >= 0 for r, q in zip(ring, ring[1:] + ring[:1]))
    line = lambda ring: [(p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])) for p, q in zip(ring, ring[1:] + ring[:1]) for t in np.linspace(0, 1, 200)]
    return any(inside(p, b) for p in line(a)) or any(inside(p, a) for p in line(b))


def test_boxes_meet(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, box(0, 0, rng.uniform(-3, 3)), box(rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(-3, 3))) for i in range(150)]
    got = {r.i: r.m for r in spark.createDataFrame(pairs, f"i int, a {RING}, b {RING}").select("i", scorer.meet(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {i: plain_meet(a, b) for i, a, b in pairs} and 30 < sum(got.values()) < 120


def test_contacts_are_those_of_the_step(spark):
    boxes = [("s", p, t, box(10.0 * t, 3.0 * p)) for p, t in itertools.product(range(3), range(4))]
    objects = [("s", t, f"o{t}", box(20.0, 3.0, 0.7)) for t in range(4)] + [("z", 2, "other", box(20.0, 3.0))]
    got = scorer.contacts(spark.createDataFrame(boxes, f"scene string, proposal int, step int, ring {RING}"), spark.createDataFrame(objects, f"scene string, step int, track string, ring {RING}"))
    want = {(p, t, f"o{t}") for _, p, t, ring in boxes for s, u, _, other in objects if s == "s" and u == t and plain_meet(ring, other)}
    assert {(r.proposal, r.step, r.track) for r in got.collect()} == want and want


def test_tracks_without_fault_are_passed_over(spark):
    met = [("s", 0, 1, "a", "active_rear", True), ("s", 0, 2, "a", "active_front", True), ("s", 0, 3, "b", "active_lateral", False), ("s", 1, 2, "a", "stopped_track", True), ("s", 2, 1, "c", "stopped_ego", True)]
    areas = [("s", p, t, t == 3, False, False, False) for p in range(4) for t in range(1, 4)]
    met = spark.createDataFrame(met, "scene string, proposal int, step int, track string, kind string, agent boolean")
    areas = spark.createDataFrame(areas, "scene string, proposal int, step int, multiple_lanes boolean, off_road boolean, oncoming boolean, crossing boolean")
    got = {r.proposal: (r.score, r.first) for r in scorer.no_fault(met, areas, areas).collect()}
    assert got == {0: (0.5, 3), 1: (0.0, 2), 2: (1.0, None), 3: (1.0, None)}


def test_progress_along_a_line(spark):
    rows = [("s", 0, [(0.0, 0.0), (10.0, 0.0)], 1.0, 1.0, 7.0, -1.0), ("s", 1, [(0.0, 0.0), (10.0, 0.0)], 7.0, 0.0, 2.0, 0.0)]
    got = scorer.progress(spark.createDataFrame(rows, f"scene string, proposal int, line {RING}, x0 double, y0 double, x1 double, y1 double")).collect()
    assert [(r.proposal, r.progress) for r in got] == [(0, 6.0), (1, 0.0)]


def test_past_states_come_first(spark):
    states = spark.createDataFrame([("s", 0, [[3.0], [4.0]]), ("s", 1, [[3.0]]), ("t", 0, [[1.0]])], "scene string, proposal int, states array<array<double>>")
    past = spark.createDataFrame([("s", [[1.0], [2.0], [3.0]])], "scene string, states array<array<double>>")
    got = {(r.scene, r.proposal): [x[0] for x in r.states] for r in scorer.with_history(states, past).collect()}
    assert got == {("s", 0): [1, 2, 3, 4], ("s", 1): [1, 2, 3], ("t", 0): [1]}


def test_tracker_state_and_reference():
    states, reference = np.zeros((2, 11)), np.zeros((2, 11))
    states[:, kernels.X], states[:, kernels.VX], states[:, kernels.STEER] = [1.0, 2.0], [5.0, 6.0], 0.1
    states[:, kernels.HEADING], reference[:, kernels.HEADING] = [0.0, 3.0], [np.pi / 2, -3.0]
    speeds, errors = kernels.lateral_state(states, reference)
    assert speeds.tolist() == [5.0, 6.0]
    assert np.allclose(errors, [[-1.0, -np.pi / 2, 0.1], [2 * np.sin(3.0), 6 - 2 * np.pi, 0.1]])
    v, k = np.arange(10.0)[None], np.arange(10.0)[None] / 10
    assert kernels.looked_ahead(v, k, 2, 3)[0].tolist() == [5.0] and np.allclose(kernels.looked_ahead(v, k, 2, 3)[1], [[0.2, 0.3, 0.4]])
    assert kernels.looked_ahead(v, k, 8, 4)[0].tolist() == [9.0] and np.allclose(kernels.looked_ahead(v, k, 8, 4)[1], [[0.8, 0.9, 0.9, 0.9]])
    accel, steer = kernels.stopping_command(np.array([1.0]), np.array([0.0]), gain=0.5)
    assert accel.tolist() == [-0.5] and steer.tolist() == [0.0]


def test_red_lights_and_earlier_tracks_are_no_collisions(spark):
    """And states from a step on do not count; the rear axle decides on intersections for the time to collision."""
    rows = [("s", 0, 1, "red_light_3", "active_front", True), ("s", 1, 1, "old", "active_front", True), ("s", 2, 9, "car", "active_front", True), ("s", 3, 1, "cone", "active_front", False)]
    met = spark.createDataFrame(rows, "scene string, proposal int, step int, track string, kind string, agent boolean")
    areas = met.select("scene", "proposal", "step").withColumns({"multiple_lanes": F.lit(False), "off_road": F.lit(False), "crossing": F.lit(True), "axle_crossing": F.lit(False)})
    before = spark.createDataFrame([("s", "old"), ("z", "car")], "scene string, track string")
    score = lambda **more: {r.proposal: r.score for r in scorer.no_fault(met, areas, met, **more).collect()}
    assert score() == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.5}
    assert score(collided=before, steps=9) == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.5}
    near = met.withColumns({"later": F.lit(0), "speed": F.lit(2.0), "ahead": F.col("proposal") < 3, "behind": F.lit(False)})
    ttc = lambda areas, **more: {r.proposal: r.score for r in scorer.time_to_collision(near, areas, met, **more).collect()}
    assert ttc(areas, collided=before) == {0: 1.0, 1: 1.0, 2: 0.0, 3: 1.0}
    assert ttc(areas.drop("axle_crossing"), steps=9) == {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.0}


def test_rear_axle_in_an_intersection(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    polygons = spark.createDataFrame([(1, "INTERSECTION", False, square)], f"gid int, kind string, on_route boolean, ring {RING}")
    corners = [(14.0, 6.0), (8.0, 6.0), (8.0, 4.0), (14.0, 4.0), (11.0, 5.0), (9.0, 5.0)]
    points = spark.createDataFrame([("s", 0, 0, i, x, y) for i, (x, y) in enumerate(corners)], "scene string, proposal int, step int, corner int, x double, y double")
    r = scorer.ego_areas(points, polygons, axle=True).first()
    assert (r.crossing, r.axle_crossing, r.off_road) == (False, True, True)
    assert scorer.ego_areas(points, polygons).columns == ["scene", "proposal", "step", "multiple_lanes", "off_road", "oncoming", "crossing"]
