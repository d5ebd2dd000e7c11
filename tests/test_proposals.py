"""Proposals scored in one call: scenes made so that each metric is known by hand."""

import numpy as np
import pytest

from rollgrid.operators import kernels, proposals

RING = "array<struct<x:double,y:double>>"
LENGTH, WIDTH, REAR = proposals.VEHICLE
STEPS = 41


def drive(scene, proposal, x=0.0, y=2.0, v=8.0, heading=0.0, turn=0.0):
    rows = []
    for t in range(STEPS):
        state = [0.0] * 11
        h = heading + (turn if t % 2 else 0.0)
        state[kernels.X], state[kernels.Y], state[kernels.HEADING], state[kernels.VX] = x + 0.1 * t * v * np.cos(heading), y + 0.1 * t * v * np.sin(heading), h, v
        rows.append((scene, proposal, t, [float(s) for s in state]))
    return rows


def block(x, y, length=4.0, width=2.0):
    return [(x + a * length / 2, y + b * width / 2) for a, b in ((1, 1), (-1, 1), (-1, -1), (1, -1))]


def standing(scene, track, x, y, speed=0.0, agent=True):
    return [(scene, t, track, block(x + 0.1 * t * speed, y), abs(speed), agent) for t in range(STEPS)]


def region(scene, gid, kind, x0, y0, x1, y1, on_route=True):
    return (scene, gid, kind, on_route, [[(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]])


@pytest.fixture(scope="module")
def results(spark):
    """One scene for each case, all with the same road: two lanes, the upper one against the traffic."""
    cases = {
        "free": (drive("free", 0) + drive("free", 1, v=4.0), []),
        "car ahead": (drive("car ahead", 0), standing("car ahead", "car", 30.0, 2.0)),
        "cone ahead": (drive("cone ahead", 0), standing("cone ahead", "cone", 30.0, 2.0, agent=False)),
        "hit from behind": (drive("hit from behind", 0, x=40.0, v=2.0), standing("hit from behind", "car", 20.0, 2.0, speed=12.0)),
        "standing": (drive("standing", 0, x=40.0, v=0.0), standing("standing", "car", 20.0, 2.0, speed=12.0)),
        "met before": (drive("met before", 0), standing("met before", "old", 30.0, 2.0)),
        "red light": (drive("red light", 0), standing("red light", "red_light_1", 30.0, 2.0)),
        "against": (drive("against", 0, y=6.0), []),
        "a little against": (drive("a little against", 0, y=6.0, v=4.0), []),
        "crossing": (drive("crossing", 0, x=200.0, y=6.0), []),
        "beside": (drive("beside", 0, y=2.6), []),
        "off road": (drive("off road", 0, y=0.5), []),
        "side": (drive("side", 0), standing("side", "car", 2.0, 4.0, speed=8.0)),
        "shaken": (drive("shaken", 0, turn=0.3), []),
    }
    regions = []
    for s in cases:
        regions += [region(s, 1, "LANE", -50, 0, 150, 4), region(s, 2, "LANE", -50, 4, 150, 8, False), region(s, 3, "ROADBLOCK", -50, 0, 150, 8), region(s, 4, "INTERSECTION", 150, 0, 400, 8)]
    states = spark.createDataFrame([r for c in cases.values() for r in c[0]], "scene string, proposal int, step int, state array<double>")
    objects = spark.createDataFrame([r for c in cases.values() for r in c[1]], f"scene string, step int, track string, ring {RING}, speed double, agent boolean")
    maps = spark.createDataFrame(regions, f"scene string, gid int, kind string, on_route boolean, rings array<{RING}>")
    lines = spark.createDataFrame([(s, [(-50.0, 2.0), (400.0, 2.0)]) for s in cases], f"scene string, line {RING}")
    before = spark.createDataFrame([("met before", "old")], "scene string, track string")
    past = [("shaken", [[-0.8 * (20 - t), 2.0, 0.0, 8.0, *[0.0] * 7] for t in range(21)]), ("free", [[-0.8 * (20 - t), 2.0, 0.0, 8.0, *[0.0] * 7] for t in range(21)])]
    past = spark.createDataFrame(past, "scene string, states array<array<double>>")
    out = proposals.scored(states, objects, maps, lines, before, past)
    return {(r.scene, r.proposal): r.asDict() for r in out.collect()}, {r[:2] for c in cases.values() for r in c[0]}


def test_every_proposal_has_one_row(results):
    rows, asked = results
    assert set(rows) == asked


@pytest.mark.parametrize(
    "scene, lost",
    [
        ("car ahead", {"no_fault": 0.0, "ttc": 0.0}), ("cone ahead", {"no_fault": 0.5, "ttc": 0.0}), ("hit from behind", {}), ("standing", {}), ("met before", {}), ("red light", {"lights": 0.0}),
        ("against", {"direction": 0.0, "lane_keeping": 0.0}), ("a little against", {"direction": 0.5, "lane_keeping": 0.0}), ("crossing", {}), ("beside", {"lane_keeping": 0.0}), ("off road", {"on_road": 0.0, "lane_keeping": 0.0}),
        ("side", {}), ("shaken", {"comfort": 0.0}), ("free", {}),
    ],
)
def test_metrics_of_a_scene(results, scene, lost):
    row = results[0][scene, 0]
    names = ("no_fault", "on_road", "direction", "lights", "ttc", "lane_keeping", "comfort")
    assert {n: row[n] for n in names} == {n: lost.get(n, 1.0) for n in names}
    gate = row["no_fault"] * row["on_road"] * row["direction"] * row["lights"]
    assert row["score"] == pytest.approx(gate * (5 * row["progress"] + 5 * row["ttc"] + 2 * row["lane_keeping"] + 2 * row["comfort"]) / 14)


def test_progress_is_compared_in_the_scene(results):
    rows = results[0]
    assert rows["free", 0]["progress"] == 1.0 and rows["free", 1]["progress"] == pytest.approx(0.5)
    assert rows["standing", 0]["progress"] == 1.0
