"""Links and repaired routes against a plain search; lanes matched to states against plain loops."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollgrid.operators import graph, matching, polygons, routes


def shortest(edges, starts, ends, most):
    """The smallest of the shortest paths, by plain breadth-first search."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    level, seen = {s: (s,) for s in starts}, set(starts)
    for _ in range(most):
        hits = [p for n, p in level.items() if n in ends]
        if hits:
            return list(min(hits))
        new = {}
        for n, p in level.items():
            for m in after[n]:
                if m not in seen:
                    new[m] = min(new.get(m, (*p, m)), (*p, m))
        seen |= set(new)
        level = new
    return None


def test_links_are_the_shortest_paths(spark):
    rng = random.Random(7)
    edges, starts, ends, want = [], [], [], {}
    for g in range(200):
        n = rng.randint(2, 14)
        own = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
        edges += [(g, a, b) for a, b in own]
        for q in range(3):
            s, e = ([rng.randrange(n) for _ in range(rng.randint(1, 2))] for _ in range(2))
            starts += [(g, q, x) for x in s]
            ends += [(g, q, x) for x in e]
            path = shortest(own, s, e, 5)
            if path:
                want[g, q] = path
    kind = "graph int, query int, node int"
    edges += [(None, 1, 2), (0, None, 1), (0, 1, None)]
    got = routes.links(spark.createDataFrame(edges, "graph int, src int, dst int"), spark.createDataFrame([*starts, (0, 9, None)], kind), spark.createDataFrame(ends, kind), 5)
    assert {(r.graph, r["query"]): r.path for r in got.collect()} == want
    assert len({len(p) for p in want.values()}) == 5


@pytest.fixture(scope="module")
def city(spark):
    chain = [("m", a, b) for a, b in zip("abcdefghij", "bcdefghij")]
    return spark.createDataFrame([*chain, ("m", "x", "d"), ("m", "y", "x"), ("m", "f", "k"), ("m", "k", "c"), ("n", "a", "z")], "graph string, src string, dst string")


def test_routes_are_begun_linked_and_cut(spark, city):
    given = {
        "fine": (["b", "c", "d"], "c", ["c"], ["b", "c", "d"]),
        "missing start": (["d", "e"], "y", ["q", "y"], ["y", "x", "d", "e"]),
        "start past the first block": (["w", "d", "e"], "x", ["x"], ["x", "d", "e"]),
        "gap": (["b", "e", "h"], "b", ["b"], ["b", "c", "d", "e", "f", "g", "h"]),
        "no link": (["e", "a", "b"], "e", ["e"], ["e", "a", "b"]),
        "repeated": (["b", "b", "c"], "b", ["b"], ["b", "b", "c"]),
        "loop": (["c", "d", "e", "f", "k", "c", "d"], "c", ["c"], ["c", "d", "e", "f", "k"]),
        "unreachable start": (["b", "c"], "j", ["j"], ["b", "c"]),
        "empty": ([], "a", ["a"], []),
        "null": (None, "a", ["a"], None),
    }
    kept = {"no start": (["b", "d"], ["b", "c", "d"])}
    rows = [("m", k, v[0]) for k, v in given.items()] + [("m", k, v[0]) for k, v in kept.items()]
    starts = spark.createDataFrame([("m", k, v[1], v[2]) for k, v in given.items()], "graph string, route string, start string, candidates array<string>")
    overlaps = spark.createDataFrame([("m", "c", "c"), ("n", "d", "c")], "graph string, a string, b string")
    got = routes.repaired(spark.createDataFrame(rows, "graph string, route string, ids array<string>"), starts, city, overlaps)
    assert {r.route: r.ids for r in got.collect()} == {k: v[3] for k, v in given.items()} | {k: v[1] for k, v in kept.items()}


def test_depth_bounds_the_searches(spark, city):
    one = spark.createDataFrame([("m", "r", ["a", "e"])], "graph string, route string, ids array<string>")
    at = spark.createDataFrame([("m", "r", "a", ["a"])], "graph string, route string, start string, candidates array<string>")
    ids = lambda n: routes.repaired(one, at, city, forward=n).first().ids
    assert ids(4) == ["a", "e"] and ids(5) == ["a", "b", "c", "d", "e"]
    assert routes.repaired(one.limit(0), at, city).count() == 0


LANES = [(lane, x, y) for lane, x, y in ((1, 0, 0), (2, 40, 0), (3, 40, 6), (4, 80, 0), (5, 80, 6))]
NEXT = [(1, 2), (1, 3), (2, 4), (3, 5)]


def far(lane, x, y):
    _, lx, ly = next(r for r in LANES if r[0] == lane)
    return (max(lx - x, x - lx - 45, 0) ** 2 + max(ly - y, y - ly - 4, 0) ** 2) ** 0.5


def by_loops(states, walk, radius=10.0):
    """Lanes of one agent's (x, y) in turn."""
    near = [(far(lane, *states[0]), lane) for lane, _, _ in LANES]
    near = [p for p in near if p[0] <= radius]
    if not near:
        return []
    first = min(near)[1]
    out = [first]
    for s in states[1:]:
        follow = [b for a, b in NEXT if a == (out[-1] if walk else first)]
        may = [(far(lane, *s), 0, lane) for lane in follow] + [(far(lane, *s), 1, lane) for lane in (out if walk else [first])]
        may = [m for m in may if not walk or m[0] <= radius]
        out.append(min(may)[2] if may else out[-1])
    return out


@pytest.mark.parametrize("walk", [False, True])
def test_lanes_follow_the_states(spark, walk):
    rng = random.Random(3)
    agents = {a: [(rng.uniform(-5, 20) + 13.7 * t, rng.uniform(-2, 12)) for t in range(rng.randint(1, 9))] for a in range(60)}
    agents[60] = [(500.0, 0.0), (1.0, 1.0)]
    agents[61] = [(1.0, 1.0), (500.0, 0.0), (60.0, 8.0)]
    rows = [(s, a, t, x, y) for s in ("s", "t") for a, v in agents.items() for t, (x, y) in enumerate(v)] + [("s", 0, 99, None, 1.0), ("s", 77, 0, float("nan"), 0.0), ("u", 1, 0, 1.0, 1.0)]
    states = spark.createDataFrame(rows, "scene string, agent int, step int, x double, y double")
    ring = lambda x, y: [[(float(x + dx), float(y + dy)) for dx, dy in ((0, 0), (45, 0), (45, 4), (0, 4))]]
    lanes = spark.createDataFrame([(s, lane, ring(x, y)) for s in ("s", "t") for lane, x, y in LANES], "scene string, lane int, rings array<array<struct<x: double, y: double>>>")
    edges = spark.createDataFrame([(s, a, b) for s in ("s", "t") for a, b in NEXT], "scene string, src int, dst int")
    out = (matching.walked if walk else matching.matched)(states, lanes, edges)
    got = {(*r.path_id, ): r.path for r in matching.paths(out).collect()}
    assert got == {(s, a): by_loops(v, walk) for s in ("s", "t") for a, v in agents.items() if by_loops(v, walk)}
    assert any(len(set(p)) > 2 for p in got.values()) == walk or not walk
    poses = spark.createDataFrame([(lane, [(float(x), float(y), 0.0)]) for lane, x, y in LANES], "lane int, poses array<struct<x: double, y: double, heading: double>>")
    line = graph.centreline(matching.paths(out), poses)
    assert {(*r.path_id,): len(r.poses) for r in line.collect()} == {k: len(v) for k, v in got.items()}
    assert out.where(F.col("agent") == 60).count() == 0


def tangle(spark):
    """States, lanes and ways of three scenes with ties, a lane in two parts, lanes that follow themselves and missing ones."""
    rng = random.Random(11)
    corner = lambda: (float(rng.randint(0, 30)), float(rng.randint(0, 30)))
    lanes = [(s, lane, [[corner() for _ in range(rng.randint(1, 6))]]) for s in "abc" for lane in [*range(12), 5]] + [("a", 20, []), (None, 1, [[corner()]]), ("a", None, [[corner()]])]
    ways = [(s, rng.randrange(14), rng.randrange(14)) for s in "abcd" for _ in range(200)] + [("a", 3, 3), ("b", 3, 3), ("a", None, 1), ("a", 1, None)]
    rows = [(s, agent, t, *corner()) for s in "abcd" for agent in range(40) for t in rng.sample(range(50), rng.randint(1, 8))] + [("a", None, 1, 5.0, 5.0), (None, 1, 1, 5.0, 5.0)]
    rows += [(s, agent, 99, 1e200, -1e200) for s in "abc" for agent in range(40)]  # so far that distances overflow
    states = spark.createDataFrame(rows, "scene string, agent int, step int, x double, y double")
    shapes = spark.createDataFrame(lanes, "scene string, lane int, rings array<array<struct<x: double, y: double>>>")
    return states, shapes, spark.createDataFrame(ways, "scene string, src long, dst long")


def test_small_and_large_maps_match_alike(spark, monkeypatch):
    given = tangle(spark)
    small = sorted(tuple(r) for r in matching.matched(*given, radius=4.0).collect())
    monkeypatch.setattr(matching, "LANES", -1)
    large = sorted(tuple(r) for r in matching.matched(*given, radius=4.0).collect())
    assert [r[:4] for r in small] == [r[:4] for r in large] and len(small) > 200 and float("inf") in [r[4] for r in small]
    assert [r[4] for r in small] == pytest.approx([r[4] for r in large], abs=1e-12)
    no_lanes = matching.matched(given[0], given[1].limit(0), given[2])
    monkeypatch.undo()
    assert no_lanes.count() == matching.matched(given[0], given[1].limit(0), given[2]).count() == 0
    monkeypatch.setattr(matching, "PARTS", 200)  # enough for all edges, not for all ways
    assert given[1].selectExpr("sum(size(flatten(rings)))").first()[0] <= matching.PARTS
    assert sorted(tuple(r)[:4] for r in matching.matched(*given, radius=4.0).collect()) == [r[:4] for r in small]


def test_on_a_small_map_states_move_once(spark, tmp_path):
    states, lanes, ways = tangle(spark)
    states.write.parquet(f"{tmp_path}/states")
    out = matching.matched(spark.read.parquet(f"{tmp_path}/states"), lanes, ways)
    execution = out._jdf.queryExecution()
    assert execution.optimizedPlan().toString().count("Relation [scene") == 1
    assert execution.executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_distances_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    e, x, y = rng.uniform(0, 9, (7, 4)), rng.uniform(0, 9, 100), rng.uniform(0, 9, 100)
    whole = polygons.far(e, x, y)
    monkeypatch.setattr(polygons, "PAIRS", 20)
    assert (polygons.far(e, x, y) == whole).all() and len(set(whole)) > 50
