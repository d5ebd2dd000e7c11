import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollgrid.functions import geometry as G
from rollgrid.functions import registry
from rollgrid.functions import text as T
from rollgrid.operators import batch as B
from rollgrid.operators import graph, kernels, scenes, spatial


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame([(i, i + 1, c) for i, c in enumerate("abcdef")], "pos long, obs long, labels string")


def obs(df):
    return [r.obs for r in df.orderBy("pos").collect()]


def test_batch_algebra(letters):
    assert obs(B.sliced(letters, 1, 6, 2)) == [2, 4, 6]
    assert obs(B.repeated(letters, 2))[:4] == [1, 1, 2, 2] and obs(B.repeated(letters, 2, interleave=False))[5:8] == [6, 1, 2]
    padded, n = B.padded(letters, 4)
    assert n == 2 and obs(padded) == [1, 2, 3, 4, 5, 6, 1, 2] and obs(B.unpadded(padded, n)) == [1, 2, 3, 4, 5, 6]
    many, n = B.padded(letters.where("pos < 2"), 7)
    assert n == 5 and obs(many) == [1, 2, 1, 2, 1, 2, 1]
    assert obs(B.concatenated(letters, letters.drop("labels")))[6:] == [1, 2, 3, 4, 5, 6]
    assert [r.chunk for r in B.chunked(letters, 3).orderBy("pos").collect()] == [0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        B.chunked(letters, 4)
    assert [len(r.rows) for r in B.folded(letters, 2).collect()] == [3, 3]
    assert B.selected(letters, ["obs", "nothing"]).columns == ["obs"]
    one, rest = B.popped(letters, ["labels"])
    assert one.columns == ["pos", "labels"] and rest.columns == ["pos", "obs"]
    with pytest.raises(ValueError):
        B.renamed(letters, ["obs"], [])


def test_gather_and_zip(spark, letters):
    index = spark.createDataFrame([(0, 5), (1, 0), (2, 5)], "pos long, at long")
    assert obs(B.taken(letters, index)) == [6, 1, 6]
    assert B.zipped(letters, letters.select("pos", "obs", (F.col("obs") * 2).alias("twice"))).where("twice = 2 * obs").count() == 6
    with pytest.raises(Exception, match="differs"):
        B.zipped(letters, letters.select("pos", (F.col("obs") + 1).alias("obs"))).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=40), st.integers(1, 6), st.booleans())
def test_partitions_hold_every_index_once(lengths, parts, equal):
    if equal:
        lengths = lengths[: len(lengths) // parts * parts]
        if not lengths:
            return
    for deal in (B.largest_differencing, B.greedy_parts):
        got = deal(lengths, parts, equal)
        assert sorted(i for p in got for i in p) == list(range(len(lengths))) and len(got) == parts
        assert not equal or len({len(p) for p in got}) == 1


def test_micro_batches_and_balance(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i // 20, i % 20, int(x)) for i, x in enumerate(rng.integers(1, 100, 40))], "batch int, pos long, n int")
    micro = B.micro_batches(df, "batch", "n", 300)
    sums = micro.groupBy("batch", "micro").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("heavy")).orderBy("batch", "micro").collect()
    assert all(r.total <= 340 for r in sums)
    for b in (0, 1):
        heavy = [r.heavy for r in sums if r.batch == b]
        assert heavy == sorted(heavy, reverse=True)
    spread = B.part_sums(B.balanced(df, "batch", "n", 4).where("batch = 0"), "part", "n").first()
    assert spread["max"] - spread["min"] <= 40


def test_mini_batches_and_accumulation(spark, letters):
    got = B.mini_batches(letters, 4, epochs=2, seed=3)
    assert got.count() == 12 and got.groupBy("epoch", "pos").count().where("count > 1").count() == 0
    g = spark.createDataFrame([(1, 2), (2, 0), (3, 5), (4, 4)], "step int, kept int")
    assert [(r.step, r.used) for r in B.accumulated(g, "step", "kept", 4, 9).orderBy("step").collect()] == [(1, 2), (2, 0), (3, 2)]


def frames(spark, n=9):
    return spark.createDataFrame([("log", i, f"t{i}", ["r"] if i % 2 else [], 0.5 * i, float(i * i)) for i in range(n)], "log_name string, idx int, token string, route array<string>, start_time double, value double")


def test_frame_windows(spark):
    w = scenes.FrameWindow(2, 1, hop=2)
    got = scenes.hopping_windows(frames(spark), w, columns=("token", "route"))
    assert [[f.token for f in r.frames] for r in got.orderBy("idx").collect()] == [["t0", "t1", "t2"], ["t2", "t3", "t4"], ["t4", "t5", "t6"], ["t6", "t7", "t8"]]
    assert scenes.valid_scenes(got, w, route="route", tokens=spark.createDataFrame([("t3",)], "token string")).count() == 1
    with pytest.raises(ValueError):
        scenes.FrameWindow(0, 1)
    scene = spark.createDataFrame([("s", i, f"t{i}") for i in range(5)] + [("short", i, "x") for i in range(4)], "scene_token string, frame_idx int, token string")
    assert sorted(r.frames for r in scenes.two_windows(scene).collect()) == [["t0", "t1", "t2", "t3"], ["t1", "t2", "t3", "t4"]]


def test_adjacency_and_resampling(spark):
    f = frames(spark)
    assert scenes.adjacent(f).count() == 8 and scenes.adjacent(f, gap=0.4).count() == 0
    got = {r.at: r.value for r in scenes.resampled(f.where("idx % 2 = 0"), "log_name", "start_time", "value", 1).collect()}
    assert got[1] == 4.0 and got[3] == 36.0
    holes = f.withColumn("value", F.when(F.col("idx") % 3 == 0, F.col("value")))
    assert [r.value for r in scenes.forward_filled(holes, "log_name", ["idx"], "value").orderBy("idx").collect()][:5] == [0, 0, 0, 9, 9]
    turns = f.withColumn("value", (F.col("idx") * 1.5) % (2 * math.pi))
    assert [r.value for r in scenes.unwrapped(turns, "log_name", ["idx"], "value").orderBy("idx").collect()] == pytest.approx([1.5 * i for i in range(9)])


def test_weights_updates_and_stages(spark):
    pairs = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("far", 99.0), ("far", 98.0), ("nan", float("nan")), ("nan", 1.0)], "key string, d double")
    w = {}
    for r in scenes.kernel_weights(pairs, "key", "d").collect():
        w.setdefault(r.key, []).append(r.weight)
    assert sum(w["a"]) == pytest.approx(1) and max(w["a"]) == pytest.approx(1 / (1 + math.exp(-1.25))) and w["far"] == w["nan"] == [0.5, 0.5]
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "token string, score double")
    change = spark.createDataFrame([("a", 9.0), ("b", float("nan")), ("c", None)], "token string, score double")
    assert [r.score for r in scenes.updated(base, change, "token").orderBy("token").collect()] == [9, 2, 3]
    p = spark.createDataFrame([("t", 4.0, 1.0), ("u", 10.0, 1.0), ("u", 8.0, 0.0), ("u", 5.0, 1.0)], "token string, progress double, gate double")
    assert sorted(r.progress_score for r in scenes.normalised_progress(p).collect()) == [0.5, 0.8, 1.0, 1.0]


def test_two_stage_scores(spark):
    first = spark.createDataFrame([("n", 0.8), ("p", 0.5)], "token string, score double")
    second = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.5, 3.0), ("c", 0.4, 1.0)], "token string, score double, weight double")
    mapping = spark.createDataFrame([("n", "p", [("a", "c"), ("b", "c")])], "now string, prev string, pairs array<struct<now:string,prev:string>>")
    assert scenes.two_stage_scores(first, second, mapping).first().score == pytest.approx((0.8 * 0.625 + 0.5 * 0.4) / 2)


def test_text_parsing(spark):
    points = ", ".join(f"({i}.5, -{i}, .1)" for i in range(9))
    df = spark.createDataFrame([(f'"future_trajectory": [(0,0,0)] later "future_trajectory": [{points}]',), ("nothing",)], "t string")
    got = df.select(T.tagged_trajectory(F.col("t")).alias("a"), T.triples(F.col("t")).alias("b")).collect()
    assert len(got[0].a) == 8 and got[0].a[2].x == 2.5 and got[0].a[2].y == -2 and len(got[0].b) == 10 and got[1].a is None and got[1].b == []
    j = spark.createDataFrame([('```json\n{"explanation": "e", "trajectory": "(1,2,3)"}\n```',), ("{bad",)], "t string")
    got = [r.p for r in j.select(T.json_trajectory(F.col("t")).alias("p")).collect()]
    assert got[0].parsed_ok and got[0].trajectory[0].yaw == 3 and not got[1].parsed_ok
    d = spark.createDataFrame([("<action_3> and <action_12>", "<PLANNING>[1, 2]</PLANNING> [3, 4]")], "a string, p string")
    r = d.select(T.action_ids(F.col("a")).alias("a"), T.planned_pairs(F.col("p"), 1).alias("p"), T.planned_pairs(F.col("p"), 2).alias("q")).first()
    assert r.a == [3, 12] and r.p[0].y == 2 and r.q is None


def test_answers_and_formats(spark):
    cases = [("so Answer: 1,234", "1234", 1), ("Answer: 3\nAnswer: \\boxed{x}", "x", 1), ("Answer: 12 dollars", "12", 1), ("no", "1", -1), ("Answer: \\frac12", "\\frac{1}{2}", 1)]
    df = spark.createDataFrame(cases, "response string, truth string, want int")
    assert df.where(T.answer_reward(F.col("response"), F.col("truth")) != F.col("want")).count() == 0
    f = spark.createDataFrame([("<think>a\nb</think> so \\boxed{3}", "<think>x</think><answer> 7 </answer>"), ("\\boxed{3}", "7")], "a string, b string")
    got = f.select(T.boxed_format(F.col("a")).alias("a"), T.tagged_format(F.col("b")).alias("b"), T.tagged_answer(F.col("b")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, "7"), (0.0, 0.0, "7")]
    c = spark.createDataFrame([(" 2 ",), ("maybe 9 or 1",), ("none",)], "t string")
    assert [r.d for r in c.select(T.choice_digit(F.col("t")).alias("d")).collect()] == ["2", "1", None]
    s = spark.createDataFrame([(1.234,), (-0.001,), (-2.5,)], "x double")
    assert [r.s for r in s.select(T.signed(F.col("x")).alias("s")).collect()] == ["+1.23", "0.0", "-2.50"]


def test_chat_rows(spark):
    chat = spark.createDataFrame([([("human", "a"), ("gpt", "b"), ("human", "c")], "x<image>y<video>")], "c array<struct<`from`:string,value:string>>, p string")
    r = chat.select(T.last_turn(F.col("c"), "human").alias("h"), T.last_turn(F.col("c"), "gpt").alias("g"), T.content_parts(F.col("p")).alias("p")).first()
    assert (r.h, r.g) == ("c", "b") and [(x.type, x.text) for x in r.p] == [("text", "x"), ("image", None), ("text", "y"), ("video", None)]


def test_geometry_round_trips(spark):
    df = spark.createDataFrame([((1.0, 2.0, 0.7), [(3.0, 4.0, 1.0), (-1.0, 0.0, -3.0)])], "o struct<x:double,y:double,heading:double>, p array<struct<x:double,y:double,heading:double>>")
    back = df.select(G.to_global(G.to_relative(F.col("p"), F.col("o")), F.col("o")).alias("q"), "p").first()
    assert all(a.x == pytest.approx(b.x) and a.y == pytest.approx(b.y) and a.heading == pytest.approx(b.heading) for a, b in zip(back.q, back.p))
    moves = spark.createDataFrame([([(1.0, 0.0, math.pi / 2), (1.0, 0.0, 0.0)],)], "d array<struct<x:double,y:double,heading:double>>")
    end = moves.select(G.composed(F.col("d")).alias("c")).first().c[-1]
    assert (end.x, end.y) == (pytest.approx(1), pytest.approx(1))
    a = spark.createDataFrame([(math.pi,), (-math.pi,), (3 * math.pi / 2,), (7.0,)], "a double")
    got = a.select(G.wrapped_modulo(F.col("a")).alias("m"), G.wrapped_loop(F.col("a")).alias("l")).collect()
    assert got[0].m == pytest.approx(-math.pi) and got[0].l == math.pi and got[1].l == -math.pi and got[2].l == pytest.approx(-math.pi / 2)
    box = spark.createDataFrame([((0.0, 0.0, 0.0),)], "p struct<x:double,y:double,heading:double>").select(G.corners(F.col("p"), 4.0, 2.0, 1.0).alias("c")).first().c
    assert [(c.x, c.y) for c in box] == [(3, 1), (-1, 1), (-1, -1), (3, -1), (1, 0)]


def test_spatial_joins(spark):
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 25.0, 3.0), (2, -5.0, -5.0), (3, 99.0, 99.0)], "pid int, x double, y double")
    polygons = spark.createDataFrame([("a", ring(0.0, 0.0, 30.0)), ("b", ring(-10.0, -10.0, 12.0))], "gid string, ring array<struct<x:double,y:double>>")
    assert sorted((r.pid, r.gid) for r in spatial.points_in_polygons(points, polygons).collect()) == [(0, "a"), (0, "b"), (1, "a"), (2, "b")]
    boxes = spark.createDataFrame([("p", 0.0, 25.0, 0.0, 1.0), ("q", 24.0, 60.0, 0.5, 2.0), ("r", 70.0, 71.0, 0.0, 1.0)], "id string, x0 double, x1 double, y0 double, y1 double")
    assert sorted((r.aid, r.bid) for r in spatial.boxes_overlapping(boxes, boxes).where("aid < bid").collect()) == [("p", "q")]
    assert spatial.in_box(points.withColumn("z", F.lit(0.0)), (0, 30), (0, 30), (-1, 1)).count() == 2


def test_padded_agents_and_preference(spark):
    agents = spark.createDataFrame([("s", 2.0, 1.0), ("s", 1.0, 2.0)], "scene string, distance double, x double").withColumns({c: F.lit(0.0) for c in ("y", "heading", "length", "width")})
    got = spatial.padded_agents(agents, "scene", 3).first().agents
    assert [a.valid for a in got] == [True, True, False] and got[0].x == 2.0
    lanes = spark.createDataFrame([("k", "a", False, True, 0.0, 1.0), ("k", "b", True, True, 0.9, 9.0), ("k", "c", True, True, 0.2, 9.0)], "key string, lane string, on_route boolean, contains boolean, heading_error double, distance double")
    assert graph.nearest_lane(lanes, "key").first().lane == "c"


def test_graph_searches(spark):
    e = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "a", "c", 5.0), ("g", "c", "a", 1.0), ("g", "x", "y", 1.0)], "graph string, src string, dst string, cost double")
    q = spark.createDataFrame([("g", "a", "c"), ("g", "a", "y")], "graph string, src string, dst string")
    got = {r.dst: r for r in graph.shortest_paths(e, q).collect()}
    assert got["c"].path == ["a", "b", "c"] and got["c"].cost == 2.0 and got["c"].found and not got["y"].found and got["y"].path == ["a", "b", "c"]
    reached = graph.reached(e, spark.createDataFrame([("a",)], "node string"), 3)
    assert {(r.node, r.depth) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {r.node for r in graph.reached(e, spark.createDataFrame([("c",)], "node string"), 1, backward=True).collect()} == {"a", "b", "c"}
    routes = spark.createDataFrame([("r", ["a", "b", "c", "d"])], "route string, ids array<string>")
    cut = graph.without_loops(routes, spark.createDataFrame([("r", "a", "c")], "route string, a string, b string"))
    assert cut.first().ids == ["a", "b"]


def test_smoothing_reproduces_polynomials():
    t = np.arange(40) * 0.1
    y = 3 - 2 * t + 0.5 * t * t
    assert kernels.smoothed(y, 15, 2) == pytest.approx(y) and kernels.smoothed(y, 15, 2, 1, 0.1) == pytest.approx(-2 + t) and kernels.smoothed(y, 9, 2) == pytest.approx(y)
    between = t[4:-4] + 0.05  # the middle of an even window
    assert kernels.smoothed(y, 8, 2)[4:-4] == pytest.approx(3 - 2 * between + 0.5 * between**2)
    assert kernels.unwrapped(np.array([3.0, -3.0, -2.9])) == pytest.approx([3.0, 2 * np.pi - 3, 2 * np.pi - 2.9])


def plain_filter(y, window, order, derivative, step):
    """The polynomial of each window by numpy's own fit; an even window is one longer ahead, read at its middle."""
    n, half, out = len(y), window // 2, []
    for i in range(n):
        low = 0 if i < half else n - window if i >= n - half else i - (window - 1) // 2
        at = i if i < half or i >= n - half else low + (window - 1) / 2
        fit = np.poly1d(np.polyfit(np.arange(low, low + window) - at, y[low : low + window], order))
        out.append(np.polyder(fit, derivative)(0) / step**derivative if derivative else fit(0))
    return np.array(out)


def test_windows_of_comfort():
    rng = np.random.default_rng(3)
    s = rng.standard_normal((2, 41, 11))
    a, shift = s[1], 1.4
    near = lambda x: pytest.approx(x, abs=1e-7)
    assert kernels.accelerations(s, "magnitude", shift)[1] == near(plain_filter(np.hypot(a[:, 5], a[:, 6]), 8, 2, 0, 0.1))
    x = plain_filter(a[:, 5] - shift * a[:, 9] ** 2, 8, 2, 0, 0.1)
    assert kernels.accelerations(s, "x", shift)[1] == near(x)
    assert kernels.jerks(s, "x", 0.1, shift)[1] == pytest.approx(plain_filter(np.round(x, 8), 15, 2, 1, 0.1), abs=1e-6)
    heading = np.unwrap(a[:, 2])
    assert kernels.yaw_derivative(s, 0.1)[1] == pytest.approx(plain_filter(heading, 5, 2, 1, 0.1), abs=1e-6)
    assert kernels.yaw_derivative(s, 0.1, 2)[1] == pytest.approx(plain_filter(heading, 5, 2, 2, 0.1), abs=1e-5)
    assert kernels.yaw_derivative(s, 0.1, 2, order=3)[1] == pytest.approx(plain_filter(heading, 5, 3, 2, 0.1), abs=1e-5)
    # by hand: a step from 0 to 8 at place 10 enters the window of place 6 (3 to 10) with weight -126 / 1344
    step = np.where(np.arange(20) < 10, 0.0, 8.0)
    got = kernels.smoothed(step, 8, 2)
    assert got[5] == pytest.approx(0) and got[6] == pytest.approx(-0.75) and got[9] == pytest.approx(4)
    with pytest.raises(ValueError):
        kernels.smoothed(np.zeros(2), 8, 2)


def test_far_searches_keep_short_plans(spark):
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 40}") for i in range(40)], "src string, dst string")
    got = graph.reached(ring, spark.createDataFrame([("n0",)], "node string"), 30)
    assert {(r.node, r.depth) for r in got.collect()} == {(f"n{i}", i) for i in range(31)}
    assert len(got._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 80


def test_comfort_and_bicycle(spark):
    still = np.zeros((1, 40, 11))
    assert kernels.comfort(still, 0.1).all() and kernels.frame_to_frame_comfort(still, still, 0.1).all()
    hard = still.copy()
    hard[..., kernels.AX] = -6.0
    assert not kernels.comfort(hard, 0.1)[0, 0] and kernels.comfort(hard, 0.1)[0, 1]
    s = np.zeros((2, 11))
    s[:, kernels.VX] = 10
    for _ in range(10):
        s = kernels.Bicycle().step(s, np.array([0.0, 1.0]), np.array([0.0, 0.0]), 0.1)
    assert s[0, kernels.X] == pytest.approx(10) and s[1, kernels.X] > 10 and s[0, kernels.Y] == 0
    df = spark.createDataFrame([("t", 0, [0.0] * 11, [[0.0, 0.0]] * 20)], "token string, proposal int, start array<double>, commands array<array<double>>")
    path = kernels.simulated(df, "token", "proposal", "start", "commands", 0.1)
    assert len(path.first().states) == 21
    assert kernels.comfort_by_proposal(path, "token", "proposal", "states", 0.1).first().comfortable


def test_profiles_following_and_faults():
    v, a = kernels.velocity_profile(np.tile([1.0, 0.0], (1, 8, 1)), np.zeros((1, 8)), 0.1)
    assert v[0] == pytest.approx(10, abs=0.1) and np.abs(a).max() < 0.1
    k, _ = kernels.curvature_profile(np.full((1, 8), 0.05), np.full((1, 8), 5.0), 0.1)
    assert k[0] == pytest.approx(0.1, abs=0.01)
    free = kernels.follow(0.0, 5.0, np.full(40, 1e6), np.full(40, 10.0), 10.0, 0.1)
    close = kernels.follow(0.0, 5.0, np.full(40, 8.0), np.zeros(40), 10.0, 0.1)
    assert free[-1, 1] > 5 > close[-1, 1] >= 0
    assert kernels.at_fault(0.0, 1.0, True, False) == "stopped_ego" and kernels.at_fault(1.0, 1.0, True, False) == "active_front"
    with pytest.raises(ValueError):
        kernels.overlap(np.zeros((40, 11)), np.zeros((40, 11)), 0.55, 0.1)
    x, y = kernels.overlap(np.zeros((40, 11)), np.zeros((40, 11)), 0.5, 0.1)
    assert x.shape == y.shape == (35, 11)


def double_rows(rows, factor=2):
    return [r["x"] * factor for r in rows]


def test_reward_plugins(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -1.0)], "token string, x double")
    assert [r.y for r in df.select(registry.reward_column(double_rows, "batch", "x", factor=3).alias("y")).collect()] == [3, 6, -3]
    with pytest.raises(ValueError):
        registry.reward_column(double_rows, "other", "x")
    assert registry.loaded("math:sqrt") is math.sqrt

    def scorer(rows):
        if rows[0]["token"] == "b":
            raise RuntimeError("remote scorer is down")
        return [{"token": r["token"], "score": r["x"]} for r in rows]

    for threads in (1, 3):
        got = registry.scored_by_group(df, scorer, "token", "token string, score double", lambda r: {"token": r["token"], "score": 0.0}, threads)
        assert sorted((r.token, r.score) for r in got.collect()) == [("a", 1.0), ("a", 2.0), ("b", 0.0)]
    # groups that cross the batches are scored whole
    count = lambda rows: [{"token": r["token"], "score": float(len(rows))} for r in rows]
    many = spark.range(60).select(F.concat(F.lit("t"), (F.col("id") / 3).cast("int")).alias("token"), F.lit(1.0).alias("x"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for threads in (1, 3):
            got = registry.scored_by_group(many, count, "token", "token string, score double", lambda r: {"token": r["token"], "score": 0.0}, threads)
            assert [r.score for r in got.collect()] == [3.0] * 60
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_steering_and_rails():
    v, k = np.full(10, 5.0), np.zeros(10)
    left = kernels.steering_rate(np.array([1.0, 0.0, 0.0]), v, k, 0.1)
    assert left < 0 and kernels.steering_rate(np.zeros(3), v, k, 0.1) == 0 and kernels.steering_rate(np.zeros(3), v, k + 0.1, 0.1) > 0

    def cost(u, x=np.array([1.0, 0.2, 0.0])):
        total = x.copy()
        for _ in range(10):
            total = np.array([total[0] + 0.5 * total[1], total[1] + 0.5 / 3.089 * total[2], total[2] + 0.1 * u])
        return total[0] ** 2 + 10 * total[1] ** 2 + u * u

    best = kernels.steering_rate(np.array([1.0, 0.2, 0.0]), v, k, 0.1)
    assert cost(best) <= min(cost(best + 0.01), cost(best - 0.01))
    out = kernels.rail_traffic(["a", "a", "b"], np.array([0.0, 20.0, 0.0]), np.full(3, 8.0), [("a", 60.0, 0.0)] * 80, 8.0, 0.1)
    assert out[-1, 2, 0] > 60 > out[-1, 1, 0] > out[-1, 0, 0] and (out[:, :, 1] >= 0).all()


def test_groups_are_scored_without_a_frame_each(spark):
    """Frames hold many groups; missing keys and keys of several batches are one group each, and rows are plain values."""
    rows = [(None if i < 5 else i // 3, i, float(i)) for i in range(400)]
    frames = [pd.DataFrame(rows[k : k + 7], columns=["token", "line", "x"]) for k in range(0, len(rows), 7)]
    found = list(registry._groups(iter(frames), "token"))
    assert [len(g) for g in found] == [5, 1] + [3] * 131 + [1] and type(found[3][0]["line"]) is int
    many = spark.range(3000).select((F.col("id") / 3).cast("long").alias("token"), F.col("id").alias("line"))
    made = spark.sparkContext.accumulator(0)

    def scorer(rows):
        return [{"token": r["token"], "line": r["line"], "score": float(len(rows))} for r in rows]

    def counted(batches):
        for b in batches:
            made.add(1)
            yield b

    for threads in (1, 4):
        got = registry.scored_by_group(many.repartition(1), scorer, "token", "token long, line long, score double", lambda r: {**r, "score": 0.0}, threads)
        before = made.value
        rows = got.mapInArrow(counted, got.schema).collect()
        assert sorted((r.token, r.line, r.score) for r in rows) == [(i // 3, i, 3.0) for i in range(3000)]
        assert made.value - before < 50  # a frame for each group made 1000
