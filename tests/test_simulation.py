import pytest
from pyspark.sql import functions as F

from rollgrid.functions import geometry as G
from rollgrid.functions import text as T
from rollgrid.operators import metrics, simulation


def line(n):
    return [(float(i), 0.0, 0.0) for i in range(n)]


POSES = "array<struct<x:double,y:double,heading:double>>"


def test_paths(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)],)], "p array<struct<x:double,y:double>>")
    p = F.col("p")
    r = df.select(
        G.at_distance(p, F.lit(4.0)).alias("a"), G.at_distance(p, F.lit(99.0)).alias("z"), G.at_distance(p, F.lit(float("nan"))).alias("n"),
        G.projected(p, F.lit(4.0), F.lit(1.0)).alias("s"), G.between_distances(p, F.lit(1.0), F.lit(5.0)).alias("b"),
    ).first()
    assert (r.a.x, r.a.y) == (3, 1) and (r.z.x, r.z.y) == (3, 4) and (r.n.x, r.n.y) == (0, 0) and r.s == 4
    assert [(q.x, q.y) for q in r.b] == [(1, 0), (3, 0), (3, 2)]


def test_completion_and_history(spark):
    df = spark.createDataFrame([(line(3),), (line(1),), (line(9),)], f"p {POSES}")
    got = [r.c for r in df.select(G.completed(F.col("p"), 5, 0.5).alias("c")).collect()]
    assert [q.x for q in got[0]] == pytest.approx([0, 1, 2, 3, 4]) and [q.x for q in got[1]] == [0] * 5 and len(got[2]) == 5
    f = spark.createDataFrame([([((float(i), 1.0, 0.0),) for i in range(6)],)], "f array<struct<pose:struct<x:double,y:double,heading:double>>>")
    r = f.select(G.future(F.col("f"), 2, 3).alias("a"), G.history(F.col("f"), 2).alias("b")).first()
    assert [q.x for q in r.a] == [1, 2, 3] and [q.x for q in r.b] == [-1, 0] and r.a[0].y == 0
    assert G.sampled_indices(10, 2.0, 2, 0.5) == [12, 14] and G.sampled_indices(10, 2.0, 2, 0.5, past=True) == [6, 8]


def test_traffic(spark):
    agents = spark.createDataFrame([("s", "a", 0.0, 0.0, 2.0, 0.0, 0.0, "vehicle"), ("s", "b", 5.0, 0.0, 0.0, 0.0, 0.0, "cone")], "scene string, agent string, x double, y double, vx double, vy double, heading double, type string")
    moved = simulation.constant_velocity(agents, 4, 0.5)
    assert moved.where("agent = 'a' and step = 4").first().x == 4.0
    assert simulation.replayed(moved, agents.where("agent = 'a'")).select("agent").distinct().count() == 1
    assert simulation.mixed_traffic(moved, agents, ["vehicle"]).count() == 6
    gaps = simulation.agent_arrays(moved.where("step <> 1"), 4).where("agent = 'a'").first()
    assert [p.x for p in gaps.poses] == [0, 0, 2, 3] and gaps.seen == [True, False, True, True]
    lights = spark.createDataFrame([(1, "RED"), (2, "GREEN")], "lane int, status string")
    lanes = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "lane int, ring array<double>")
    assert [r.token for r in simulation.red_lights(lights, lanes).collect()] == ["red_light_1"]


def test_proposals_roll_along_their_path(spark):
    scenes = spark.createDataFrame([("s", line(60), None, 5.0)], f"token string, path {POSES}, speed_limit double, speed double")
    each = simulation.proposals(scenes, [-1.0, 0.0, 1.0], [0.5, 1.0], fallback=10.0)
    assert each.count() == 6 and sorted({r.target for r in each.collect()}) == [5.0, 10.0]
    plans = simulation.unrolled(each.withColumns({"lead_gap": F.when(F.col("proposal") == 0, 6.0), "lead_speed": F.when(F.col("proposal") == 0, 0.0)}), "token", 30, 0.1)
    got = {r.proposal: r.poses for r in plans.collect()}
    assert got[0][-1].y == -1 and got[4][-1].y == 1 and got[0][-1].x < 6 < got[2][-1].x < got[3][-1].x
    scored = spark.createDataFrame([("s", 1, 0.5), ("s", 0, 0.5), ("s", 2, 0.1)], "token string, proposal int, score double")
    assert simulation.best_proposal(scored, "token").first().proposal == 0


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0], [0.5, 9.0], [1.0, 9.0], [1, 0], [1.0, 1.0]), ([3.0], [1.0], [1.5], [3.0], [1], [2.0])], "s array<double>, r array<double>, a array<double>, t array<double>, m array<int>, v array<double>")
    r = metrics.data_metrics(df, "s", "r", "a", "t", "m", "v").first()
    assert r.score_mean == 3 and r.a_mean == 1 and r.t_max == 3 and r.explained_variance == pytest.approx(1 - 0.5 / 2.00001)
    assert metrics.average_loss(df, "a", "m").first().loss == pytest.approx(1.0) and metrics.average_loss(df, "a", "m", "seq").first().loss == pytest.approx(1.0)
    assert metrics.masked_moments(df, "a", "m").first().variance == pytest.approx(0.5)
    t = spark.createDataFrame([("gen", 2.0), ("other", 1.0)], "section string, seconds double")
    assert [x.ms_per_token for x in metrics.timing(t, {"gen": 100}).collect()] == [20.0, None]
    big = spark.range(100)
    assert metrics.logged_sample(big, 5, ["id"]).collect() == metrics.logged_sample(big.repartition(3), 5, ["id"]).collect()
    words = spark.createDataFrame([("a b",), ("a b c",)], "t string")
    assert metrics.within_length(words, "t", 2, lambda texts: [len(x.split()) for x in texts]).count() == 1


def test_messages(spark):
    df = spark.createDataFrame([([("human", "hi"), ("human", "see <image>"), ("gpt", "ok"), ("human", "<image> again")], ["i.png"])], "c array<struct<`from`:string,value:string>>, i array<string>")
    m = df.select(T.openai_messages(F.col("c"), F.col("i")).alias("m")).first().m
    assert [x.role for x in m] == ["user", "user", "assistant", "user"] and [x.images for x in m] == [[], ["i.png"], [], []]
    row = df.select(T.prompt_row(F.col("c"), F.col("i"), F.array(F.lit(1))).alias("p")).first().p
    assert row.problem == "<image> again" and row.answer_text == "ok"


def test_failing_scenes_are_marked(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "token string, x int")
    got = simulation.successes(df, lambda r: {"y": 1.0 / r["x"]}, "token", "token string, y double")
    assert got.columns == ["token", "y", "valid"]
    assert sorted((r.token, r.y, r.valid) for r in got.collect()) == [("a", 1.0, True), ("b", None, False)]
