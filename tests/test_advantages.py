import math

import pytest
from pyspark.sql import functions as F

from rollgrid.functions import arrays as A
from rollgrid.operators import advantages as V


def rewards(spark, values):
    data = [(k, float(x), i) for i, (k, x) in enumerate((k, x) for k, xs in values.items() for x in xs)]
    return spark.createDataFrame(data, "uid string, reward double, pos int")


def values(df):
    return [r.advantages for r in df.orderBy("pos").collect()]


def test_std_floor_damps_only_small_groups(spark):
    df = rewards(spark, {"a": [0, 1], "b": [0.9, 0.901]})
    plain, floor = values(V.advantage(df, "grpo")), values(V.advantage(df, "grpo_std_floor"))
    assert floor[:2] == pytest.approx(plain[:2], abs=1e-5) and abs(floor[2]) < abs(plain[2])
    with pytest.raises(ValueError):
        V.advantage(df, "grpo_std_floor", floor=0)


def test_groups_without_spread_get_nothing(spark):
    for name in ("grpo", "grpo_std_floor", "dr_grpo"):
        assert values(V.advantage(rewards(spark, {"a": [0.5, 0.5], "b": [0.5]}), name)) == [0, 0, 0]


def test_centred(spark):
    got = values(V.advantage(rewards(spark, {"a": [0, 1], "b": [0.90, 0.91], "c": [0.5, 0.5]}), "dr_grpo"))
    assert got == pytest.approx([-0.5, 0.5, -0.005, 0.005, 0, 0])


def test_leave_one_out_and_pass_at_k(spark):
    df = rewards(spark, {"a": [1, 2, 6], "b": [4]})
    assert values(V.advantage(df.where("uid = 'a'"), "rloo")) == pytest.approx([-3, -1.5, 4.5])
    with pytest.raises(Exception, match="more than one"):
        V.advantage(df, "rloo").collect()
    got = values(V.advantage(df, "grpo_passk"))
    assert got[:2] == [0, 0] and got[2] == pytest.approx(4 / (math.sqrt(7) + 1e-6)) and got[3] == 0


def test_unknown_estimator(spark):
    with pytest.raises(NotImplementedError):
        V.advantage(rewards(spark, {"a": [1]}), "none")


def test_token_level_estimators(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1, 1, 0], [0.5, 0.5, 0.5], 1.0)], "token_rewards array<double>, mask array<int>, values array<double>, baseline double")
    r = V.advantage(df, "remax").first()
    assert r.returns == [3.0, 2.0, 0.0] and r.advantages == [5.0, 5.0, 0.0]
    r = V.advantage(df, "reinforce_plus_plus", gamma=0.5).first()
    assert r.returns == [2.0, 2.0, 3.0]  # the masked step gives nothing on
    r = V.advantage(df, "gae").first()
    assert r.returns == pytest.approx([3.0, 2.0, 0.5]) and sum(r.advantages) == pytest.approx(0, abs=1e-6)


def test_divergences_and_controllers(spark):
    df = spark.createDataFrame([(0.5, 0.2)], "p double, q double")
    p, q = F.col("p"), F.col("q")
    got = df.select(*[V.divergence(p, q, k).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")]).first()
    assert got == pytest.approx((0.3, 0.3, 0.045, math.exp(-0.3) + 0.3 - 1))
    with pytest.raises(NotImplementedError):
        V.divergence(p, q, "other")
    c = V.controller("adaptive", 0.1, 1.0, 100)
    assert c.updated(5.0, 10).coefficient == pytest.approx(0.1 * 1.02) and V.controller("fixed", 0.1).updated(9, 9).coefficient == 0.1
    with pytest.raises(ValueError):
        V.controller("other", 1)


def test_losses(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0], [1.0, -1.0], [1, 1])], "old array<double>, new array<double>, adv array<double>, mask array<int>")
    r = V.policy_loss(df, "old", "new", "adv", "mask").first()
    assert r.loss == pytest.approx((-1.3 + 1) / 2) and r.clipped_high == 0.5
    sequence = V.policy_loss(df, "old", "new", "adv", "mask", kind="gspo").first()
    assert sequence.loss == pytest.approx((-1.3 + math.exp(0.5)) / 2) and sequence.kl == pytest.approx(-0.5)
    assert V.policy_loss(df, "old", "new", "adv", "mask", kind="cispo").first().loss == pytest.approx(-1.3 / 2)
    gate = lambda tau, r: 4 / tau / (1 + math.exp(-tau * (r - 1)))
    assert V.policy_loss(df, "old", "new", "adv", "mask", kind="sapo").first().loss == pytest.approx((-gate(1.0, math.e) + gate(1.05, 1)) / 2)
    with pytest.raises(NotImplementedError):
        V.policy_loss(df, "old", "new", "adv", "mask", kind="other")
    followed = spark.createDataFrame([(1, 5.0, 10), (2, 0.0, 10)], "step int, kl double, n int")
    c = V.controller("adaptive", 0.1, 1.0, 100)
    want = [c.updated(5.0, 10).coefficient, c.updated(5.0, 10).updated(0.0, 10).coefficient]
    got = V.followed_controller(followed, "step", "kl", "n", 0.1, 1.0, 100).orderBy("step").collect()
    assert [r.coefficient for r in got] == pytest.approx(want)
    df = spark.createDataFrame([([2.0], [0.0], [0.0], [1])], "p array<double>, r array<double>, v array<double>, m array<int>")
    assert V.value_loss(df, "p", "r", "v", "m").first().loss == pytest.approx(2.0)


def test_masks_and_padding(spark):
    df = spark.createDataFrame([([5, 2, 7, 2],), ([5, 6],)], "ids array<int>")
    assert [r.m for r in df.select(A.response_mask(F.col("ids"), 2).alias("m")).collect()] == [[1, 1, 0, 0], [1, 1]]
    assert [r.m for r in df.select(A.padded(F.col("ids"), 3, 0).alias("m")).collect()] == [[5, 2, 7, 2], [5, 6, 0]]
    assert [r.m for r in df.select(A.fitted(F.col("ids"), 3, 0, "left").alias("m")).collect()] == [[2, 7, 2], [0, 5, 6]]
    with pytest.raises(Exception, match="longer than 3"):
        df.select(A.fitted(F.col("ids"), 3, 0)).collect()


def test_folds(spark):
    df = spark.createDataFrame([([1.0, 3.0, 6.0], [True, None, True, False, True])], "x array<double>, f array<boolean>")
    r = df.select(A.differences(F.col("x")).alias("d"), A.running(F.col("x")).alias("s"), A.rms(F.col("x")).alias("r"), A.within(F.col("x"), 0, 7).alias("w"), A.longest_run(F.col("f")).alias("l")).first()
    assert r.d == [2, 3] and r.s == [0, 1, 4, 10] and r.r == pytest.approx(math.sqrt(46 / 3)) and r.w and r.l == 2
