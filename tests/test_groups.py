import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rollgrid.functions import scores as S
from rollgrid.operators import groups, guards, manifests
from rollgrid.plans import catalog, pipelines


def rows(spark, values):
    return spark.createDataFrame([(t, float(x)) for t, xs in values.items() for x in xs], "token string, pdms_scaled double")


def test_ranking_puts_the_learnable_first_and_the_impossible_last(spark):
    df = rows(spark, {"impossible": [0.1] * 4, "easy": [0.9, 0.9, 0.95, 0.95], "learnable": [0.3, 0.35, 0.8, 0.85]})
    order = [r.token for r in groups.learnability_ranking(df).collect()]
    assert order[0] == "learnable" and order[-1] == "impossible"


def test_group_stats_of_one_row_have_no_std(spark):
    got = {r.token: r for r in groups.group_stats(rows(spark, {"a": [0.5], "b": [0, 1]}), measures=["pdms_scaled"]).collect()}
    assert got["a"].pdms_scaled_std is None and got["a"].pdms_scaled_range == 0
    assert got["b"].pdms_scaled_std == pytest.approx(math.sqrt(0.5))


def test_scene_filter_drops_single_and_flat_groups(spark):
    df = rows(spark, {"single": [0.4], "flat": [0.5] * 8, "two-valued": [0, 1] * 8})
    stats = groups.group_stats(df, measures=["pdms_scaled"])
    assert {r.token for r in groups.scene_filter(stats, group_size=16).collect()} == {"two-valued"}


def test_scene_filter_adds_as_rows_are_stored(spark, tmp_path):
    """With groups that lie over several files, sums of doubles are those of the SQL over the rows in their order."""
    db = duckdb.connect(config={"threads": 1})
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(8):
        db.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.01/lineitem.parquet' LIMIT 7500 OFFSET {i * 7500}) TO '{tmp_path}/lineitem.parquet/{i}.parquet'")
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.sql(catalog.ORACLE_SQL["scene_filter"])
    got = catalog.scene_filter(spark, str(tmp_path)).select(*want.columns).collect()
    assert len(got) > 1000 and {tuple(r) for r in got} == set(want.fetchall())


def test_group_filter_modes(spark):
    df = spark.createDataFrame([("zero", 0.5, 0), ("zero", 0.5, 1), ("signal", 0.2, 2), ("signal", 0.8, 3), ("other", 0.0, 4), ("other", 0.0, 5)], "uid string, score double, pos int")
    assert sorted(r.pos for r in groups.group_filter(df).collect()) == [2, 3]
    assert sorted(r.pos for r in groups.group_filter(df, mode="mean", low=0.0, high=1.0).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        groups.group_filter(df, mode="median")


def test_rollout_report_matches_known_numbers(spark):
    values = [(t, x, n) for t in "ab" for x, n in zip((0.4, 0.4, 0.41, 0.42), (200, 204, 204, 204))]
    df = spark.createDataFrame(values, "token string, pdms_scaled double, response_length int")
    r = groups.rollout_report(df, clip_length=204).first()
    assert r["mean"] == pytest.approx(0.4075) and r["std"] == pytest.approx(0.0082915619759)
    assert r["headroom"] == pytest.approx(0.0125) and r["low_std_ratio"] == 1.0 and r["clipped"] == 6


def test_reward_precedence_and_missing_columns(spark):
    df = spark.createDataFrame([("a", 0.0, 0.9), ("b", None, 0.4)], "token string, training_reward double, pdms_scaled double")
    assert [r.r for r in df.select(groups.reward(df).alias("r")).collect()] == [0.0, 0.4]
    with pytest.raises(KeyError):
        groups.reward(df.select("token"))


def test_persistent_failures_count_missing_marks_as_unsafe(spark):
    df = spark.createDataFrame([("a", None, 0.4), ("a", 0.0, 0.1), ("b", 1.0, 0.5), ("b", 0.0, 0.0), ("c", 1.0, 0.0)], "token string, safe double, pdms_scaled double")
    assert sorted(r.token for r in groups.persistent_failures(df).collect()) == ["a", "c"]


def test_hard_scenes_follow_the_manifest(spark):
    full = spark.createDataFrame([(i, t) for i, t in enumerate("abcd")], "pos long, token string")
    proxy = full.where("token in ('a', 'c')")
    df = spark.createDataFrame([("a", 0.0, 0.1)] * 4 + [("c", 1.0, 0.0)] * 4, "token string, safe double, pdms_scaled double")
    assert [r.token for r in pipelines.hard_scenes(df, proxy, full).collect()] == ["a", "c"]
    assert [r.token for r in pipelines.hard_scenes(df, proxy, full, limit=1).collect()] == ["a"]


def test_spearman_of_monotone_flat_and_tied(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 1.0, float(i // 2)) for i in range(20)], "a double, b double, flat double, tied double")
    assert groups.spearman(df, "a", "b").first()[0] == pytest.approx(1.0)
    assert groups.spearman(df, "a", "flat").first()[0] == 0.0
    ranks = {r.tied: r.r for r in groups.average_ranks(df, "tied", "r").collect()}
    assert ranks[0.0] == 0.5 and ranks[9.0] == 18.5


def test_quantile_bins_are_floors_of_positions(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(23)], "k int, m double")
    got = {r.k: r.bin for r in groups.quantile_bins(df, "m", "k").collect()}
    order = sorted(range(23), key=lambda i: (i % 7, i))
    assert got == {k: i * 5 // 23 for i, k in enumerate(order)}


def test_diversity_of_two_trajectories(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    data = [("t", 0, True, p((0, 0), (1, 0))), ("t", 1, True, p((0, 1), (1, 2))), ("t", 2, False, p((9, 9), (9, 9)))]
    df = spark.createDataFrame(data, "token string, pos int, parsed_ok boolean, poses array<struct<x:double,y:double>>")
    assert groups.diversity(df).first()["distance"] == pytest.approx(1.5)
    assert groups.diversity(df, final=True).first()["distance"] == pytest.approx(2.0)


def test_best_of_n_and_average_row(spark):
    df = spark.createDataFrame([("a", 0.5, 0), ("a", 0.9, 1), ("b", 0.9, 3), ("b", 0.9, 2)], "token string, score double, pos int")
    best = groups.best_of_n(df)
    assert sorted((r.token, r.pos) for r in best.collect()) == [("a", 1), ("b", 2)]
    average = groups.with_average_row(best.select("token", "score"), name="average_best_of_n").where("token = 'average_best_of_n'").first()
    assert average.score == pytest.approx(0.9)


def test_bootstrap_of_constant_differences(spark):
    base = spark.createDataFrame([(str(i), float(i)) for i in range(6)], "token string, m double")
    candidate = spark.createDataFrame([(str(i), float(i + 1)) for i in reversed(range(6))], "token string, m double")
    long = manifests.long_differences(base, candidate, ["m"])
    r = groups.bootstrap_ci(long, "metric", "difference", 200).first()
    assert (r["mean"], r["low"], r["high"]) == (1.0, 1.0, 1.0)
    d = manifests.paired_differences(base, candidate, ["m"]).first()
    assert d["difference"] == 1.0 and d["n"] == 6


def test_sampling_caps_shrink_failures(spark):
    grid = spark.createDataFrame([(0.5, 1), (0.5, 5)], "ratio double, cap int")
    got = {r.cap: r for r in groups.sampling_caps(grid, 4, 20, 2000).collect()}
    assert got[1].step_failure > got[5].step_failure and 1 <= got[5].mean_attempts <= 5


def test_pilot_report_ignores_validation_rows(spark):
    s = "step int, sampling struct<generated_groups:int,kept_groups:int,used_groups:int,dropped_groups:int,generation_batches:int,raw_rollout_overhead:double>, timing_s struct<step:double>"
    log = spark.createDataFrame([(i, (8, 5, 4, 3, 2, 2.0), (60.0,)) for i in range(1, 21)] + [(20, None, (900.0,))], s)
    parent = spark.createDataFrame([(i, None, (40.0,)) for i in range(1, 21)], s)
    r = groups.pilot_report(log, parent, 20).first()
    assert r["mean_overhead"] == 2.0 and r["time_ratio"] == 1.5 and r["steps"] == 20


def test_coverage_and_leakage_guards(spark):
    manifest = spark.createDataFrame([("a",), ("b",)], "token string")
    ok = rows(spark, {"a": [0.1] * 2, "b": [0.2] * 2})
    guards.covered(ok, manifest, expected=2)
    with pytest.raises(guards.GuardError, match="outside the training manifest"):
        guards.covered(rows(spark, {"a": [1], "b": [1], "x": [1]}), manifest)
    with pytest.raises(guards.GuardError, match="coverage"):
        guards.covered(rows(spark, {"a": [1]}), manifest)
    with pytest.raises(guards.GuardError, match="exactly 4"):
        guards.covered(ok, manifest, expected=4)
    with pytest.raises(guards.GuardError, match="duplicate"):
        guards.unique(ok, "token")
    with pytest.raises(guards.GuardError, match="overlap"):
        guards.disjoint(manifest, manifest)
    with pytest.raises(guards.GuardError, match="missing"):
        guards.required(ok, ["speed"])


def test_routing_to_train_and_dev(spark):
    train, dev = spark.createDataFrame([("train_a",), ("train_b",)], "token string"), spark.createDataFrame([("dev",)], "token string")
    df = rows(spark, {"train_a": [0, 1], "train_b": [0], "dev": [1]})
    a, b = manifests.routed(df, train, dev)
    assert (a.count(), b.count()) == (3, 1)
    with pytest.raises(guards.GuardError, match="outside both manifests"):
        manifests.routed(rows(spark, {"held_out": [1]}), train, dev)
    with pytest.raises(guards.GuardError):
        manifests.routed(df, train, dev, expected_train=2)


def test_safe_scores_outrank_unsafe_ones(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.5, 0.5, 0.5), (0.0, 1.0, 1.0, 1.0, 1.0), (1.0, 0.0, 0.5, float("nan"), 0.5)], "nc double, dac double, ep double, ttc double, hc double")
    got = [r.s for r in df.select(S.safety_first_reward(*[F.col(c) for c in df.columns]).alias("s")).collect()]
    assert got[1] <= 0.1 < 0.5 <= got[0] <= 1.0 and got[2] == pytest.approx(0.1)


def test_extended_score_without_comfort(spark):
    df = spark.createDataFrame([(1.0, [0.5, 1.0, 1.0, 1.0], float("nan")), (1.0, [0.5, 1.0, 1.0, 1.0], 0.0)], "p double, m array<double>, c double")
    got = df.select(S.extended_score(F.col("p"), F.col("m"), F.col("c")).alias("a"), S.extended_score(F.col("p"), F.col("m"), F.col("c"), strict=True).alias("b")).collect()
    assert got[0].a == pytest.approx(11.5 / 14) and got[0].b is None and got[1].a == pytest.approx(11.5 / 16)


def test_summary_with_sets_and_subset_report(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.5, 0.0), ("b", 0.1, None), ("b", 0.9, 1.0)], "token string, pdms_scaled double, safe double")
    out = groups.group_summary(df, sets={"chosen": spark.createDataFrame([("b",)], "token string")})
    got = {r.token: r for r in out.collect()}
    assert got["b"].in_chosen and not got["a"].in_chosen and got["a"].safe_rate == 0.5
    assert groups.subset_report(out).first()["zero_std_ratio"] == 0.5


def test_ranks_of_values_that_recomputation_changes(spark):
    """Values whose last bits differ each time they are computed, as sums of shuffled doubles do, still get all their ranks."""
    shaken = F.udf(lambda i: i + random.random() * 1e-9, "double").asNondeterministic()
    df = spark.range(500).select(shaken("id").alias("a"), shaken(F.col("id") * 2).alias("b"))
    assert groups.average_ranks(df, "a", "r").count() == 500
    assert groups.spearman(df, "a", "b").first()[0] == pytest.approx(1.0)
