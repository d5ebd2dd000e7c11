import json

import pytest
from pyspark.sql import functions as F

from rollgrid.operators import guards
from rollgrid.plans import pipelines
from rollgrid.sources import readers, writers
from rollgrid.streaming import logs


def lines(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return f"file://{path}"


def test_rollouts_take_missing_and_unknown_keys(spark, tmp_path):
    path = lines(tmp_path / "r.jsonl", [{"token": "a", "pdms_scaled": 0.5, "poses": [[0, 1, 2]], "extra": 1}, {"token": "b", "safe": 1.0}])
    got = {r.token: r for r in readers.rollouts(spark, path).collect()}
    assert got["a"].poses == [[0.0, 1.0, 2.0]] and got["b"].pdms_scaled is None and got["b"].safe == 1.0
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.rollouts(spark, f"file://{tmp_path}/bad.jsonl").collect()


def test_manifest_order_mark_and_duplicates(spark, tmp_path):
    (tmp_path / "m.txt").write_text("﻿b\n\n a \nc\n", encoding="utf-8")
    assert [(r.pos, r.token) for r in readers.manifest(spark, f"file://{tmp_path}/m.txt").orderBy("pos").collect()] == [(0, "b"), (1, "a"), (2, "c")]
    (tmp_path / "d.txt").write_text("a\nb\na\n")
    with pytest.raises(guards.GuardError, match="duplicate"):
        readers.manifest(spark, f"file://{tmp_path}/d.txt")
    (tmp_path / "t.txt").write_text("a\tx\nb\ta\na\ty\n\n")
    assert sorted(r.token for r in readers.token_set(spark, f"file://{tmp_path}/t.txt").collect()) == ["a", "b"]
    (tmp_path / "m.csv").write_text("log_name,token\nl1,a\nl1,b\nl2,c\n")
    assert {r.log_name: sorted(r.tokens) for r in readers.manifest_csv(spark, f"file://{tmp_path}/m.csv").collect()} == {"l1": ["a", "b"], "l2": ["c"]}


def test_steps_must_be_dense(spark, tmp_path):
    s = {"generated_groups": 8, "raw_rollout_overhead": 2.0}
    rows = [{"step": i, "sampling": s, "timing_s": {"step": 60.0}} for i in (2, 1, 3)]
    path = lines(tmp_path / "s.jsonl", [*rows, {"step": 3, "val": 1}])
    assert [r.step for r in readers.steps(spark, path, 3).collect()] == [1, 2, 3]
    with pytest.raises(guards.GuardError, match="missing steps"):
        readers.steps(spark, path, 4)
    with pytest.raises(guards.GuardError, match="duplicate"):
        readers.steps(spark, lines(tmp_path / "s2.jsonl", [*rows, rows[0]]), 3)


def test_score_folder_to_tokens(spark, tmp_path):
    folder = tmp_path / "scores"
    folder.mkdir()
    row = lambda t, x, v: f"{t},{x},{x},{v}\n"
    for n in range(4):
        (folder / f"run{n}.csv").write_text("token,pdms,pdms_scaled,valid\n" + row("good", n % 2, "True") + row("flat", 0.5, "true") + row("bad", "oops", "True") + row("gone", 1, "False") + row("average_all_frames", 1, "True"))
    (folder / "run9_bak.csv").write_text("token,pdms,pdms_scaled,valid\n" + row("backup", 1, "True"))
    (folder / "merged.csv").write_text("token,pdms,pdms_scaled,valid\n" + row("output", 1, "True"))
    df = readers.score_files(spark, f"file://{folder}")
    assert {r.token for r in df.collect()} == {"good", "flat", "bad", "average_all_frames"}
    scored = readers.score_columns(df)
    assert {r.token for r in scored.collect()} == {"good", "flat"}
    kept = pipelines.select_scenes(spark, f"file://{folder}", f"file://{tmp_path}/tokens", n_rollout=8, group_size=4)
    assert [r.token for r in kept.collect()] == ["good"]
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/tokens").collect()] == ["good"]
    assert readers.score_files(spark, f"file://{folder}", include="none*").count() == 0


def test_scored_scenes_keep_tokens_without_name(spark, tmp_path):
    head = "token,valid,no_at_fault_collisions,drivable_area_compliance,ego_progress,time_to_collision_within_bound,history_comfort\n"
    (tmp_path / "x.csv").write_text(head + "a,True,1,1,.5,1,1\nb,False,1,1,1,1,1\nAverage_all,True,1,1,1,1,1\n,True,1,1,1,1,1\n")
    got = pipelines.driving_scores(readers.scored_scenes(spark, f"file://{tmp_path}/x.csv"))
    assert {(r.token, round(r.pdms, 4)) for r in got.collect()} == {("a", round(9.5 / 12, 4)), (None, 1.0)}
    (tmp_path / "y.csv").write_text("token\na\n")
    assert readers.scored_scenes(spark, f"file://{tmp_path}/y.csv").count() == 0


def test_datasets_by_split(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "token string, split string")
    writers.parquet(df, f"file://{tmp_path}/d")
    assert [r.token for r in readers.dataset(spark, f"file://{tmp_path}/d").collect()] == ["a"]
    assert [r.token for r in readers.dataset(spark, f"file://{tmp_path}/d@test").collect()] == ["b"]


def test_cache_index_and_checkpoints(spark, tmp_path):
    (tmp_path / "i.csv").write_text("file\n/c/log/t1/x.pkl\n/c/log2/t1/x.pkl\n/c/log/t2/x.pkl\n")
    assert {r.token: r.path for r in readers.cache_index(spark, f"file://{tmp_path}/i.csv").collect()} == {"t1": "/c/log2/t1/x.pkl", "t2": "/c/log/t2/x.pkl"}
    assert readers.latest_checkpoint(spark, f"file://{tmp_path}/none.json") == (None, None)
    (tmp_path / "tracker.json").write_text('{"last_global_step": 40}')
    assert readers.latest_checkpoint(spark, f"file://{tmp_path}/tracker.json") == (f"file://{tmp_path}/global_step_40", 40)
    steps = spark.createDataFrame([(10, 0.9), (20, 0.1), (30, 0.2), (40, 0.3)], "step int, best double")
    assert sorted(r.step for r in writers.kept_checkpoints(steps, 3).collect()) == [10, 30, 40]
    assert writers.kept_checkpoints(steps, -1).count() == 4


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é", None), ("b", 0.5)], "token string, pdms double").withColumn("pdms_scaled", F.col("pdms"))
    writers.jsonl(df, f"file://{tmp_path}/j")
    text = "".join(r.value for r in spark.read.text(f"file://{tmp_path}/j").collect())
    assert "é" in text and '"pdms":null' in text
    writers.scores(df, f"file://{tmp_path}/s")
    assert sorted(r.pdms for r in spark.read.option("header", True).csv(f"file://{tmp_path}/s").collect()) == ["0.0", "0.5"]
    writers.summary(df, f"file://{tmp_path}/sum")
    assert len(list((tmp_path / "sum").glob("*.csv"))) == 1


def test_nested_and_flat_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a/b", "a/c", "d"])
    deep = df.select(*writers.nested(df.columns))
    assert deep.first().a.c == 2 and writers.flattened(deep).columns == ["a/b", "a/c", "d"]


def test_binary_scenes_and_digests(spark, tmp_path):
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "one.bin").write_bytes(b"ab")
    got = readers.scenes(spark, f"file://{tmp_path}/bin", lambda path, content: [(len(content), c) for c in content], "size long, value long")
    assert sorted((r["size"], r.value) for r in got.collect()) == [(2, 97), (2, 98)]
    assert len(readers.file_digests(spark, f"file://{tmp_path}/bin").first().sha256) == 64


def test_streams_of_rollouts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines(source / "1.jsonl", [{"token": "a", "pdms_scaled": 0.0}, {"token": "a", "pdms_scaled": 1.0}])
    stream = logs.rollout_stream(spark, f"file://{source}")
    got = logs.settled(logs.running_group_stats(stream), ["token"]).first()
    assert got.group_size == 2 and got.pdms_scaled_std == pytest.approx(0.5**0.5)
    q = logs.append_jsonl(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", every=None)
    q.awaitTermination()
    lines(source / "2.jsonl", [{"token": "b", "pdms_scaled": 1.0}])
    logs.append_jsonl(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", every=None).awaitTermination()
    assert sorted(r.token for r in readers.rollouts(spark, f"file://{tmp_path}/out").collect()) == ["a", "a", "b"]


def test_sessions_and_accumulation(spark, tmp_path):
    source = tmp_path / "acc"
    source.mkdir()
    lines(source / "1.jsonl", [{"key": "r", "kept": k} for k in (1, 2, 0, 5, 9)] + [{"key": "s", "kept": 0}] * 4)
    stream = spark.readStream.schema("key string, kept int").json(f"file://{source}")
    q = logs.accumulated_batches(stream, "key", "kept", target=4, most=4).writeStream.format("memory").queryName("acc").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.key: r for r in spark.table("acc").collect()}
    assert got["r"].full and got["r"].kept == 8 and got["r"].batches == 4 and got["s"].given_up


def test_fan_out_writes_to_all(spark):
    seen = []
    logs_of = lambda name: lambda df, epoch: seen.append((name, epoch, df.count()))
    writers.fan_out(logs_of("a"), logs_of("b"))(spark.range(3), 7)
    assert seen == [("a", 7, 3), ("b", 7, 3)]


def test_manifest_of_several_files_and_ranges(spark, tmp_path):
    """Lines of a folder follow the names of its files, also where a file is read in several ranges."""
    folder = tmp_path / "parts"
    folder.mkdir()
    names = [f"t{(i * 7919) % 100_003:06d}" for i in range(9000)]
    for k in range(3):
        (folder / f"part-0000{k}.txt").write_text("".join(f"{n}\r\n" for n in names[3000 * k : 3000 * (k + 1)]), newline="")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = readers.manifest(spark, f"file://{folder}").orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r.pos, r.token) for r in got] == list(enumerate(names))
