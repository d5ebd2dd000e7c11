"""Logs of frames: byte ranges against whole files, pushed filters, and a stream over growing logs."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from rollgrid.operators import scenes
from rollgrid.sources import frames as S

KIND = "log_name string, position long, token string, idx int, pose array<double>, box struct<x: double, name: string>"


def frame(log, i):
    return {"token": f"{log}-{i}", "idx": i, "pose": [i / 2, None], "box": {"x": 1.5, "name": "é" * (i % 5)}, "unused": {"deep": [i]}}


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    for log, n in (("one", 57), ("two", 3), ("empty", 0)):
        (root / f"{log}.jsonl").write_text("".join(json.dumps(frame(log, i), ensure_ascii=False) + "\n" * (1 + i % 2) for i in range(n)))
    (root / "log_name=a%20b").mkdir()
    (root / "log_name=a%20b" / "part-0.json").write_text(json.dumps(frame("ab", 0)))  # without a last line feed
    (root / "_SUCCESS").write_text("no frames")
    return f"file://{root}"


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_every_line_once(seed):
    rng = random.Random(seed)
    lines = [b"x" * rng.choice([0, 1, 2, 7, 30]) for _ in range(60)]
    text = b"\n".join(lines) + rng.choice([b"", b"\n"])
    for step in (1, 2, 3, 5, 16, 100, 5000):
        for block in (1, 2, 7, 64):
            got = []
            for begin in range(0, len(text), step):
                for at, part in S.blocks(io.BytesIO(text), begin, min(begin + step, len(text)), block):
                    assert text[at : at + len(part)] == part and (at == 0 or text[at - 1 : at] == b"\n") and (part.endswith(b"\n") or at + len(part) == len(text))
                    got.append(part)
            assert b"".join(got) == text


@pytest.mark.parametrize("size", [10, 333, 1 << 20])
def test_frames_are_read_whole(spark, logs, size):
    got = S.frames(spark, logs, KIND, rangeBytes=size, blockBytes=64).orderBy("log_name", "position").collect()
    want = [("a b", frame("ab", 0))] + [(log, frame(log, i)) for log, n in (("one", 57), ("two", 3)) for i in range(n)]
    assert [(r.log_name, r.token, r.idx, r.pose, r.box.name) for r in got] == [(log, f["token"], f["idx"], f["pose"], f["box"]["name"]) for log, f in want]


def test_filters_and_columns_reach_the_source(spark, logs):
    df = S.frames(spark, logs, "log_name string, token string")
    some = df.where(F.col("log_name").isin("one", "two") & F.col("token").isin("one-4", "two-1", "ab-0") & F.col("token").startswith("one"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "IN" not in plan.split("Filter")[1].split("\n")[0].upper().replace("STARTSWITH", "")
    assert [tuple(r) for r in some.collect()] == [("one", "one-4")]
    assert df.where("log_name = 'none'").count() == 0
    assert df.where("log_name = 'two' and log_name = 'one'").count() == 0
    reader = S.FramesReader(df.schema, {"path": logs})
    assert not list(reader.pushFilters([S.EqualTo(("log_name",), "two")])) and [S.log_of(r.path) for r in reader.partitions()] == ["two"]


def test_a_broken_line_is_told(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"token": "a"}\n{"token": \n')
    with pytest.raises(Exception, match="(?i)json"):
        S.frames(spark, f"file://{tmp_path}").collect()


def test_frames_make_scenes(spark, logs):
    df = S.frames(spark, logs, KIND)
    got = scenes.hopping_windows(df, scenes.FrameWindow(2, 2, 4), order=("position",)).collect()
    assert sum(r.log_name == "one" for r in got) == 14 and {len(r.frames) for r in got} == {4}


def test_a_stream_follows_growing_logs(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{n}" for n in ("logs", "out", "state"))
    (tmp_path / "logs").mkdir()
    write = lambda name, text: open(f"{folder}/{name}.jsonl", "a").write(text)

    def run():
        stream = S.frames(spark, f"file://{folder}", "log_name string, token string, position long", stream=True, rangeBytes=20)
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).start(out)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.token for r in spark.read.parquet(out).collect())

    write("a", '{"token": "1"}\n{"token": "2"}\n{"tok')
    assert run() == ["1", "2"]
    write("a", 'en": "3"}\n')
    write("b", '{"token": "4"}\n{"token": "5"}')
    assert run() == ["1", "2", "3", "4"]
    write("b", "\n")
    assert run() == run() == ["1", "2", "3", "4", "5"]
