"""Permuted batches, balanced parts, Poisson resampling and the keyed sink."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollgrid.operators import batch as B
from rollgrid.operators import graph, groups
from rollgrid.streaming import logs


@pytest.mark.parametrize("n", [1, 2, 5, 97, 1000])
def test_permutations_are_bijections(spark, n):
    rows = spark.range(n).select(B.permuted(F.col("id"), n, F.lit(3), F.lit(0)).alias("a"), B.permuted(F.col("id"), n, F.lit(3), F.lit(1)).alias("b"), "id").collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n))
    assert n < 97 or ([r.a for r in rows] != [r.b for r in rows] and np.corrcoef([r.id for r in rows], [r.a for r in rows])[0, 1] < 0.4)


def test_batches_need_no_sort(spark):
    df = spark.range(500).select(F.col("id").alias("pos"))
    out = B.mini_batches(df, 64, epochs=3, seed=5, n=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Sort" not in plan
    sizes = {(r.epoch, r.batch): r["count"] for r in out.groupBy("epoch", "batch").count().collect()}
    assert sizes == {(e, b): min(64, 500 - 64 * b) for e in range(3) for b in range(8)}
    assert {r["n"] for r in out.groupBy("epoch", "pos").agg(F.count("*").alias("n")).collect()} == {1}


def test_parts_are_as_even_as_the_heap_s(spark):
    rng = np.random.default_rng(2)
    rows = [(b, i, int(x)) for b, n in ((0, 403), (1, 64), (2, 3)) for i, x in enumerate(rng.geometric(0.03, n))] + [(0, 1000 + i, 17) for i in range(300)]
    df = spark.createDataFrame(rows, "batch int, pos long, n int").withColumns({"_round": F.lit(1), "extra": F.lit("x")})
    got = B.balanced(df.drop("_round"), "batch", "n", 4, equal=False)
    assert got.count() == len(rows)
    for b in (0, 1, 2):
        lengths = [x for c, _, x in rows if c == b]
        sums = {r.part: (r.total, r.k) for r in got.where(F.col("batch") == b).groupBy("part").agg(F.sum("n").alias("total"), F.count("*").alias("k")).collect()}
        totals = [t for t, _ in sums.values()] + [0] * (4 - len(sums))
        heap = [sum(lengths[i] for i in p) for p in B.largest_differencing(lengths, 4, False)]
        assert sum(totals) == sum(lengths) and max(totals) - min(totals) <= max(lengths)
        assert max(totals) <= max(heap) * 1.02 + 2 and max(k for _, k in sums.values()) - min([k for _, k in sums.values()] if len(sums) == 4 else [0]) <= 1
    with pytest.raises(ValueError):
        B.balanced(df, "batch", "n", 4)
    none = B.balanced(df.limit(0), "batch", "n", 4, equal=False)
    assert none.count() == 0


def test_resampling_by_hash(spark):
    """Counts follow a Poisson law of mean 1, and the interval that of drawing rows."""
    counts = {r.w: r["count"] for r in spark.range(2000).crossJoin(spark.range(20).withColumnRenamed("id", "b")).select(groups.poisson_counts(F.col("id"), F.col("b")).alias("w")).groupBy("w").count().collect()}
    n = sum(counts.values())
    for k, p in enumerate([0.36788, 0.36788, 0.18394, 0.06131, 0.01533]):
        assert abs(counts.get(k, 0) / n - p) < 0.01
    rng = np.random.default_rng(1)
    x = rng.normal(5, 2, 400)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)] + [("g", 999, None)], "k string, i long, x double")
    r = groups.poisson_ci(df, "k", "x", "i", 500).first()
    means = [x[rng.integers(0, 400, 400)].mean() for _ in range(2000)]
    assert r["mean"] == pytest.approx(x.mean()) and abs(r.low - np.quantile(means, 0.025)) < 0.06 and abs(r.high - np.quantile(means, 0.975)) < 0.06
    assert groups.poisson_ci(df, "k", "x", "i", 500).first() == r


def test_sink_writes_each_batch_once(spark, tmp_path):
    source, path, schema = tmp_path / "in", f"file://{tmp_path}/out", "k string, at long, v long"
    source.mkdir()
    assert logs.keyed(spark, path, schema, ["k"], "at").count() == 0

    def run(checkpoint):
        stream = spark.readStream.schema(schema).json(f"file://{source}")
        logs.keyed_sink(stream, path, f"file://{tmp_path}/{checkpoint}").awaitTermination()
        return sorted((r.k, r.at, r.v) for r in logs.keyed(spark, path, schema, ["k"], "at").collect())

    (source / "1.json").write_text('{"k": "a", "at": 1, "v": 1}\n{"k": "a", "at": 2, "v": 2}\n{"k": "b", "at": 1, "v": 5}\n')
    assert run("ck") == [("a", 2, 2), ("b", 1, 5)]
    (source / "2.json").write_text('{"k": "a", "at": 0, "v": 9}\n')
    assert run("ck") == [("a", 0, 9), ("b", 1, 5)]  # a later batch replaces the key
    files = lambda: sorted(str(p) for p in (tmp_path / "out" / "data").rglob("*.parquet"))
    before = files()
    # the checkpoint is lost: the first batch number comes again, and the ledger passes over it
    assert run("lost") == [("a", 0, 9), ("b", 1, 5)] and files() == before
    # a batch that stands without its ledger entry is what a failure leaves: it does not count, and is written anew
    (tmp_path / "out" / "data" / "batch=7").mkdir()
    spark.createDataFrame([("z", 1, 1)], schema).write.mode("overwrite").parquet(f"{path}/data/batch=7")
    assert [r.k for r in logs.keyed(spark, path, schema, ["k"], "at").orderBy("k").collect()] == ["a", "b"]


def heap_search(edges, start):
    """(cost, edges, path) of the best path to every node, by a heap."""
    best, heap = {}, [(0.0, 0, (start,))]
    while heap:
        label = heapq.heappop(heap)
        node = label[2][-1]
        if node in best:
            continue
        best[node] = label
        for s, d, c in edges:
            if s == node and d not in best:
                heapq.heappush(heap, (label[0] + c, label[1] + 1, (*label[2], d)))
    return best


@pytest.mark.parametrize("delta", [None, 3.0])
def test_shortest_paths_of_random_graphs(spark, delta):
    rng = random.Random(4)
    edges, asked = [], []
    for g in range(100):
        n = rng.randrange(2, 9)
        edges += [(g, rng.randrange(n), rng.randrange(n), float(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 18))]
        asked += [(g, rng.randrange(n), rng.randrange(n)) for _ in range(2)]
    got = graph.shortest_paths(spark.createDataFrame([*edges, (0, 0, 1, None)], "graph int, src int, dst int, cost double"), spark.createDataFrame(asked, "graph int, src int, dst int"), delta=delta).collect()
    want = []
    for g, s, d in asked:
        best = heap_search([e[1:] for e in edges if e[0] == g], s)
        end = best.get(d) or min(best.values(), key=lambda x: (-x[1], x[0], x[2][-1]))
        want.append((g, s, d, end[2], end[0], d in best))
    assert sorted((r.graph, r.src, r.dst, tuple(r.path), r.cost, r.found) for r in got) == sorted(want) and {w[5] for w in want} == {True, False}
    with pytest.raises(ValueError):
        graph.shortest_paths(spark.createDataFrame([(1, 1, 2, -1.0)], "graph int, src int, dst int, cost double"), spark.createDataFrame(asked, "graph int, src int, dst int"))
