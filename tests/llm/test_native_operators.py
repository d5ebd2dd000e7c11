"""Line dedup, mixing and decontamination against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollgrid.llm import decontaminate as D
from rollgrid.llm import line_dedup as N
from rollgrid.llm import mixing as M
from tests.llm import edge_cases as E

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(STRIP).translate(FOLD)


def plain_line_dedup(rows, least):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                holders[key(line)].add(i)
    gone = {k for k, ids in holders.items() if len(ids) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_by_brute_force(spark):
    rows = [(i, "\n".join(f"line {(i * j) % 7} " if j % 2 else f"\tLINE {j}" for j in range(i % 9))) for i in range(60)] + [(100, "rare\n\n"), (101, None), (102, "É line\né line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for fanout, batches in ((2, 4), (3, 7), (2, 1)):
        got = N.dedup_lines(docs, min_docs=12, fanout=fanout, batches=batches)
        assert sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == plain_line_dedup(rows, 12)


def test_line_edge_cases(spark):
    docs = E.documents(spark, clashing=True)
    got = N.dedup_lines(docs, min_docs=2)
    assert got.count() == len(E.ROWS)
    assert set(got.columns) == set(docs.columns)
    assert {(r.n_lines, r.n_dropped) for r in got.where("doc_id = 2 or doc_id = 3").collect()} == {(1, 0)}
    assert got.where("doc_id = 2 and text is null").count() == 1
    assert N.dedup_lines(E.empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "same"), (1, "same"), (2, "same")], "doc_id long, text string")
    assert {r.n_dropped for r in N.dedup_lines(twice, min_docs=3).collect()} == {0}  # repeated rows are one document
    assert {r.n_dropped for r in N.dedup_lines(twice, min_docs=2).collect()} == {1}


def test_runs_by_brute_force(spark):
    """Many batches over few and many keys, all buckets and levels, against plain counts."""
    rng = random.Random(1)
    for keys, fanout in ((3, 2), (40, 2), (400, 3)):
        runs, plain = N.LineRuns(spark, min_docs=4, fanout=fanout), defaultdict(set)
        for batch in range(7):
            rows = [(100 * batch + d, k, -k) for d in range(5) for k in {rng.randrange(keys) for _ in range(keys // 2 + 1)}]
            for d, k, _ in rows:
                plain[k].add(d)
            runs.add(spark.createDataFrame(rows, "doc long, h1 long, h2 long"))
        assert sorted(r.h1 for r in runs.frequent().collect()) == sorted(k for k, d in plain.items() if len(d) >= 4)


def test_settled_keys_are_not_counted_again(spark):
    runs = N.LineRuns(spark, min_docs=2, fanout=2)
    for batch in range(4):
        runs.add(spark.createDataFrame([(10 * batch + d, k, k) for d in range(3) for k in (1, batch + 2)], "doc long, h1 long, h2 long"))
    assert sorted(r.h1 for r in runs.frequent().collect()) == [1, 2, 3, 4, 5]


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped, budget = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = budget - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_runs_meet_bucket_by_bucket(spark):
    """A compaction shuffles nothing, a batch is shuffled once for its own counts, and no table is left behind."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    runs = N.LineRuns(spark, 3)
    rows = spark.range(60).selectExpr("id % 7 h1", "id % 5 h2", "id doc")
    one, two = (runs._run(rows.groupBy(*N.KEY).agg(F.count("*").alias("n_docs")).repartition(runs.buckets, *N.KEY)) for _ in range(2))
    merged = N.compacted(one, two.where("n_docs < 2"))
    assert "Exchange" not in plan(merged) and "Bucketed: true" in plan(merged)
    counts = {(i % 7, i % 5): sum(1 for j in range(60) if j % 35 == i) for i in range(35)}
    assert sorted(tuple(r) for r in merged.collect()) == sorted((*k, n + (n if n < 2 else 0)) for k, n in counts.items())
    runs.settled.append(one.where("n_docs > 1").select(*N.KEY))
    runs.add(rows.unionByName(spark.range(2).selectExpr("9 h1", "id h2", "id doc")))
    assert sorted(tuple(r) for r in runs.levels[0][0].collect()) == sorted([(i % 7, i % 5, 1) for i in range(25, 35)] + [(9, 0, 1), (9, 1, 1)])
    runs.frequent()
    assert spark.sql("SHOW TABLES").where("tableName like 'line_run%'").count() == 0


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (1 + (i * 37) % 300), f"s{i % 5}" if i % 3 else "hot") for i in range(900)] + [(1000 + i, "few words here", None) for i in range(20)] + [(2000, "", "s1"), (2001, None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    source_of = {i: s for i, _, s in rows}
    want = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and r.taken <= 2 * r["size"] and r.copies in (0, 1, 2)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 301
    assert sorted(got, key=repr) == sorted(M.mix(docs.repartition(7)).collect(), key=repr)
    emitted = M.mixed_documents(docs)
    assert emitted.count() == sum(r.copies for r in got) and emitted.columns == docs.columns


def test_mixing_in_small_buckets_and_by_seed(spark, monkeypatch):
    """Finer buckets change nothing; every row is emitted as often as planned, and another seed draws other copies."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 4 = 0").withColumn("text", F.lit("other words")))
    one = E.by_id(M.mix(docs), "doc_id", "size", "source_size", "target", "copies", "taken")
    monkeypatch.setattr(M, "BUCKET", 2)
    assert E.by_id(M.mix(docs), "doc_id", "size", "source_size", "target", "copies", "taken") == one
    emitted = M.mixed_documents(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r[4] for r in one)
    planned, found = {}, {}
    for doc, size, _, _, copies, _ in one:
        planned[doc, size] = planned.get((doc, size), 0) + copies
    for r in emitted.collect():
        key = r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        found[key] = found.get(key, 0) + 1
    assert found == {k: n for k, n in planned.items() if n}
    other = M.mix(docs, seed="again")
    assert E.by_id(other, "doc_id", "copies") != E.by_id(M.mix(docs), "doc_id", "copies")
    # a source misses its target by little more than one large document
    taken = other.groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 1.5 * r["size"] for r in taken)
    monkeypatch.setattr(M, "SOURCES", 1)
    with pytest.raises(ValueError):
        M.mix(docs)


def test_mixing_edge_cases(spark):
    docs = E.documents(spark, clashing=True)
    got = M.mix(docs)
    assert got.count() == len(E.ROWS) and got.where("size = 0 and taken > 0").count() == 0
    assert M.mix(E.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in M.mix(nothing).collect()} == {(0.0, 0)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain_decontamination(docs, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for at in range(len(w) - size + 1):
                owners = windows.get(tuple(w[at : at + size]))
                if owners:
                    hit |= set(range(at, at + size))
                    found |= {str(x) for x in owners if x is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 4, 10, 13])))) for i in range(14)] + [(50, None), (51, items_text := "Unique-term alpha, beta; GAMMA delta epsilon zeta eta theta iota kappa."), (None, "w1 w2 w3")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 40, 200])))) for i in range(60)]
    docs += [(100, "before " + items_text.upper() + " after"), (101, None), (102, "Unique-term alpha, beta"), (103, items[5][1] + " " + items[5][1])]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert E.by_id(got, *cols) == plain_decontamination(docs, items)


def test_decontamination_edge_cases(spark):
    docs = E.documents(spark, clashing=True)
    bench = spark.createDataFrame([(1, "Plain words stand here, more"), (2, "many words of one very long text many words of one very long text"), (2, "x" * 50_000)], "item_id long, text string")
    got = D.decontaminate(docs, bench)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    want = plain_decontamination([(r[0], r[1]) for r in E.ROWS], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(rows, key=repr) == want
    assert got.where(F.size("spans") > 0).count() == got.where("contaminated").count()
    assert D.decontaminate(E.empty(spark), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_proximity_by_brute_force(spark):
    """The rarest words of a window within the slop of where they stand in it, against plain Python."""
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.choice([1, 3, 10, 14])))) for i in range(12)] + [(50, None), (51, "r1 r1 r1 r2")]
    rows = []
    for i in range(60):
        words = rng.choice(items[:12])[1].split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = rng.choice([[], ["c1"], ["r7", "c2"]])
        rows.append((i, " ".join([rng.choice(common) for _ in range(rng.randrange(5))] + words + ["end"])))
    rows += [(80, None), (81, ""), (5, rows[5][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    texts = {i: t.split() for i, t in rows if t}
    counts = {}
    for _, t in {(i, t) for i, t in rows if t}:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    # equal rows are counted once more for each
    for w in rows[5][1].split():
        counts[w] += 1
    for slop, terms in ((0, 2), (2, 3)):
        want = set()
        for item, t in items:
            words = (t or "").split()
            for at in range(max(len(words) - 9, 1) if words else 0):
                w = words[at : at + 10]
                ranked = sorted(range(len(w)), key=lambda o: (counts.get(w[o], 0), o))[:terms]
                if any(counts.get(x, 0) == 0 for x in (w[o] for o in ranked)):
                    continue
                for doc, d in texts.items():
                    for pos, x in enumerate(d):
                        start = pos - ranked[0]
                        if x == w[ranked[0]] and start >= 0 and all(any(0 <= start + o + s < len(d) and d[start + o + s] == w[o] for s in range(-slop, slop + 1)) for o in ranked[1:]):
                            want.add((doc, str(item), start))
        got = D.near(docs, bench, slop=slop, terms=terms)
        assert {(r.doc_id, r.item, r.start) for r in got.collect()} == want and len(want) > 20
    exact = {(r.doc_id, s.start) for r in D.decontaminate(docs, bench).collect() for s in r.spans}
    assert exact <= {(d, s) for d, _, s in want}
    assert D.near(E.empty(spark), bench).count() == 0 and D.near(docs, bench.limit(0)).count() == 0
