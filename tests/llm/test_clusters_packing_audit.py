"""Centroid clustering, packing and the filter audit against plain Python, and their results on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollgrid.llm import clustering as C
from rollgrid.llm import filter_audit as A
from rollgrid.llm import packing as P
from rollgrid.llm.token_counts import vocabulary_path
from tests.llm import edge_cases as E

# centroid clustering


def plain_clusters(rows, k, rounds, dim, scale):
    """(id, cluster, distance) of every row in plain integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named + sorted(("", v) for i, v in kept if i is None)][:k]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else c for n, c in enumerate(centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


def clusters(spark, rows, k, rounds, dim, scale, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"q": F.lit(1), "n": F.lit(2), "cluster": F.lit("x"), "distance": F.lit(None)})
    out, centroids = C.clustered(df, k, rounds, dim, scale)
    found = out.collect()
    totals = defaultdict(int)
    for r in found:
        totals[r.cluster] += r.distance
    assert all(r.cluster_inertia == totals[r.cluster] and r.inertia == sum(totals.values()) for r in found)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in found), key=repr), centroids.tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_by_brute_force(spark, seed):
    rng = random.Random(seed)
    some = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(60)]
    rows = [(i, some[min(i, 400) % 60 if i < 300 else 7]) for i in range(450)]  # copies, one vector a third of all
    assert clusters(spark, rows, 6, 3, 4, 64) == plain_clusters(rows, 6, 3, 4, 64)


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [-inf, 0.0]), (7, [0.0]), (None, [0.25, -0.25]), (8, [-0.01, 0.01]), (9, [0.5, 0.5])]
    for k in (2, 5, 16):
        assert clusters(spark, rows, k, 3, 2, 64) == plain_clusters(rows, k, 3, 2, 64)
    assert clusters(spark, [], 3, 2, 2, 64) == ([], [])


def test_distances_beyond_the_floats(spark):
    """Components whose products no double holds are summed as 64-bit integers."""
    rows = [(i, [float(2**24 + i * 3), float(-(2**23) - i)]) for i in range(40)]
    assert clusters(spark, rows, 3, 2, 2, 64) == plain_clusters(rows, 3, 2, 2, 64)


def test_copies_are_assigned_once(spark):
    """Lloyd sees distinct vectors: a third of all rows that are equal make one row."""
    vectors, centroids = np.array([[1, 2], [5, 5], [9, 9]]), np.array([[0, 0], [9, 9]])
    at, distance = C.nearest(vectors, centroids)
    assert at.tolist() == [0, 1, 1] and distance.tolist() == [5, 32, 0]
    distinct = spark.createDataFrame([([1, 2], 10), ([9, 9], 1), ([8, 9], 1)], "q array<long>, n long")
    assert C.moved(distinct, centroids).tolist() == [[1, 2], [8, 9]]


# packing


def check_packing(found, docs, capacity):
    """Every id has its pieces as the library gives them, and sequences are gapless and not too full."""
    library = Tokenizer.from_file(vocabulary_path(P.VOCABULARY))
    want = []
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        low, piece = 0, 0
        first = len(ids) % capacity if len(ids) > capacity else len(ids)
        while low < len(ids):
            n = first if piece == 0 and first else min(capacity, len(ids) - low)
            want.append((i, piece, low, n, zlib.crc32(np.array(ids[low : low + n], "<u4").tobytes())))
            low, piece = low + n, piece + 1
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(want, key=repr)
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for rows in by_sequence.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence), [n for *_, n, _ in want]


def decreasing(lengths, capacity):
    """Sequences that plain best fit, longest first, needs."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("capacity, seed", [(2048, 1), (100, 2), (16, 3)])
def test_packing_by_brute_force(spark, capacity, seed):
    rng = random.Random(seed)
    words = "one two three four lamp river of and the 17 señor 你好 <|endoftext|>".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 200, 900])))) for i in range(300)]
    rows = P.packed(spark.createDataFrame(docs, "doc_id long, text string"), capacity).collect()
    sequences, lengths = check_packing(rows, docs, capacity)
    assert -(-sum(lengths) // capacity) <= sequences <= decreasing(lengths, capacity) * 1.01 + 1


def test_packing_of_odd_rows(spark):
    df = E.documents(spark, clashing=True).withColumns({n: F.lit(1) for n in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")})
    rows = P.packed(df, 512).collect()
    check_packing(rows, [(r[0], r[1]) for r in E.ROWS], 512)
    assert sorted((r.doc_id, r.piece, r.start, r.sequence_id, r.offset) for r in P.packed(df, 512).collect() if r.doc_id == 5) == sorted((r.doc_id, r.piece, r.start, r.sequence_id, r.offset) for r in rows if r.doc_id == 5)
    none = P.packed(E.empty(spark), 512)
    assert none.count() == 0 and none.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert P.packed(spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string"), 2).select("sequence_id").distinct().count() == 2


def test_sequences_hold_the_ids(spark):
    docs = [(1, "one two three"), (2, "a lamp on the river"), (3, None)]
    out = P.sequences(P.packed(spark.createDataFrame(docs, "doc_id long, text string"), 2048, with_ids=True)).collect()
    library = Tokenizer.from_file(vocabulary_path(P.VOCABULARY))
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    assert len(out) == 1 and out[0].ids == [x for i in out[0].doc_ids for x in want[i]] and out[0].n_tokens == len(out[0].ids)


def test_ids_are_the_library_s():
    """Random texts of all kinds of characters, blanks, contractions, special strings and long words."""
    rng = random.Random(11)
    marks = ["a", "Z", "é", "ß", "\xaa", "\xb2", "7", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "-", "$", "_", "\x00", "ɐ", "你", "🎉", "<|endoftext|>", "the ", "don't "]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["x" * 500 + " " + "y" * 70, "", " ", "\n \n"]
    texts += ["".join(rng.choice(marks[:-7]) for _ in range(40)) for _ in range(3000)]
    library = Tokenizer.from_file(vocabulary_path(P.VOCABULARY))
    want = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in P.token_ids(vocabulary_path(P.VOCABULARY), texts, 0)] == want
    other = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(other)
    assert [np.frombuffer(x, "<u4").tolist() for x in P.token_ids(other, texts, 0)] == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_plan_holds_the_histogram():
    """Any histogram is held exactly, near the least number of sequences; a length may be most of it."""
    rng = np.random.default_rng(3)
    for capacity, n in ((64, 40), (64, 5000), (300, 20000)):
        histogram = np.zeros(capacity + 1, np.int64)
        np.add.at(histogram, np.minimum(capacity, 1 + rng.geometric(0.05, n)), 1)
        histogram[capacity // 3] += n // 2
        groups = P.plan(histogram, capacity)
        held = np.zeros_like(histogram)
        for times, contents in groups:
            assert times > 0 and sum(x * m for x, m in contents) <= capacity
            for x, m in contents:
                held[x] += times * m
        assert (held == histogram).all()
        lengths = np.repeat(np.arange(capacity + 1), histogram)
        assert sum(t for t, _ in groups) <= decreasing(lengths.tolist(), capacity) * 1.01 + 1 or n == 20000
        assert sum(t for t, _ in groups) <= max(-(-lengths.sum() // capacity), (lengths * 2 > capacity).sum()) * 1.03 + 1
        t = P.slots(groups)
        for length in range(1, capacity + 1):  # slots stand end to end over the ranks
            own = t["length"] == length
            assert not own.any() or t["rank"][own][0] == 0


def test_fit_prefers_full_patterns():
    """Halves and quarters of a sequence are fitted by patterns that fill it; nothing is left over."""
    histogram = np.zeros(101, np.int64)
    histogram[[50, 30, 20]] = [1000, 700, 700]
    found = P.patterns(histogram, 100, 0)
    assert found.tolist() == [[50, 50, 0], [50, 30, 20]] or sorted(found.tolist()) == sorted([[50, 50, 0], [50, 30, 20]])
    assert np.allclose(P.fitted(found, histogram, 2000), [150, 700] if found.tolist()[0] == [50, 50, 0] else [700, 150], rtol=0.02)
    assert sum(n for n, _ in P.plan(histogram, 100)) == 850


# filter audit


def plain_audit(docs, labels):
    good, toxic = {i for i, q, t in labels if q == 1}, {i for i, q, t in labels if t == 1}
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": re.search(r"[#$%&*|]", text) is not None, "E": earlier}
        rows.append((part or "", i, {f for f in fails if fails[f]}))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[f] += len(gone)
                failing = sum(f in r[2] for r in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[2] == {f} for r in own), sum(r[1] in good and r[1] is not None for r in gone), sum(r[1] in toxic and r[1] is not None for r in gone)]
        for key in out:
            if key[0] == part:
                out[key] = [*out[key][:6], shapley[key[1][key[2] - 1]]]
    return {k: tuple(v) for k, v in out.items()}


def audit(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({n: F.lit(9) for n in ("part", "bits", "digest", "first", "label", "good", "_id", "step", "quality")})
    rows = A.audited(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Big", "$5", "a&b", "CAPS"]
    texts = [" ".join(rng.choice(words[: rng.choice([40, 404])]) for _ in range(rng.choice([0, 3, 99, 100, 130, 250]))) for _ in range(80)]
    texts += ["CAPS AND MORE " * 40, "x " * 120, "\x1c".join(f"y{i}" for i in range(120))]
    docs = [(i, rng.choice(texts) if i % 3 else texts[0], rng.choice(["en", "de", None, ""])) for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0)]
    assert audit(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_odd_rows(spark):
    docs = [(r[0], r[1], r[2]) for r in E.ROWS] + [(None, "A row without an id but with words.", "en"), (9, "", "es"), (0, None, "es")]
    labels = [(None, 1, 1), (5, 1, None), (5, None, 1), (77, 1, 1)]
    assert audit(spark, docs, labels) == plain_audit(docs, labels)
    assert audit(spark, [], labels) == {} and audit(spark, docs, []) == plain_audit(docs, [])


def test_table_of_first_failures():
    table = A.first_failures()
    assert table.shape == (32, 120) and (table[0] == 0).all()
    assert all(table[31] == 1) and table[1 << A.FILTERS.index("C"), A.ORDERS.index("ABCDE")] == 3
