"""Interaction of document filters: what each filter removes in every order of applying them.

A document's failures of the five filters are five bits. A table, made once for all 32 combinations and all 120 orders,
holds the step at which a document of that combination first fails; so one look-up stands for 120 passes. Tasks count
their documents by part, combination and label, look the combinations up, and add the counts by part, order and step
with ``np.bincount``; their partial arrays are summed by Spark. The rows that move have a fixed size for each part.

Whether a text repeats a smaller id's is decided over the whole table by grouping 256-bit digests, which combine
map-side; only digests that several ids share are joined back.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.llm.common import broadcast_if_small, read, stored

FILTERS = "ABCDE"
#: Words that a text needs, percent of them that must differ, and percent of capitals that it may have.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
MARKS = re.compile(rb"[#$%&*|]")
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
#: Parts whose arrays a task holds at once.
PARTS = 512
#: The labels whose losses are counted.
GOOD, TOXIC = 1, 2


def first_failures() -> np.ndarray:
    """By combination of failures (bit i: filter i) and order: the step of the first failure, from 1, or 0 for none."""
    out = np.zeros((1 << STEPS, len(ORDERS)), np.int64)
    for order, letters in enumerate(ORDERS):
        for step in range(STEPS, 0, -1):
            failing = (np.arange(1 << STEPS) >> FILTERS.index(letters[step - 1])) & 1 == 1
            out[failing, order] = step
    return out


def failures(text: bytes) -> int:
    """The bits of the filters A to D that a text fails; words are split at ASCII white space and compared as they are."""
    words = text.split()
    code = np.frombuffer(text, np.uint8)
    capitals = int(((code >= 65) & (code <= 90)).sum())
    points = int(((code & 0xC0) != 0x80).sum())
    found = (len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * capitals > CAPITALS_PERCENT * points, MARKS.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(found) if failed)


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per row doc_id, part and bits: the filters that it fails, E by the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, digests = [], []
            for value in batch.column(2):  # one text at a time
                text = value.as_py()
                bits.append(failures(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "bits", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = stored(rows.mapInArrow(run, f"doc_id {kind}, part string, bits int, digest binary"), "filter-bits")
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    copies = rows.join(broadcast_if_small(stored(shared, "shared-texts")), "digest", "left")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return copies.select("doc_id", "part", F.when(again, F.col("bits").bitwiseOR(1 << FILTERS.index("E"))).otherwise(F.col("bits")).alias("bits"))


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is an empty one: it fails A and, beside a smaller id with an empty text, E. A null part is "". Rows that
    repeat each count; as their ids are equal, they are no copies of each other, and null ids are neither copies nor
    originals. A document is good or toxic if any of its labels says so; null labels and labels without document take no
    part. Every part that any document has gets all its rows, zeros included; an empty table gives none. Other columns
    take no part. Parts may be as many as documents: a task holds ``PARTS`` of them at once.
    """
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = marked(docs, id_col, text_col, part_col)
    rows = rows.join(said.where("good or toxic"), F.col("doc_id") == F.col("_id"), "left")
    bit = lambda c, n: F.when(F.col(c), F.lit(n)).otherwise(F.lit(0))
    rows = rows.select("part", "bits", (bit("good", GOOD) + bit("toxic", TOXIC)).alias("label"))
    table = first_failures()
    cells, slots = len(ORDERS) * (STEPS + 1), np.arange(len(ORDERS)) * (STEPS + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}  # by part: documents by combination and label

        def flush() -> Iterator[pa.RecordBatch]:
            for part, seen in held.items():
                seen = seen.reshape(1 << STEPS, 4)
                weights = {"removed": seen.sum(1), "good_lost": seen[:, GOOD] + seen[:, GOOD | TOXIC], "toxic_lost": seen[:, TOXIC] + seen[:, GOOD | TOXIC]}
                some = np.flatnonzero(seen.sum(1))
                at = (slots[None, :] + table[some]).ravel()
                lost = {name: np.bincount(at, np.repeat(n[some], len(ORDERS)), cells).astype(np.int64).reshape(-1, STEPS + 1)[:, 1:] for name, n in weights.items()}
                n = weights["removed"]
                fails = np.array([n[(np.arange(1 << STEPS) >> f) & 1 == 1].sum() for f in range(STEPS)])
                alone = np.array([n[1 << f] for f in range(STEPS)])
                letters = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
                size = len(ORDERS) * STEPS
                columns = [np.repeat(np.arange(len(ORDERS)), STEPS), np.tile(np.arange(1, STEPS + 1), len(ORDERS)), np.full(size, n.sum()), fails[letters].ravel(), alone[letters].ravel(), *(lost[name].ravel() for name in weights)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * size, pa.string()), *(pa.array(c.astype(np.int64)) for c in columns)], ["part", "at", "step", "documents", "fails", "unique_fails", *weights])
            held.clear()

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            bits, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            number = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names = parts.dictionary.to_pylist()
            found = np.bincount(number * (4 << STEPS) + bits * 4 + label, minlength=len(names) * (4 << STEPS)).reshape(len(names), -1)
            for part, seen in zip(names, found):
                held[part] = held[part] + seen if part in held else seen
                if len(held) >= PARTS:
                    yield from flush()
        yield from flush()

    sums = ["documents", "fails", "unique_fails", "removed", "good_lost", "toxic_lost"]
    partial = rows.mapInArrow(count, "part string, at long, step long, documents long, fails long, unique_fails long, removed long, good_lost long, toxic_lost long")
    total = partial.groupBy("part", "at", "step").agg(*[F.sum(c).alias(c) for c in sums])
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("at").cast("int") + 1)
    total = total.withColumn("filter_order", order).withColumn("filter", F.substr("filter_order", F.col("step").cast("int"), F.lit(1)))
    gone = F.sum("removed").over(W.partitionBy("part", "at").orderBy("step"))
    shapley = F.sum("removed").over(W.partitionBy("part", "filter"))
    return total.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("documents") - gone).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audited(docs, read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [p.k, q.k, r.k, s.k, t.k] AS letters FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
m AS (SELECT part, letters, step, n, good, toxic, fails[letters[step]] AS failing,
             len(list_filter(letters[1:step - 1], lambda z: fails[z])) > 0 AS before, len(list_filter(fails, lambda z: z)) = 1 AS alone
      FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, letters, step, sum(CASE WHEN NOT before AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN failing AND NOT before THEN n ELSE 0 END) AS removed, sum(CASE WHEN failing AND before THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN failing AND alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN failing AND NOT before AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT before AND toxic THEN n ELSE 0 END) AS toxic_lost
      FROM m GROUP BY part, letters, step)
SELECT part, array_to_string(list_transform(letters, lambda z: chr((64 + z)::INT)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letters[step]))::BIGINT AS shapley FROM r
"""
