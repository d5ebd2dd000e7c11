"""Centroid clustering by weighted deduplication.

Vectors are quantised to integers; identical ones are grouped, with the number of times they stand in the table. Lloyd
runs over the distinct vectors only: each task assigns its vectors and adds up, for every centroid, their components
times their multiplicity. These partial sums (``k`` rows of ``dim`` numbers for each task) are summed by Spark, so what
reaches the driver has ``k * dim`` numbers whatever the table. At the end each distinct vector has its cluster, which is
joined back to all rows that hold it.

All arithmetic is in integers, so the result does not depend on the order of execution.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.llm.common import read, stored

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1:"
#: Vectors that are held against the centroids at once.
BLOCK = 4096
#: float64 holds every integer up to here.
EXACT = 2**53


def quantised(embedding: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, or null where the vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) == dim) & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller number) and the squared distance to it, both exact."""
    most = max(float(np.abs(vectors).max(initial=0)), float(np.abs(centroids).max(initial=0)))
    if 4 * vectors.shape[1] * most * most < EXACT:
        # every partial sum is an integer that float64 holds, so the products of BLAS are exact
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        distance = ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    else:
        distance = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)
    at = distance.argmin(1)
    return at, distance[np.arange(len(at)), at]


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(vectors, cluster, distance, batch) of batches whose first column is q, in blocks of bounded size."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            vectors = matrix_of(part.column(0), centroids.shape[1])
            yield (vectors, *nearest(vectors, centroids), part)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round of Lloyd: floor(sum / count) of the vectors of each centroid, by multiplicity; empty ones stay."""
    k, dim = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for vectors, at, _, part in assigned(batches, centroids):
            n = part.column(1).to_numpy(zero_copy_only=False)
            for c in np.unique(at):
                own = at == c
                sums[c] += n[own] @ vectors[own]
                counts[c] += n[own].sum()
        some = np.flatnonzero(counts)
        where, place = np.repeat(some, dim + 1), np.tile(np.arange(dim + 1), len(some))
        values = np.concatenate([sums[some], counts[some, None]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(place), pa.array(values)], ["cluster", "at", "value"])

    partial = distinct.select("q", "n").mapInArrow(add_up, "cluster long, at long, value long")
    total = np.zeros((k, dim + 1), object)
    for cluster, at, value in partial.groupBy("cluster", "at").agg(F.sum("value").alias("value")).collect():  # k * (dim + 1) rows at most
        total[cluster, at] = value
    out = centroids.copy()
    for c in range(k):
        if total[c, dim]:
            out[c] = [s // total[c, dim] for s in total[c, :dim]]
    return out


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors of the ``k`` ids of smallest hash, in the order of the hashes; equal hashes in the order of the vectors."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    return [list(r[0]) for r in rows.orderBy(order.asc_nulls_last(), "q").select("q").limit(k).collect()]


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Per vector vec_id, cluster, distance (squared), cluster_inertia and inertia; and the centroids, one row for each.

    Vectors that are null, of another dimension, or hold null or non-finite components take no part. Rows that repeat
    each give a row and count as often as they stand; a null id may be in a cluster but, like any id, starts one only if
    too few others are there. Equal start vectors leave the later centroid empty, and it stays. With fewer than ``k``
    vectors there are as many centroids; an empty table gives no rows and no centroids. Squared distances and their sums
    must fit in 64 bits; other columns take no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), dim, scale).alias("q")).where("q is not null")
    rows = stored(rows, "vectors")
    distinct = stored(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "vectors-distinct")
    centroids = np.array(first_centroids(rows, k, seed), np.int64).reshape(-1, dim)
    schema = "q array<long>, n long, cluster int, distance long"
    if not len(centroids):
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"
        return vectors.sparkSession.createDataFrame([], none), centroids
    for _ in range(rounds):
        centroids = moved(distinct, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at, distance, part in assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32)), pa.array(distance)], ["q", "n", "cluster", "distance"])

    placed = stored(distinct.mapInArrow(assign, schema), "vectors-clusters")
    totals = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("inertia")).collect()}
    own = F.element_at(F.array(*[F.lit(totals.get(c, 0)).cast("long") for c in range(len(centroids))]), F.col("cluster") + 1)
    out = rows.join(placed, "q").select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia"))
    return out, centroids


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = clustered(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digests = F.array(*[F.lit(digest(c)) for c in centroids]) if len(centroids) else F.array(F.lit(""))
    return out.withColumn("centroid_sha256", F.element_at(digests, F.col("cluster") + 1))


def clusters_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> str:
    """DuckDB SQL that holds every row against every centroid, round by round."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS (SELECT row, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
  SELECT v.row, m.c, list_sum(list_transform(list_zip(v.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, m{n} m) GROUP BY row)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT a.c, unnest(v.q) AS x, unnest(range({dim})) AS i FROM v JOIN a{n} a USING (row)) GROUP BY c, i),
n{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{n} GROUP BY c),
m{n + 1} AS (SELECT m.c, coalesce(t.q, m.q) AS q FROM m{n} m LEFT JOIN n{n} t USING (c))""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS (SELECT c - 1 AS c, q FROM (SELECT q, row_number() OVER (ORDER BY sha256('{seed}' || vec_id::VARCHAR) NULLS LAST, q) AS c FROM v) WHERE c <= {k}),
{",".join(steps)},
i AS (SELECT c, sum(d)::BIGINT AS own FROM a{rounds} GROUP BY c)
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, i.own AS cluster_inertia, (SELECT sum(own)::BIGINT FROM i) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (row) JOIN i USING (c) JOIN m{rounds} m USING (c)
"""


OP11_SQL = clusters_sql()
