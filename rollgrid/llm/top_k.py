"""Exact top-k inner products over vectors in the order of their length.

For every query the longest vectors of all (a fixed number) give a first threshold: the k-th best score so far. A query
needs no vector that is shorter than its threshold divided by its own norm (Cauchy-Schwarz). Queries of like needs make
query blocks, so that one weak query does not open all vectors to the others.

Vectors are sorted by descending norm and packed into small rows. Each row goes to the query blocks whose need its
longest vector meets, and is streamed there in descending norm, so the thresholds carry on from row to row and the
rest of the stream is passed over as soon as it is too short. A query block is sent once for each stream; a stream of
more than ``STREAM`` vectors is split, each part from the longest vectors on.

Inside a stream inner products are summed over the leading coordinates after a rotation by the singular vectors of the
whole table, and the residual norms bound what the other coordinates can add. Survivors are scored with integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.llm.common import read, stored

K = 5
EVERY = 50
SCALE = 256
SLICE = 512
SEEDS = 4096
#: Bytes of the vectors in one packed row, so that a batch of rows fits in memory whatever the dimension.
ROW_BYTES = 8192
#: Queries in a block at least (it grows so that there are at most about BLOCKS of them), and vectors in a stream.
QUERIES, BLOCKS, STREAM = 8192, 50_000, 250_000
#: Classes of needs in each power of two.
CLASSES = 8
#: Queries that are held against a slice at once.
LIVE = 8192
#: Share of the coordinates in the partial sums.
LEADING = 0.375
#: float64 holds every integer up to here.
EXACT = 2**53


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of every component, or null where the vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE)))


def as_bytes(matrix: np.ndarray) -> bytes:
    """Integers as 32 bits where all fit, else as 64."""
    fits = not matrix.size or (matrix.min() >= -(2**31) and matrix.max() < 2**31)
    return matrix.astype(np.int32 if fits else np.int64).tobytes()


def unpack(dim: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    kind = np.int32 if len(vectors) == 4 * dim * len(names) else np.int64
    return names, np.frombuffer(vectors, kind).reshape(-1, dim)


def matrix_of(column: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of neighbours of equal ``keys`` and dimension, ROW_BYTES of vectors each: the keys, dim, longest (norm),
    ids, vectors and floors. ``rows`` has the keys, vec_id, q, norm, dim and floor and is sorted in its partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(n).to_numpy(zero_copy_only=False) for n in range(len(keys))]
            ids, norms, dims, floors = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("vec_id", "norm", "dim", "floor"))
            q = batch.column("q")
            new = np.zeros(len(ids), bool)
            for mark in (*marks, dims):
                new[1:] |= mark[1:] != mark[:-1]
            begins = np.flatnonzero(new).tolist()
            out: list[list] = [[] for _ in range(len(keys) + 6)]
            for low, high in zip([0, *begins], [*begins, len(ids)]):
                dim = int(dims[low])
                step = max(1, ROW_BYTES // (4 * dim))
                matrix = matrix_of(q, np.arange(low, high), dim)
                for cut in range(low, high, step):
                    end = min(cut + step, high)
                    values = [*(int(m[cut]) for m in marks), number, dim, float(norms[cut:end].max()), ids[cut:end].astype(np.int64).tobytes(), as_bytes(matrix[cut - low : end - low]), floors[cut:end].astype(np.float64).tobytes()]
                    number += 1
                    for column, value in zip(out, values):
                        column.append(value)
            types = [*[pa.int64()] * (len(keys) + 1), pa.int32(), pa.float64(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], [*keys, "number", "dim", "longest", "ids", "vectors", "floors"])

    schema = ", ".join([*(f"{k} long" for k in keys), "number long, dim int, longest double, ids binary, vectors binary, floors binary"])
    return rows.select(*[F.col(k).cast("long").alias(k) for k in keys], "vec_id", "q", "norm", "dim", "floor").mapInArrow(pack, schema)


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension, the right singular vectors of all its vectors, from their summed Gram matrix (dim * dim numbers)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                m = matrix_of(batch.column(0), at, dim).astype(np.float64)
                sums[int(dim)] = sums.get(int(dim), 0) + m.T @ m
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim * dim, dim, np.int32)), pa.array(np.arange(dim * dim, dtype=np.int64)), pa.array(s.ravel())], ["dim", "at", "value"])

    summed = vectors.select("q", "dim").mapInArrow(gram, "dim int, at long, value double").groupBy("dim", "at").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    rows = summed.toPandas()
    for dim, group in rows.groupby("dim"):
        s = np.zeros(dim * dim)
        s[group["at"].to_numpy()] = group["value"].to_numpy()
        out[int(dim)] = np.linalg.eigh(s.reshape(dim, dim))[1][:, ::-1]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b, as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(k: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Search:
    """Top-k of the queries of a block over vectors that come in slices of descending norm."""

    def __init__(self, k: int, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, rotation: np.ndarray):
        self.k, self.ids, self.vectors, self.floor = k, ids, vectors, floor.astype(np.float64).copy()
        self.rotation, self.lead = rotation, max(1, int(rotation.shape[0] * LEADING))
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        turned = vectors.astype(np.float64) @ rotation
        self.front, self.rest = turned[:, : self.lead], np.sqrt((turned[:, self.lead :] ** 2).sum(1))
        self.found_ids: list[np.ndarray] = [np.empty(0, np.int64) for _ in ids]
        self.found: list[np.ndarray] = [np.empty(0, np.int64) for _ in ids]
        self.scored = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> bool:
        """Take vectors in descending norm; whether shorter ones can still matter."""
        for cut in range(0, len(ids), SLICE):
            i, v = ids[cut : cut + SLICE], vectors[cut : cut + SLICE]
            norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            slack = 1e-9 * self.norms * norms.max(initial=0) + 1e-6
            live = np.flatnonzero(self.norms * norms.max(initial=0) + slack >= self.floor)
            if not live.size:
                return False
            turned = v.astype(np.float64) @ self.rotation
            rest = np.sqrt((turned[:, self.lead :] ** 2).sum(1))
            for low in range(0, len(live), LIVE):
                self._meet(live[low : low + LIVE], slack, i, v, turned, rest)
        return True

    def _meet(self, live: np.ndarray, slack: np.ndarray, i: np.ndarray, v: np.ndarray, turned: np.ndarray, rest: np.ndarray) -> None:
        bound = self.front[live] @ turned[:, : self.lead].T + self.rest[live, None] * rest[None, :]
        possible = bound + slack[live, None] >= self.floor[live, None]
        possible &= i[None, :] != self.ids[live, None]
        rows, columns = np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))
        if not rows.size:
            return
        self.scored += int(possible.sum())
        exact = products(self.vectors[live[rows]], v[columns])
        allowed = possible[np.ix_(rows, columns)]
        for r, q in enumerate(live[rows]):
            at = np.flatnonzero(allowed[r])
            scores = np.concatenate([self.found[q], exact[r, at]])
            names = np.concatenate([self.found_ids[q], i[columns[at]]])
            top = best(self.k, scores, names)
            self.found[q], self.found_ids[q] = scores[top], names[top]
            if len(top) == self.k:
                self.floor[q] = max(self.floor[q], float(scores[top[-1]]))

    def results(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.found]
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, sizes)), pa.array(np.concatenate([*self.found_ids, none])), pa.array(np.concatenate([*self.found, none]))], ["query_id", "vec_id", "score"])


def longest(table: DataFrame, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``n`` longest vectors of a dimension, equal ones in the order of their ids."""
    rows = table.where(F.col("dim") == dim).orderBy(F.col("norm").desc(), "vec_id").limit(n).select("vec_id", "q").toArrow().combine_chunks()
    return rows.column("vec_id").to_numpy(), matrix_of(rows.column("q").combine_chunks(), np.arange(rows.num_rows), dim)


def block_plan(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(dim, class, first block, blocks) for counted classes (dim, class, queries): neighbouring classes share blocks
    of about QUERIES queries, or as many more as keep the blocks within about BLOCKS, and large classes are split."""
    size = max(QUERIES, sum(n for *_, n in counts) // BLOCKS)
    out, number = [], 0
    group: list[tuple[int, int, int]] = []
    for row in [*sorted(counts, reverse=True), None]:
        if group and (row is None or row[0] != group[0][0] or sum(n for *_, n in group) >= size):
            parts = math.ceil(sum(n for *_, n in group) / size)
            out += [(dim, kind, number, parts) for dim, kind, _ in group]
            number, group = number + parts, []
        if row is not None:
            group.append(row)
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every row that satisfies ``queries`` with every other row.

    Returns query_id, rank (from 1), vec_id, score. Vectors that are null or empty or hold null or non-finite
    components take no part, nor do rows without id; only vectors of one dimension meet. Equal rows count once, and
    rows that share a query's id are its own. Fewer rows give fewer results; an empty table gives none. Scores must
    fit in 64 bits; other columns take no part.
    """
    spark = vectors.sparkSession
    table = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("q"), queries.alias("is_query")).where("vec_id is not null and q is not null").distinct()
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    table = stored(table.select("vec_id", "q", "is_query", norm.alias("norm"), F.size("q").alias("dim")), "vectors")
    turn = rotations(table)
    # the longest vectors of each dimension: a fixed number, of which each task keeps its own best before anything moves
    seeds = {dim: longest(table, dim, SEEDS) for dim in turn}
    shared = spark.sparkContext.broadcast((turn, seeds))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, seeds = shared.value
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(zero_copy_only=False), np.empty(batch.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                search = Search(k, batch.column("vec_id").to_numpy(zero_copy_only=False)[at], matrix_of(batch.column("q"), at, dim), np.full(len(at), -np.inf), turn[int(dim)])
                search.add(*seeds[int(dim)])
                out[at] = search.floor
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "floor"])

    asked = table.where("is_query").select("vec_id", "q", "norm", "dim").mapInArrow(floors, "vec_id long, q array<long>, norm double, dim int, floor double")
    # the shortest vector that may still matter; a query with an open threshold has to see every vector
    need = F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).when(F.col("floor") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    kind = F.when(F.col("need") > 0, F.floor(F.log2(F.least("need", F.lit(1e300))) * CLASSES)).otherwise(F.lit(-(2**40))).cast("long")
    asked = stored(asked.withColumn("need", need).withColumn("kind", kind), "queries")
    sizes = {r["dim"]: r["n"] for r in table.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = block_plan([tuple(r) for r in asked.groupBy("dim", "kind").count().collect()])
    plan = spark.createDataFrame(plan, "dim int, kind long, first long, parts long")
    asked = asked.join(F.broadcast(plan), ["dim", "kind"]).withColumn("qblock", F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts"))
    streams = spark.createDataFrame([(dim, max(1, math.ceil(n / STREAM))) for dim, n in sizes.items()], "dim int, streams int")
    wanted = stored(asked.groupBy("qblock", "dim").agg(F.min("need").alias("least")).join(F.broadcast(streams), "dim"), "query-blocks")
    questions = packed(asked.repartition("qblock").sortWithinPartitions("qblock"), ["qblock"])
    questions = questions.join(F.broadcast(streams), "dim").select("qblock", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), F.lit(0).alias("turn"), "dim", "longest", "ids", "vectors", "floors")

    ordered = table.select("vec_id", "q", "norm", "dim", F.lit(0.0).alias("floor")).repartitionByRange(F.col("norm").desc(), "vec_id").sortWithinPartitions("dim", F.col("norm").desc(), "vec_id")
    blocks = packed(ordered.withColumn("part", F.spark_partition_id()), ["part"])
    # the query blocks are at most about BLOCKS and some for each class; rows go where their longest vector may serve
    met = blocks.join(F.broadcast(wanted), "dim").where(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least"))
    met = met.select("qblock", F.pmod(F.col("part") + F.col("number"), "streams").cast("int").alias("stream"), F.lit(1).alias("turn"), "dim", "longest", "ids", "vectors", F.lit(b"").alias("floors"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = shared.value
        key, hunt, going = None, None, True
        parts: list[tuple] = []

        def take() -> None:
            """Give the collected rows to the search: queries at first, then vectors."""
            nonlocal hunt, going
            if not parts:
                return
            names, found = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            if hunt is None:
                hunt = Search(k, names, found, np.concatenate([p[2] for p in parts]), turn[found.shape[1]])
            else:
                going = hunt.add(names, found)
            parts.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                block, stream, rank, dim = (batch.column(n)[i].as_py() for n in range(4))
                if (block, stream) != key:
                    take()
                    if hunt is not None:
                        yield hunt.results()
                    key, hunt, going = (block, stream), None, True
                if rank and hunt is None:
                    take()
                if going:
                    parts.append((*unpack(dim, batch.column("ids")[i].as_py(), batch.column("vectors")[i].as_py()), np.frombuffer(batch.column("floors")[i].as_py(), np.float64)))
                    if rank and sum(len(p[0]) for p in parts) >= SLICE:
                        take()
        take()
        if hunt is not None:
            yield hunt.results()

    rows = questions.unionByName(met).repartition("qblock", "stream").sortWithinPartitions("qblock", "stream", "turn", F.col("longest").desc())
    found = rows.mapInArrow(search, "query_id long, vec_id long, score long").where("query_id <> vec_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.pmod("vec_id", F.lit(EVERY)) == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
