"""Ordered batch algebra: frames whose row order is the explicit column ``pos`` (0-based, dense)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.operators.groups import numbered

POS = "pos"


def indexed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add a dense ``pos`` in the given total order of columns."""
    return numbered(df, order, POS).select("*", F.col(POS).cast("long").alias("_pos")).drop(POS).withColumnRenamed("_pos", POS)


def selected(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Known columns of a list; unknown names are passed over."""
    return df.select(*[c for c in columns if c in df.columns])


def popped(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the columns with pos, the rest)."""
    return df.select(POS, *columns), df.drop(*columns)


def renamed(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def taken(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows at the positions ``index`` (at, pos), which may repeat and reorder; pos is that of the index."""
    return index.select(F.col("at").alias("_at"), F.col(POS).alias("_new")).join(df, F.col("_at") == F.col(POS)).drop("_at", POS).withColumnRenamed("_new", POS)


def sliced(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    out = df.where(F.col(POS) >= start)
    if stop is not None:
        out = out.where(F.col(POS) < stop)
    return out.where((F.col(POS) - start) % step == 0).withColumn(POS, ((F.col(POS) - start) / step).cast("long"))


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Column-wise union by position. Shared columns must agree; a conflict fails the query when it is read."""
    shared = [c for c in b.columns if c in a.columns and c != POS]
    right = b.select(POS, *[F.col(c).alias(f"_r_{c}") for c in b.columns if c != POS])
    both = a.join(right, POS, "full_outer")
    for c in shared:
        both = both.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs between the two batches"))))
    return both.select(*a.columns, *[F.col(f"_r_{c}").alias(c) for c in b.columns if c not in a.columns])


def concatenated(*frames: DataFrame) -> DataFrame:
    """Frames one after the other; missing columns become NULL."""
    out, offset = None, 0
    for df in frames:
        moved = df.withColumn(POS, F.col(POS) + offset)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        offset += df.count()
    return out


def aligned_union(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns, NULL where the frame has none."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])


def chunked(df: DataFrame, chunks: int, n: int | None = None) -> DataFrame:
    """Column ``chunk`` of equal parts; the number of rows must be a multiple."""
    n = df.count() if n is None else n
    if n % chunks:
        raise ValueError(f"{n} rows do not make {chunks} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(POS) / max(1, n // chunks)).cast("int"))


def split(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(POS) / size).cast("int"))


def repeated(df: DataFrame, times: int, interleave: bool = True, n: int | None = None) -> DataFrame:
    """Each row ``times`` times: aabb if interleaved, else abab."""
    copies = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    place = F.col(POS) * times + F.col("_k") if interleave else F.col("_k") * (df.count() if n is None else n) + F.col(POS)
    return copies.withColumn(POS, place).drop("_k")


def padded(df: DataFrame, divisor: int) -> tuple[DataFrame, int]:
    """Rows up to a multiple of the divisor, read again from the start, and how many were added."""
    n = df.count()
    pad = -n % divisor
    if not pad or not n:
        return df, 0
    rounds = -(-pad // n)
    extra = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(POS, F.col(POS) + F.col("_k") * n).where(F.col(POS) < n + pad).drop("_k")
    return df.unionByName(extra), pad


def unpadded(df: DataFrame, pad: int) -> DataFrame:
    return df.where(F.col(POS) < df.count() - pad) if pad else df


def folded(df: DataFrame, rows: int) -> DataFrame:
    """``rows`` rows, each an array of structs of as many neighbours."""
    n = df.count()
    if n % rows:
        raise ValueError(f"{n} rows do not fold into {rows}")
    item = F.struct(POS, *[c for c in df.columns if c != POS])
    return df.groupBy(F.floor(F.col(POS) / (n // rows)).cast("long").alias("fold")).agg(F.sort_array(F.collect_list(item)).alias("rows")).withColumnRenamed("fold", POS)


def _grid(n: int) -> tuple[int, int]:
    """Two factors near the root of ``n`` whose product is ``n`` or little more."""
    root = max(1, math.isqrt(n))
    return min(((a, -(-n // a)) for a in range(max(1, root - 64), root + 65)), key=lambda f: (f[0] * f[1], f[0]))


def permuted(pos: Column, n: int, *seed: Column) -> Column:
    """A bijection of the positions 0 to n - 1, another for each seed: four rounds of a Feistel network over a grid of
    about n cells, walked on where it leaves the positions. A walk is no longer than the cells beyond n, and 64 steps."""
    a, b = _grid(n)

    def mixed(at: Column) -> Column:
        left, right = F.floor(at / b).cast("long"), F.pmod(at, F.lit(b))
        for turn in range(4):
            if turn % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(*seed, F.lit(turn), left), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(*seed, F.lit(turn), right), F.lit(a)), F.lit(a))
        return left * b + right

    first = mixed(pos.cast("long"))
    beyond = a * b - n
    return first if not beyond else F.aggregate(F.sequence(F.lit(1), F.lit(min(beyond, 64))), first, lambda at, _: F.when(at >= n, mixed(at)).otherwise(at))


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None, n: int | None = None) -> DataFrame:
    """Columns epoch and batch: every epoch deals all ``n`` rows (counted if not given), as they stand or, if seeded, by a
    permutation of their positions of its own. Only arithmetic on pos: nothing is sorted or moved."""
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is None:
        place = F.col(POS)
    else:
        n = df.count() if n is None else n
        place = permuted(F.col(POS), max(n, 1), F.lit(seed), F.col("epoch"))
    return each.withColumn("batch", F.floor(place / size).cast("int"))


def largest_differencing(lengths: Sequence[int], parts: int, equal: bool) -> list[list[int]]:
    """Index sets of near equal sums by repeatedly merging the two most uneven partial partitions."""
    if equal and len(lengths) % parts:
        raise ValueError("equal parts need a multiple of their number")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    states: list[list[tuple[int, list[int]]]] = []
    if equal:
        for at in range(0, len(order), parts):
            states.append(sorted(((lengths[i], [i]) for i in order[at : at + parts]), key=lambda s: -s[0]))
    else:
        states = [[(lengths[i], [i])] + [(0, [])] * (parts - 1) for i in order]
    heap = [(-(s[0][0] - s[-1][0]), n, s) for n, s in enumerate(states)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda s: -s[0])
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), serial, merged))
        serial += 1
    return [sorted(s[1]) for s in heap[0][2]] if heap else [[] for _ in range(parts)]


def greedy_parts(lengths: Sequence[int], parts: int, equal: bool) -> list[list[int]]:
    """Each index in turn to the part of the smallest sum (of those that are not full)."""
    if equal and len(lengths) % parts:
        raise ValueError("equal parts need a multiple of their number")
    full = len(lengths) // parts if equal else len(lengths)
    sums, out = [0] * parts, [[] for _ in range(parts)]
    for i, x in enumerate(lengths):
        p = min((q for q in range(parts) if len(out[q]) < full or not equal), key=lambda q: (sums[q], q))
        sums[p] += x
        out[p].append(i)
    return [sorted(x) for x in out]


def balanced(df: DataFrame, batch: str, length: str, parts: int, equal: bool = True) -> DataFrame:
    """Column ``part``: rows of each batch dealt into parts of near equal total length, and of equal size but for one row.

    Rows stand in descending length and are dealt in rounds of one row for each part. Rounds inside one length are even
    whoever gets what; only those over several lengths, fewer than the lengths of the batch, are set against each other by
    largest differencing. What a task gathers is the histogram of a batch's lengths, never its rows. No two parts differ by
    more than the largest length. Null lengths count as 0. With ``equal`` the rows must be a multiple of ``parts``.
    """
    rows = df.withColumn("_length", F.coalesce(F.col(length).cast("long"), F.lit(0)))
    if equal and not rows.groupBy(batch).count().where(F.col("count") % parts != 0).isEmpty():
        raise ValueError("equal parts need a multiple of their number")
    histogram = rows.groupBy(batch, "_length").agg(F.count(F.lit(1)).alias("_n"))
    kind = df.schema[batch].dataType.simpleString()

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_length", ascending=False)
        lengths, ends = group["_length"].to_numpy(), group["_n"].cumsum().to_numpy()
        n = int(ends[-1])
        # the rounds in which one length ends and another follows, and the last, filled up with nothing
        mixed = sorted({int(e) // parts for e in ends[:-1] if e % parts} | ({n // parts} if n % parts else set()))
        taken = [int(lengths[min(int(np.searchsorted(ends, r, side="right")), len(ends) - 1)]) if r < n else 0 for m in mixed for r in range(m * parts, (m + 1) * parts)]
        out: list[tuple[int, int, int]] = []
        for p, members in enumerate(largest_differencing(taken, parts, True) if mixed else []):
            out += [(mixed[i // parts], i % parts, p) for i in members]
        frame = pd.DataFrame(out, columns=["_round", "_slot", "_part"])
        frame.insert(0, batch, group[batch].iloc[0])
        return frame

    dealt = histogram.groupBy(batch).applyInPandas(deal, f"{batch} {kind}, _round long, _slot long, _part int")
    placed = numbered(rows.withColumn("_least", -F.col("_length")), [batch, "_least", POS], "_at")
    first = placed.groupBy(batch).agg(F.min("_at").alias("_first"))
    rank = F.col("_at") - F.col("_first")
    placed = placed.join(first, batch).withColumns({"_round": F.floor(rank / parts).cast("long"), "_slot": F.pmod(rank, F.lit(parts)).cast("long")})
    out = placed.join(dealt, [batch, "_round", "_slot"], "left").withColumn("part", F.coalesce("_part", F.col("_slot").cast("int")))
    return out.select(*df.columns, "part")


def micro_batches(df: DataFrame, batch: str, length: str, most: int) -> DataFrame:
    """Column ``micro``: each batch in as few balanced parts as keep total / most, heaviest (sum of squares) first."""

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(POS).reset_index(drop=True)
        lengths = [int(x) for x in group[length]]
        k = min(len(lengths), max(1, -(-sum(lengths) // most)))
        parts = sorted(largest_differencing(lengths, k, False), key=lambda rows: -sum(lengths[i] ** 2 for i in rows))
        micro = [0] * len(group)
        for p, rows in enumerate(parts):
            for i in rows:
                micro[i] = p
        return group[[batch, POS]].assign(micro=micro)

    kind = df.schema[batch].dataType.simpleString()
    return df.join(df.select(batch, POS, length).groupBy(batch).applyInPandas(deal, f"{batch} {kind}, {POS} long, micro int"), [batch, POS])


def part_sums(df: DataFrame, part: str, length: str) -> DataFrame:
    """Least, largest and mean total length of the parts."""
    return df.groupBy(part).agg(F.sum(length).alias("total")).agg(F.min("total").alias("min"), F.max("total").alias("max"), F.avg("total").alias("mean"))


def accumulated(groups: DataFrame, order: str, kept: str, target: int, most: int) -> DataFrame:
    """Batches (order, kept) in turn until ``target`` groups are kept or ``most`` batches are used: the batches used."""
    w = W.partitionBy(F.lit(0)).orderBy(order)  # one row for each generated batch
    before = F.coalesce(F.sum(kept).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumns({"_before": before, "_n": F.row_number().over(w)}).where((F.col("_before") < target) & (F.col("_n") <= most)).withColumn("used", F.least(F.col(kept), target - F.col("_before"))).drop("_before", "_n")


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """A function of pandas frames over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(run, schema)
