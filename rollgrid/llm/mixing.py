"""Mixing sources to target weights by systematic sampling.

Every source gets a target of words; each of its documents is expected ratio = target / source size times. In a fixed
order within the source (by size, then by hash) the expected copies are prefix-summed, one offset drawn from the
source's name is added, and a document is emitted once for each integer that its interval crosses. As documents of
like size stand together, the words taken miss the target by little more than one large document.

The prefix sum never gathers a source in one task. Documents are dealt into ordered buckets within their source: size
class, hash class, and as many leading bits of their hash as keep the buckets near ``BUCKET`` documents, by their counted
sizes. Buckets are summed map-side; one window adds up the size classes of a source, one the buckets of a class, and one
runs inside each bucket. All sums are integers in units of 2**-24 copies, so reruns agree whatever the order of execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.llm.common import read, small, stored

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
UNIT = 1 << 24
HASH_CLASSES = 64
#: Documents in a bucket, about; and sources, which one task orders.
BUCKET, SOURCES = 100_000, 100_000
#: Bits of the place of a document inside its hash class.
PLACE_BITS = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Bit length and the five leading bits: classes some 6 % wide, in the order of sizes."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 5, F.lit(0))
    return bits * 32 + F.call_function("shiftright", size, shift).cast("int")


def hex_number(text: Column, start: int, digits: int) -> Column:
    """The number that ``digits`` hex digits of the text's MD5 spell."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """Water-filling of (source, source_size): a target in proportion to the weight, at most ``most`` times the size.

    Sources stand by code point, null last, and take the weights in turn. The level is where the shares of the sources
    below their cap use up what the capped ones leave. One row for each source goes through a single window.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = W.partitionBy(F.lit(0))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    return (
        sources.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("budget", F.floor(F.sum("source_size").over(everything) * F.lit(share_percent)) / F.lit(100.0))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("found", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, 0)))
        .select("source", "source_size", F.least(F.coalesce(F.col("found") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "", carry: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken (words, repeats counted); with ``carry`` also row,
    a struct of all its columns.

    ``seed`` draws other offsets; one seed always gives the same mix. A null text has size 0, and a null source is a
    source of its own, last in order. Empty documents get copies like any other and take no words. Rows that share an
    id stand next to each other in order and each get copies of their own; an empty table gives an empty table; other
    columns take no part. More than ``SOURCES`` sources are refused.
    """
    name = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))
    kept = [F.struct(*docs.columns).alias("row")] if carry else []
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("ident"), *kept)
    hash_class = F.pmod(hex_number(F.col("ident"), 1, 4), F.lit(HASH_CLASSES))
    sized = sized.select("doc_id", "source", "size", name.alias("name"), size_class(F.col("size")).alias("size_class"), hash_class.alias("hash_class"), hex_number(F.col("ident"), 5, 12).alias("place"), *(["row"] if carry else []))
    sized = stored(sized, "mix-sizes")

    def bucketed(bits: int) -> tuple[DataFrame, DataFrame]:
        part = sized.withColumn("part", F.shiftright("place", PLACE_BITS - bits) if bits else F.lit(0).cast("long"))
        counts = part.groupBy("name", "source", "size_class", "hash_class", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bucket_size"))
        return part, stored(counts, "mix-buckets")

    parts, buckets = bucketed(0)
    largest = buckets.agg(F.max("n")).first()[0] or 0
    if largest > BUCKET:
        parts, buckets = bucketed(min(PLACE_BITS, math.ceil(math.log2(largest / BUCKET))))
    sources = stored(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), "mix-sources")
    if not small(sources, SOURCES):
        raise ValueError(f"more than {SOURCES} sources")
    plan = targets(sources, weights, share_percent, most)
    offset = F.pmod(hex_number(F.concat(F.lit(seed), name), 1, 8), F.lit(UNIT))
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.lit(UNIT) / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stored(plan.select(name.alias("name"), "source_size", "target", ratio.alias("expected"), offset.alias("offset")), "mix-plan")

    # what stands before each size class of a source, and before each bucket of a class
    before = W.partitionBy("name").orderBy(F.col("size_class").desc()).rowsBetween(W.unboundedPreceding, -1)
    classes = buckets.groupBy("name", "size_class").agg(F.sum("n").alias("n")).select("name", "size_class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    order = W.partitionBy("name", "size_class").orderBy("hash_class", "part").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("above") + F.coalesce(F.sum("n").over(order), F.lit(0))
    # the last join and the last window share their keys, and so one exchange of the documents' sizes
    keys = ["name", "size_class", "hash_class", "part"]
    starts = buckets.join(classes, ["name", "size_class"]).withColumn("ahead", ahead).join(F.broadcast(plan), "name")
    starts = starts.select(*keys, "source_size", "target", "expected", (F.col("offset") + F.col("ahead") * F.col("expected")).alias("start"))
    bucket = W.partitionBy(*keys).orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    joined = parts.join(stored(starts, "mix-starts"), keys)
    end = F.col("start") + F.sum("expected").over(bucket)
    edges = joined.select("doc_id", "size", "source_size", "target", F.shiftright(end, 24).alias("end"), F.shiftright(end - F.col("expected"), 24).alias("begin"), *(["row"] if carry else []))
    copies = F.col("end") - F.col("begin")
    return edges.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is emitted, with all its columns. Edge cases are those of ``mix``."""
    out = mix(docs, **options, carry=True).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("copies")


def mix_sql(docs: str) -> str:
    """DuckDB SQL for ``mix`` over the relation ``docs`` (doc_id, text, source)."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS h FROM {docs}),
keyed AS (
  SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS size_class,
         ('0x' || substr(h, 1, 4))::BIGINT % 64 AS hash_class, ('0x' || substr(h, 5, 12))::BIGINT AS place FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2 * source_size AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sources),
filling AS (
  SELECT *, (floor((sum(source_size) OVER () * 150)::DOUBLE) / 100.0::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE)) AS level
  FROM weighed),
levelled AS (
  SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS)
         OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS found FROM filling),
plan AS (
  SELECT source, source_size, least(coalesce(found * weight, cap::DOUBLE), cap::DOUBLE) AS target,
         ('0x' || substr(md5(coalesce('s:' || source, 'null')), 1, 8))::BIGINT % 16777216 AS off FROM levelled),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * 16777216::DOUBLE / source_size)::BIGINT ELSE 0 END AS expected FROM plan),
summed AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, r.expected,
         r.off + (sum(r.expected) OVER (PARTITION BY k.source ORDER BY size_class DESC, hash_class, place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS hi
  FROM keyed k JOIN rated r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (((hi >> 24) - ((hi - expected) >> 24)) * size)::BIGINT AS taken FROM summed
"""


OP7_SQL = mix_sql("documents")
