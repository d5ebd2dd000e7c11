"""Line deduplication over levelled sorted runs of line hashes.

Documents are dealt into batches. Each batch counts, for each line key, the documents that hold it; keys that the
runs have already settled (enough documents) are merge-anti-joined away, and the rest is added as a sorted run of
level 0. When a level has ``fanout`` runs they are compacted into one run of the next level, and keys that reach the
threshold there become settled. At the end all runs meet in one last compaction, which gives the settled keys.

Runs are tables bucketed by the hash and sorted inside the buckets, all into the same number of buckets, so a run meets a batch,
and runs meet in a compaction, bucket by bucket without being shuffled again. The number of batches follows the number
of documents.

Everything is DataFrame code. Lines are exploded only as 128-bit hashes with their position, a line held by a third
of all documents is summed map-side before each shuffle, and the settled keys are broadcast only if their counted
number is small; otherwise the join shuffles and adaptive execution splits the hot keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.llm.common import BLANKS, _stored, ascii_lower, broadcast_if_small, read, row_keys, shared_dir, stored

MIN_DOCS = 10
FANOUT = 2
#: Documents in a batch, about, and the least and the most batches.
BATCH_DOCS, BATCHES, MOST_BATCHES = 50_000_000, 4, 256
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty give one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, with A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


class LineRuns:
    """Levelled sorted runs of (line hash, number of documents)."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []
        self.names: list[str] = []

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, doc): anti-join what is settled, then store the rest as a sorted run."""
        counts = batch.select(*KEY, "doc").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"))
        counts = counts.repartition(self.buckets, *KEY)
        for run in self.settled:  # an anti join would be pushed below the counts and shuffle every line
            counts = counts.join(run.withColumn("gone", F.lit(True)).hint("merge"), KEY, "left").where("gone is null").select(*KEY, "n_docs")
        self._push(0, self._run(counts))

    def _run(self, rows: DataFrame) -> DataFrame:
        """A run on disk. ``rows`` are partitioned by the key into the buckets, so each bucket is one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
        path = f"{shared_dir(self.spark)}/{name}"
        writer.option("path", path).saveAsTable(name)
        self.names.append(name)
        _stored.append(path)
        return self.spark.table(name)

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, merged)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """Compact runs into one run without the keys that are settled now, which are read from it as another."""
        merged = runs[0]
        for run in runs[1:]:
            merged = self._run(compacted(merged, run))
        self.settled.append(merged.where(F.col("n_docs") >= self.min_docs).select(*KEY))
        return merged.where(F.col("n_docs") < self.min_docs)

    def frequent(self) -> DataFrame:
        """The keys that at least ``min_docs`` documents hold, stored; the runs are forgotten."""
        rest = [run for level in self.levels for run in level]
        if rest:
            self.levels = []
            self._merge(rest)  # the shortest runs, of the lowest level, first
        out = self.settled[0]
        for run in self.settled[1:]:
            out = out.unionByName(run)
        out = stored(out, "line-frequent")
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return out


def compacted(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two runs as one: a full outer join of runs that are bucketed alike goes bucket by bucket, without an exchange.

    (A grouping of their union would promise the same, but Spark 4.1 then reads the tables without their buckets.)
    """
    other = two.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("n_docs").alias("more"))
    met = one.hint("merge").join(other, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "full_outer")
    return met.select(F.coalesce("h1", "o1").alias("h1"), F.coalesce("h2", "o2").alias("h2"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))


def dedup_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Drop every line whose key at least ``min_docs`` documents hold.

    Returns the columns of ``docs`` with the cleaned text, plus n_lines and n_dropped. Clashing columns n_lines and
    n_dropped of the input are replaced. Null and empty texts are one empty line; an empty key is never dropped. Rows
    that share an id count as one document, and each keeps its own lines; a null id is a document of its own kind. An
    empty table gives an empty table. The text of a null row stays null.
    """
    if batches is None:
        batches = max(BATCHES, min(MOST_BATCHES, docs.select(F.lit(1)).count() // BATCH_DOCS))
    text = F.col(text_col)
    k1, k2 = row_keys(F.col(id_col), text)
    key = F.transform(lines_of(text), line_key)
    slim = docs.select(
        k1,
        k2,
        F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("doc"),
        F.posexplode(F.transform(key, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"))))).alias("pos", "h"),
    )
    slim = slim.where("h is not null").select("k1", "k2", "doc", "pos", "h.h1", "h.h2", F.pmod("doc", F.lit(batches)).cast("int").alias("batch"))
    slim = stored(slim, "line-hashes", "batch")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for batch in range(batches):
        runs.add(slim.where(F.col("batch") == batch).select("doc", *KEY))
    frequent = runs.frequent()
    hits = slim.join(broadcast_if_small(frequent), KEY).groupBy("k1", "k2").agg(F.collect_set("pos").alias("_hits"))

    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the row travels as one struct, so that no column of it can clash with the keys
    keyed = docs.select(F.struct(*columns).alias("_row"), k1, k2)
    joined = keyed.join(hits, ["k1", "k2"], "left")
    # lines stand in a column of their own and are used more than once, so Spark splits each text once
    joined = joined.withColumn("_lines", lines_of(F.col("_row")[text_col]))
    n = F.size("_lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_hits"))
    new = F.when(F.col("_hits").isNull(), F.col("_row")[text_col]).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return joined.select(
        *[(new if c == text_col else F.col("_row")[c]).alias(c) for c in columns],
        n.cast("long").alias("n_lines"),
        F.when(F.col("_hits").isNull(), F.lit(0)).otherwise(F.size("_hits")).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
freq AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, freq.k IS NOT NULL AS gone FROM keyed LEFT JOIN freq USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
