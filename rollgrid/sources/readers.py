"""Readers of logs, manifests, score files and caches. All go through Spark's file sources, so any path it knows works."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollgrid.operators import batch, guards
from rollgrid.sources import schemas

#: Names of files that the score pipeline itself writes. Fixed values.
OUTPUTS = ("merged", "stats", "filtered")


def rollouts(spark: SparkSession, path: str | Sequence[str], schema: str = schemas.ROLLOUT) -> DataFrame:
    """One JSON object per line; unknown keys are passed over and a broken line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def steps(spark: SparkSession, path: str, n: int, required: Sequence[str] = ("sampling",)) -> DataFrame:
    """Training steps 1..n of a log, each once, in order; rows without a required field are no steps."""
    log = spark.read.schema(schemas.STEP).option("mode", "FAILFAST").json(path)
    for c in required:
        log = log.where(F.col(c).isNotNull())
    return guards.dense_steps(log, n).orderBy("step")


def manifest(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """(pos, token) of a text manifest: blank lines and a byte order mark dropped; duplicates fail.

    The lines of a folder follow each other in the order of its files' names. They are read in byte ranges: a range is read
    by one task from its start, so the task's row numbers give the order inside it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    bare = F.regexp_replace("value", "^\ufeff|\r$", "")
    tokens = lines.select("file", "start", "line", F.trim(bare).alias("token")).where("token <> ''")
    guards.unique(tokens, "token", "tokens in the manifest")
    return batch.indexed(tokens, ["file", "start", "line"]).select("pos", "token") if ordered else tokens.select("token")


def token_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct first tab-separated columns of a text file."""
    return spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("token")).where("token <> ''").distinct()


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """(log_name, tokens) of a CSV manifest log_name, token."""
    rows = spark.read.option("header", True).schema("log_name string, token string").csv(path)
    return rows.groupBy("log_name").agg(F.collect_list("token").alias("tokens"))


def dataset(spark: SparkSession, path: str, default: str = "train") -> DataFrame:
    """Parquet or JSON at ``path`` or ``path@split``; a split is a sub-path, or a column named split."""
    where, _, part = path.partition("@")
    reader = spark.read.json if where.endswith((".json", ".jsonl")) else spark.read.parquet
    df = reader(where)
    return df.where(F.col("split") == (part or default)) if "split" in df.columns else reader(f"{where.rstrip('/')}/{part}") if part else df


def wanted_name(name: str, include: str | None = None, exclude: str | None = None, backups: bool = False) -> bool:
    """Whether a score file takes part: no output of the pipeline itself, no backup, and what the patterns say."""
    stem = name.rsplit("/", 1)[-1]
    if any(x in stem for x in OUTPUTS) or (not backups and "_bak" in stem):
        return False
    return (include is None or fnmatch.fnmatch(stem, include)) and (exclude is None or not fnmatch.fnmatch(stem, exclude))


def score_files(spark: SparkSession, folder: str, include: str | None = None, exclude: str | None = None, backups: bool = False, max_rows: int | None = None) -> DataFrame:
    """All score CSVs of a folder with numeric columns made so (or NULL), only valid rows where that is told."""
    names = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()]
    chosen = sorted(n for n in names if wanted_name(n, include, exclude, backups))
    if not chosen:
        return spark.createDataFrame([], schemas.SCORES)
    df = spark.read.option("header", True).csv(chosen)
    if "valid" in df.columns:
        df = df.where(F.lower(F.trim(F.col("valid").cast("string"))) == "true")
    texts = ("token", "valid", "log_name")
    df = df.select(*[F.col(c) if c in texts else F.col(c).try_cast("double").alias(c) for c in df.columns])
    return df.limit(max_rows) if max_rows else df


def score_columns(df: DataFrame) -> DataFrame:
    """token, pdms and pdms_scaled of a score table, with ``score`` or ``pdm_score`` where pdms is missing; summary rows go."""
    first = next((c for c in ("pdms", "pdm_score", "score") if c in df.columns), None)
    if first is None:
        raise KeyError("no score column")
    second = "pdms_scaled" if "pdms_scaled" in df.columns else first
    out = df.select("token", F.col(first).cast("double").alias("pdms"), F.col(second).cast("double").alias("pdms_scaled"))
    return out.where(F.col("token") != "average_all_frames").na.drop(subset=["token", "pdms", "pdms_scaled"])


def scored_scenes(spark: SparkSession, path: str, required: Sequence[str] = (*schemas.METRICS, "token", "valid")) -> DataFrame:
    """Valid rows of one score CSV without summary rows; a file without the columns gives no rows."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if any(c not in df.columns for c in required):
        return df.limit(0)
    keep = (F.lower("valid") == "true") & ~F.coalesce(F.col("token").rlike("(?i)average|score"), F.lit(False))
    return df.where(keep).select(*[F.col(c).try_cast("double").alias(c) if c not in ("token", "valid", "log_name") else F.col(c) for c in df.columns])


def cache_index(spark: SparkSession, path: str) -> DataFrame:
    """(token, path) of a CSV index of cache files: the token is the last but one part; of equal ones the last row stays."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(F.col(rows.columns[0]).alias("path")).withColumn("token", F.try_element_at(F.split("path", "/"), F.lit(-2)))
    return rows.withColumn("_n", F.monotonically_increasing_id()).groupBy("token").agg(F.max_by("path", "_n").alias("path"))


def normalisation(spark: SparkSession, path: str) -> tuple[list[list[float]], list[list[float]]]:
    """Mean and std matrices of a JSON file."""
    row = spark.read.option("multiLine", True).schema("mean array<array<double>>, std array<array<double>>").json(path).first()
    return row["mean"], row["std"]


def scenes(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Binary scene files decoded by ``decode(path, content) -> iterable of rows``, file by file on the executors."""

    def run(batches):
        import pandas as pd

        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        for frame in batches:
            for name, content in zip(frame["path"], frame["content"]):
                rows = list(decode(name, content))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def latest_checkpoint(spark: SparkSession, tracker: str, pattern: str = "global_step_{}") -> tuple[str | None, int | None]:
    """(folder, step) that a tracker file names, or (None, None) without one."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(tracker)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None, None
    row = spark.read.option("multiLine", True).schema("last_global_step int").json(tracker).first()
    step = row["last_global_step"] if row else None
    return (None, None) if step is None else (f"{tracker.rsplit('/', 1)[0]}/{pattern.format(step)}", step)
