"""What the corpus operators share: shared storage, hashing, and broadcasts behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of fixed-width rows (hashes, ids, counts) is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 400_000

#: ASCII white space as the contracts define it: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A private one is made only in local mode, where they are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = getattr(shared_dir, "own", None)
        if named is None:
            named = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="rollgrid-")
    return named.rstrip("/")


_stored: list[str] = []


def stored(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    _stored.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)


def discard(spark: SparkSession) -> int:
    """Delete all tables that ``stored`` has written, once the results that read them have been written too."""
    gone = 0
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows, else as it is (a skew-splittable shuffle join)."""
    return F.broadcast(df) if small(df, rows) else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def row_keys(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of a row, k1 and k2: rows that agree in the columns share them."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("row"), *columns).alias("k2")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
