"""Tables between two steps of a search, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only in local mode, where driver and executors are one process, may the
    setting be missing."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="rollgrid-"))
        named = _own[0]
    return named.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in that folder and read again, which cuts its lineage durably."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
