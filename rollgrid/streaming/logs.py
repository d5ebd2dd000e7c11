"""Structured Streaming over append-only rollout logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from rollgrid.operators.storage import folder
from rollgrid.sources import schemas


def rollout_stream(spark: SparkSession, path: str, schema: str = schemas.ROLLOUT, files_per_trigger: int | None = None) -> DataFrame:
    """New JSON lines of a folder as they come."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def running_group_stats(stream: DataFrame, key: str = "token", measure: str = "pdms_scaled") -> DataFrame:
    """Group size, mean, sample std and range so far, from mergeable moments (output mode update or complete)."""
    x = F.col(measure)
    n, s, q = F.count(x), F.sum(x), F.sum(x * x)
    std = F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))
    return stream.groupBy(key).agg(n.alias("group_size"), (s / n).alias(f"{measure}_mean"), std.alias(f"{measure}_std"), (F.max(x) - F.min(x)).alias(f"{measure}_range"))


def windowed_counts(stream: DataFrame, time: str = "ts", length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums of event-time windows; rows later than the watermark are passed over."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def accumulated_batches(stream: DataFrame, key: str, kept: str, target: int, most: int) -> DataFrame:
    """Per key the state of filling a batch: groups kept, batches used, and whether it is full or given up.

    Rows (key, kept) each stand for one generated batch; rows that come after the batch is closed are passed over.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have, used = state.get if state.exists else (0, 0)
        for frame in frames:
            for n in frame[kept]:
                if have < target and used < most:
                    have, used = have + int(n), used + 1
        state.update((have, used))
        yield pd.DataFrame({key: [k[0]], "kept": [have], "batches": [used], "full": [have >= target], "given_up": [have < target and used >= most]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, kept).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, kept long, batches int, full boolean, given_up boolean", "have long, used int", "update", GroupStateTimeout.NoTimeout)


def append_jsonl(stream: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """Append rows as JSON lines in micro-batches; with ``every`` None what is there is written once, then it stops."""
    writer = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(query: StreamingQuery) -> None:
    """Wait until all input that is there has been written, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def keyed_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Write each micro-batch of a stream once, whatever fails in between; read the rows with ``keyed``.

    A batch goes to the folder of its number, and a ledger entry is made when it stands. A batch that comes again after a
    restart is passed over if the ledger has it, and else overwrites what its first try left. ``every`` is a trigger
    interval; with None what is there is written, then the query stops.
    """

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if not _listed(spark, f"{path}/ledger/batch={batch}"):
            rows.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
            spark.range(batch, batch + 1).toDF("batch").write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _listed(spark: SparkSession, folder: str) -> bool:
    """Whether a write to a folder has ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return bool(mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark))


def keyed(spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """The last row of each key that ``keyed_sink`` has written: of the latest batch, and inside it the greatest ``order``.

    Batches without a ledger entry do not count. An aggregation that combines map-side.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return spark.createDataFrame([], schema)
    written = spark.read.schema("batch long").parquet(f"{path}/ledger").select("batch").distinct()
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    data = spark.read.option("basePath", f"{path}/data").schema(StructType([*kind.fields, StructField("batch", LongType())])).parquet(f"{path}/data")
    data = data.join(written, "batch", "left_semi")
    last = F.max_by(F.struct(*kind.names), F.struct("batch", *([order] if order else []))).alias("_row")
    return data.groupBy(*keys).agg(last).select("_row.*")


def settled(aggregated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The result of a streaming aggregation over all input that is there now, by its keys, through a keyed sink in the
    folder that driver and executors share: changed groups are upserted, and nothing passes through the driver."""
    spark = aggregated.sparkSession
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    keyed_sink(aggregated, f"{path}/rows", f"{path}/checkpoint", "update").awaitTermination()
    return keyed(spark, f"{path}/rows", aggregated.schema, keys)
