"""Sinks: JSON lines, CSV, manifests, Parquet, retention. Each writes through Spark; one-file outputs are small by nature."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollgrid.sources.schemas import METRICS


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """Objects with all their keys, NULL included."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "error", one_file: bool = False) -> None:
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if one_file else out).write.mode(mode).option("header", True).csv(path)


def manifest(df: DataFrame, path: str, key: str = "token", order: str | None = None, mode: str = "error") -> None:
    """One key per line, in order where one is given."""
    out = df.orderBy(order) if order else df
    out.select(F.col(key).cast("string")).write.mode(mode).text(path)


def ranking(ranked: DataFrame, path: str, budgets: Sequence[int], key: str = "token") -> None:
    """The whole ranking as CSV and one manifest for each budget."""
    from rollgrid.operators.groups import top_budgets

    csv(ranked, f"{path}/ranking")
    for k, top in top_budgets(ranked, budgets, key).items():
        manifest(top, f"{path}/top_{k}", key)


def scores(df: DataFrame, path: str, mode: str = "error") -> None:
    """token, pdms, pdms_scaled; missing metrics become 0."""
    csv(df.select("token", "pdms", "pdms_scaled").na.fill(0.0), path, mode=mode)


def summary(df: DataFrame, path: str, key: str = "token") -> None:
    """Rows per token and the row of their means, in one file."""
    from rollgrid.operators.groups import with_average_row

    csv(with_average_row(df, key), path, one_file=True)


def parquet(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def reports(df: DataFrame, path: str) -> None:
    """Runner reports with their duration."""
    parquet(df.withColumn("duration", F.col("end_time") - F.col("start_time")), path, "overwrite")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each micro-batch to every sink."""

    def write(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            for sink in sinks:
                sink(df, epoch)
        finally:
            df.unpersist()

    return write


def nested(columns: Sequence[str], separator: str = "/") -> list[Column]:
    """Columns named a/b as structs a with field b."""
    tree: dict = {}
    for c in columns:
        at = tree
        *folders, leaf = c.split(separator)
        for f in folders:
            at = at.setdefault(f, {})
        at[leaf] = c

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else F.col(f"`{v}`")).alias(k) for k, v in node.items()]

    return build(tree)


def flattened(df: DataFrame, separator: str = "/") -> DataFrame:
    """All struct fields as columns named by their path."""
    from pyspark.sql import types as T

    def leaves(schema: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            path = (*prefix, f.name)
            out += leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path))]
        return out

    return df.select(*leaves(df.schema, ()))


def kept_checkpoints(steps: DataFrame, limit: int, step: str = "step", best: str = "best") -> DataFrame:
    """Which checkpoints stay: the newest limit - 1 and the best; with a limit below 1 all."""
    if limit < 1:
        return steps
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col(best).desc(), F.col(step).desc()))  # one row for each checkpoint
    order = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col(step).desc()))
    return steps.withColumns({"_best": place, "_new": order}).where((F.col("_best") == 1) | (F.col("_new") < limit)).drop("_best", "_new")


def zero_row(token: str) -> dict[str, float | str | bool]:
    """The row of a rollout that could not be scored."""
    return {"token": token, "parsed_ok": False, "pdms": 0.0, "pdms_scaled": 0.0, **dict.fromkeys(METRICS, 0.0)}
