"""Plug-ins by name: rewards, parsers and feature builders, vectorised or by row."""

from __future__ import annotations

import importlib
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REWARDS: dict[str, Callable] = {}
PARSERS: dict[str, Callable[[Column], Column]] = {}


def register(table: dict[str, Callable], name: str) -> Callable:
    def add(f: Callable) -> Callable:
        table[name] = f
        return f

    return add


def loaded(spec: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"{spec!r} is not module:function")
    return getattr(importlib.import_module(module), name)


def reward_column(f: Callable, kind: str, *columns: str, **options) -> Column:
    """A reward function as a column: 'batch' takes lists of values and gives a list, 'sequential' takes one row."""
    if kind not in ("batch", "sequential"):
        raise ValueError(f"unknown reward type: {kind}")

    @F.pandas_udf("double")
    def batch(frame: pd.DataFrame) -> pd.Series:
        rows = frame.to_dict("records")
        return pd.Series(f(rows, **options) if kind == "batch" else [f(r, **options) for r in rows], dtype="float64")

    return batch(F.struct(*columns))


#: Groups that a thread scores in one go, and rows of a frame that goes back to Spark, at least.
RUN, ROWS = 64, 10_000


def scored_by_group(df: DataFrame, f: Callable[[list[dict]], list[dict]], key: str, schema: str, zero: Callable[[dict], dict], threads: int = 1) -> DataFrame:
    """Rows scored together with those of their key. A group whose scorer fails or gives the wrong number of results
    gets zero rows. The groups of a task may be scored by several threads, which suits remote scorers.

    Between Spark and the scorer rows are plain dictionaries; frames are made of many groups at once, as a frame for each
    group costs far more than its few rows.
    """

    def one(rows: list[dict]) -> list[dict]:
        try:
            out = list(f(rows))
            if len(out) != len(rows):
                raise ValueError("wrong number of results")
        except Exception:  # a failed scorer must not stop the run
            out = [zero(r) for r in rows]
        return out

    def scored(found: Iterator[list[dict]]) -> Iterator[list[dict]]:
        if threads == 1:
            yield from map(one, found)
            return
        with ThreadPoolExecutor(threads) as pool:
            runs: deque = deque()
            while some := list(islice(found, RUN * threads)):
                runs += [pool.submit(lambda part: [one(g) for g in part], some[k::threads]) for k in range(min(threads, len(some)))]
                while len(runs) > 2 * threads:
                    yield from runs.popleft().result()
            while runs:
                yield from runs.popleft().result()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        for group in scored(_groups(batches, key)):
            out += group
            if len(out) >= ROWS:
                yield pd.DataFrame(out)
                out = []
        if out:
            yield pd.DataFrame(out)

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[list[dict]]:
    """The rows of each whole group, from batches in the order of the key; a group may go on in the next batch."""
    held: list[dict] = []
    for batch in batches:
        names = list(batch.columns)
        rows = [dict(zip(names, values)) for values in zip(*(batch[c].tolist() for c in names))]
        begin = 0
        for k, row in enumerate(rows):
            last = rows[k - 1] if k else held[-1] if held else None
            if last is not None and not _same(last[key], row[key]):
                yield held + rows[begin:k]
                held, begin = [], k
        held += rows[begin:]
    if held:
        yield held


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))
