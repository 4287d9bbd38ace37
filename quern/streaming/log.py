"""Logs and micro-batches: recency dedup, batched sinks, staged maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def signature(df: DataFrame, name: str, body: str):
    """Name and sorted keys of a JSON object: objects are compared only with their own kind."""
    return F.concat_ws("|", name, F.array_join(F.array_sort(F.json_object_keys(F.col(body))), ","))


def recent_duplicates(df: DataFrame, by: list[str], time: str, tie: str, recency: float) -> DataFrame:
    """df with copy_of: the time of the original that a row repeats, or null for originals.

    Recency runs from the original, not from the last copy, so originals must be found in order: a task goes through
    its sorted rows and holds only the last original. Rows without a time are originals.
    """
    timed = df.withColumn("copy_of", F.col(time).cast("double"))
    at = [timed.columns.index(c) for c in by]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for b in batches:
            out = []
            for *own, t in zip(*(b.column(i).to_pylist() for i in at), b.column(b.num_columns - 1).to_pylist()):
                if own != key:
                    key, first = own, None
                copy = first is not None and t is not None and t - first <= recency
                out.append(first if copy else None)
                if not copy:
                    first = t
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names=b.schema.names)

    return timed.repartition(*by).sortWithinPartitions(*by, "copy_of", tie).mapInArrow(mark, timed.schema)


def stream_originals(stream: DataFrame, by: list[str], time: str, recency: str) -> DataFrame:
    """A stream without rows that repeat their key within the watermark."""
    return stream.withWatermark(time, recency).dropDuplicatesWithinWatermark(by)


def windowed_counts(stream: DataFrame, time: str, by: str, value: str, width: str, late: str) -> DataFrame:
    """Counts and sums per key in event-time windows, late rows within `late` included."""
    agg = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("start"), by, "n", "total")


def batched_sink(stream: DataFrame, commit: Callable[[DataFrame, int], None], key: str, checkpoint: str, every: str = "10 seconds", after: Callable[[int], None] | None = None):
    """Commits each micro-batch once, one row per key (the last by input order of the batch), then calls `after`."""

    def one(batch: DataFrame, number: int) -> None:
        w = W.partitionBy(key).orderBy(F.monotonically_increasing_id().desc())
        commit(batch.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_"), number)
        if after:
            after(number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def staged(df: DataFrame, column: str, stages: list[Callable[[Any], Any]], out: str = "result") -> DataFrame:
    """df with the result of the stages in turn, as text, and error: a failing row goes on with null."""
    schema = df.withColumn(out, F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).schema

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            results, errors = [], []
            for v in pdf[column]:
                try:
                    for s in stages:
                        v = s(v)
                    results.append(None if v is None else str(v))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{out: results, "error": errors})

    return df.mapInPandas(run, schema)


def batch_map(df: DataFrame, column: str, call: Callable[[list[Any]], list[Any]], size: int, out: str = "result") -> DataFrame:
    """df with the answers of a function of lists of at most `size` items; a short or failing answer gives nulls."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got: list[Any] = []
            for a in range(0, len(pdf), size):
                part = pdf[column].iloc[a : a + size].tolist()
                try:
                    answer = list(call(part))
                except Exception:  # noqa: BLE001
                    answer = []
                got += answer if len(answer) == len(part) else [None] * len(part)
            yield pdf.assign(**{out: [None if g is None else str(g) for g in got]})

    return df.mapInPandas(run, schema)


def missing_keys(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not stored yet."""
    return todo.join(done.select(key), key, "left_anti")
