"""Incremental processing: skip what is done, retry what failed, or run as an available-now stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def not_done(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a result."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def failed(results: DataFrame, content: str) -> DataFrame:
    """Results without content, to be run again."""
    return results.where(F.col(content).isNull())


def mapped(tasks: DataFrame, key: str, text: str, fn: Callable[[str], object], model_id: str, done: DataFrame | None = None) -> DataFrame:
    """(id, model_id, text, content, duration, error): ``fn`` on every task that has no content yet.

    Results are kept as strings. An exception becomes the row's error, never the job's; null texts are an error of their own.
    ``done`` holds earlier results: tasks with content there are skipped, failed ones run again.
    """
    kind = dict(tasks.dtypes)[key]
    t = tasks.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if done is not None:
        t = not_done(t, done.where((F.col("model_id") == model_id) & F.col("content").isNotNull()), ["id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, x in zip(b["id"], b["text"], strict=True):
                content, error, began = None, None, time.perf_counter()
                try:
                    if x is None:
                        raise ValueError("no text")
                    got = fn(x)
                    content = None if got is None else str(got)
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                out.append((i, model_id, x, content, time.perf_counter() - began, error))
            yield pd.DataFrame(out, columns=["id", "model_id", "text", "content", "duration", "error"])

    return t.mapInPandas(run, f"id {kind}, model_id string, text string, content string, duration double, error string")


def run_available(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Process the files that have come since the last run exactly once, then stop."""
    q = step(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
