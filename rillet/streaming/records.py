"""Record-mode transformations on streams, and event-time windows beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(form).schema(schema).options(**options).load(path)


def apply(rows: DataFrame, program: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A program of one row in, some rows out: the same DataFrame function as in batch, stateless here."""
    out = program(rows)
    if rows.isStreaming and not out.isStreaming:
        raise ValueError("the program leaves the stream")
    return out


def windowed(rows: DataFrame, time: str, width: str, late: str, by: list[str], slide: str | None = None, **aggregates) -> DataFrame:
    """Aggregates of tumbling or sliding windows, rows later than `late` being dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.withWatermark(time, late).groupBy(window.alias("window"), *by).agg(*[a.alias(n) for n, a in aggregates.items()])


def run_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", form: str = "json") -> None:
    """All that is there now, exactly once, to files."""
    rows.writeStream.format(form).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
