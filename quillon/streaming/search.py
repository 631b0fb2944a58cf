"""Streams of queries against a table of documents: each micro-batch goes through a lane."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Lane = Callable[[DataFrame], DataFrame]


def search_stream(queries: DataFrame, lane: Lane, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write lane(batch) for each micro-batch of a stream of queries under out/batch=<id>.

    A batch that is tried again replaces what it wrote before, so each query's hits are there once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        lane(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latency_windows(events: DataFrame, time_col: str, value_col: str, *, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, n, mean, most) of a stream's latencies in tumbling windows; later rows than ``late`` are left out."""
    groups = events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("window"))
    return groups.agg(F.count("*").alias("n"), F.avg(value_col).alias("mean"), F.max(value_col).alias("most"))
