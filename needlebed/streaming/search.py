"""Streams of needles against a built index, and appending new files to a corpus: additions to what a batch can do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from needlebed.operators.search import batch_contains


def answer_stream(queries: DataFrame, corpus: DataFrame, out: str, checkpoint: str, key: str = "line_no", needle: str = "needle", max_bytes: int = 0, available_now: bool = True) -> StreamingQuery:
    """Answer each micro-batch of a streaming ``queries`` in one pass over ``corpus``; append (key, found) to ``out``.

    A micro-batch writes into a folder of its own number, so one that is run again after a failure replaces its rows.
    """

    def answer(batch: DataFrame, number: int) -> None:
        batch_contains(corpus, batch, key, needle, max_bytes).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def count_by_window(events: DataFrame, time: str = "ts", group: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, group, n): events by window of time, over a stream with a watermark or over a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")
