"""Unbounded sources: documents into a changing index, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.text.segments import SegmentedIndex


def file_stream(spark: SparkSession, path: str, fmt: str, schema, max_files: int = 1000) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def ingest(stream: DataFrame, index: SegmentedIndex, checkpoint: str, once: bool = True):
    """Queue each micro-batch of (doc_id, text) in the index and commit it; with once, stop when all there is has been read."""

    def add(batch: DataFrame, _: int) -> None:
        index.add_documents(batch)
        index.flush()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_static(stream: DataFrame, static: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The unbounded side streams, whichever is named first; the other is read anew for each batch."""
    if static.isStreaming and not stream.isStreaming:
        stream, static = static, stream
        how = {"left": "right", "right": "left"}.get(how, how)
    return stream.join(static, on, how)


def check_bounded(df: DataFrame) -> None:
    """Refuse what needs all of an unbounded input."""
    if df.isStreaming:
        raise ValueError("this operation needs a bounded input")


def _marked(events: DataFrame, late: str) -> DataFrame:
    """Watermarks stand on timestamps with a zone only."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Events counted and summed by window and type; `late` is how long a window waits."""
    marked = _marked(events, late)
    found = marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events without a pause of `gap`."""
    marked = _marked(events, late)
    found = marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("begin"), "n")
