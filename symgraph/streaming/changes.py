"""File changes as a stream: bursts are collapsed, late changes wait for the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import kept


def sessions(changes: DataFrame, gap: str, lateness: str | None = None) -> DataFrame:
    """(path, first, last, changes) for each burst of (path, ts) in which no pause exceeds ``gap``.

    Works on tables and, with ``lateness`` as the watermark, on streams: bursts merge in state and come out
    when the watermark has passed them.
    """
    if lateness is not None:
        changes = changes.withWatermark("ts", lateness)
    # a session ends a gap after its last change, so two changes a gap apart would be apart: a moment is added
    burst = F.session_window("ts", f"{gap} 1 microsecond")
    return changes.groupBy("path", burst).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("changes")).drop("session_window")


def latest(changes: DataFrame, lateness: str, window: str) -> DataFrame:
    """(path, window, hash, size): the last state of each file in each window of a stream of changes."""
    marked = changes.withWatermark("ts", lateness)
    last = F.max_by(F.struct("hash", "size"), F.struct("ts", "event_id")).alias("last")
    return marked.groupBy("path", F.window("ts", window).alias("window")).agg(last).select("path", "window", "last.hash", "last.size")


def incoming(spark: SparkSession, folder: str, schema: str, batch: int = 128) -> DataFrame:
    """A stream of change records from Parquet files, ``batch`` files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch).parquet(folder)


def answer(refresh: Callable[[], DataFrame], last: DataFrame) -> tuple[DataFrame, str | None]:
    """What ``refresh`` gives, written to a table here, or the last state that was stored and a warning if that fails."""
    try:
        return kept(refresh(), "answer"), None
    except Exception as failed:  # any failure leaves the stored state as it is
        return last, f"answered from the last state: {str(failed)[:200]}"
