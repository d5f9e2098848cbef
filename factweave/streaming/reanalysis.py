"""Documents that change: each micro-batch analyses the latest version of every file in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.planner import Options, analyze
from ..sources.scan import as_sources

CHANGES = "path string, version long, content string"


def latest(changes: DataFrame) -> DataFrame:
    """The last version of each file."""
    return changes.groupBy("path").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))


def watch(spark: SparkSession, folder: str, publish: Callable[[DataFrame, int], None], checkpoint: str, options: Options | None = None, **trigger):
    """A query over JSON changes below a folder; ``publish(findings, batch)`` gets each batch's findings with the version they are of.

    Restarts continue from the checkpoint; publishing by (path, version) makes
    a repeated batch harmless.
    """

    def one(batch: DataFrame, number: int) -> None:
        changed = latest(batch)
        found = analyze(as_sources(changed.select("path", "content")), options)
        publish(found.join(changed.select("path", "version"), "path"), number)

    changes = spark.readStream.schema(CHANGES).json(folder)
    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window, with a watermark for late rows; batch or stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
