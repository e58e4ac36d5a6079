"""The event log as a stream: the same tables as a batch replay, and windowed counts with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(log: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each event id once; ids are forgotten once the watermark has passed them."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark(["event_id"])


def counts(log: DataFrame, width: str = "1 day", slide: str | None = None, time: str = "ts", late: str = "1 day", by: str = "event_type") -> DataFrame:
    """(window, by, n, total) of tumbling or sliding windows; events later than the watermark drop out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return log.withWatermark(time, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(log: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = "1 day", by: str = "user_id") -> DataFrame:
    return log.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))


def materialise(log: DataFrame, target: str, checkpoint: str):
    """Appends the stream to a table, each batch in a folder of its own that a rerun of the batch replaces."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
