"""The exposure log as a stream: sessions, and the daily totals behind past-only statistics.

Both read the stream once, keep state bounded by a watermark, and give the
rows of the batch operators on a replayed log.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.views import SCHEMAS


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files of a folder as they arrive; ``ts`` becomes an instant (UTC session)."""
    s = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_sessions(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions closed by ``gap`` of silence: user, day, start, end, impressions.

    A session also breaks at midnight, so the day is part of the key.
    """
    return (
        events.withColumn("day", F.to_date("ts"))
        .withWatermark("ts", late)
        .groupBy(user, "day", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("impressions"), F.max("ts").alias("last"))
        .select(user, "day", F.col("w.start").alias("start"), "last", "impressions")
    )


def stream_daily_totals(
    events: DataFrame, keys: Sequence[str], sums: Mapping[str, str], late: str = "1 hour"
) -> DataFrame:
    """Rows and sums by key and day; a day is emitted once the watermark has passed it."""
    return (
        events.withWatermark("ts", late)
        .groupBy(*keys, F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(o) for o, c in sums.items()])
        .select(*keys, F.to_date("w.start").alias("day"), "cnt", *sums)
    )


def append_to(df: DataFrame, path: str, checkpoint: str):
    """Drain what is there into Parquet, exactly once across restarts."""
    return (
        df.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
