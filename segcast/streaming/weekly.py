"""The hourly → weekly roll-up (A1, A2) as a Structured Streaming aggregation.

Same operator as :func:`segcast.operators.features.weekly_rollup`, for hourly
observations that arrive continuously.  Weekly bins are tumbling event-time
windows of 7 days offset by 5 days from the epoch (a Thursday), i.e. Tuesday
00:00 → next Tuesday 00:00, labelled by the closing Monday exactly like the
batch ``week_label``.  A watermark bounds the state: once event time has
passed a week's end plus the allowed lateness the week is final and its state
is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segcast.operators import features as fe
from segcast.session import ensure_checkpoint_dir
from segcast.sources.io import BUCKET

WEEK = "7 days"
TUESDAY_OFFSET = "5 days"


def weekly_rollup_stream(hourly: DataFrame, lateness: str = "14 days", segment: str = "segment_id",
                         ts: str = "timestamp") -> DataFrame:
    """Streaming weekly roll-up: one row per (segment, week) with the batch roll-up's measures.

    Watermarks need an instant-typed event time, so a wall-clock
    ``timestamp_ntz`` is cast to ``timestamp``; with the session time zone
    at UTC the cast keeps the wall clock, so the epoch-aligned windows fall
    on local Tuesdays exactly like the batch label (other zones are refused).
    """
    tz = hourly.sparkSession.conf.get("spark.sql.session.timeZone")
    if tz not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"streaming weekly roll-up needs spark.sql.session.timeZone=UTC, got {tz}")
    f = (fe.add_hourly_features(hourly).withColumn("_event_time", F.col(ts).cast("timestamp"))
           .withWatermark("_event_time", lateness))
    win = F.window(F.col("_event_time"), WEEK, WEEK, TUESDAY_OFFSET)
    agg = f.groupBy(F.col(segment), win.alias("_w")).agg(
        F.sum("crash_count").cast("bigint").alias("total_crashes"),
        F.avg("speed").alias("avg_speed"),
        F.stddev_samp("speed").alias("std_speed"),
        F.min("speed").alias("min_speed"),
        F.max("speed").alias("max_speed"),
        F.avg("npmrds").alias("avg_npmrds"),
        F.stddev_samp("npmrds").alias("std_npmrds"),
        F.avg("speed_deviation").alias("avg_speed_deviation"),
        F.max("speed_deviation").alias("max_speed_deviation"),
        F.avg("speed_ratio").alias("avg_speed_ratio"),
        F.min("speed_ratio").alias("min_speed_ratio"),
        F.sum("congestion_indicator").cast("bigint").alias("total_congestion_hours"),
        F.sum("is_weekend").cast("bigint").alias("total_weekend_hours"),
        F.sum("is_rush_hour").cast("bigint").alias("total_rush_hours"),
        F.sum("is_night").cast("bigint").alias("total_night_hours"),
        F.sum("is_peak_crash_hour").cast("bigint").alias("total_peak_crash_hours"),
    )
    label = F.date_sub(F.to_date(F.col("_w.end")), 1)
    return agg.select(F.col(segment).alias("segment_id"), label.alias("week_start"),
                      *[c for c in agg.columns if c not in (segment, "_w")])


def start_weekly_table(hourly: DataFrame, path: str, name: str = "weekly", lateness: str = "14 days",
                       trigger_available_now: bool = True, buckets: int = 64) -> StreamingQuery:
    """Run the streaming roll-up into a Parquet table (append mode: each week written once it is final).

    The streaming checkpoint lives under the session's shared checkpoint
    folder so a restarted query resumes after executor or driver loss.
    """
    spark = hourly.sparkSession
    ckpt = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{name}"
    # as many directories as hash buckets, however many segments there are
    weekly = weekly_rollup_stream(hourly, lateness).withColumn(BUCKET, F.pmod(F.xxhash64("segment_id"), F.lit(buckets)).cast("int"))
    w = (weekly.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", ckpt).partitionBy(BUCKET))
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()
