"""Seasonal profile, overall statistics and the seasonal baseline.

Profiles are aggregations keyed by (segment, ISO week), so they have at most
53 rows per segment; lookups against them are equi-joins on those keys and
Spark picks broadcast or shuffle join from the measured size (AQE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seasonal_profile(panel: DataFrame, target: str = "total_crashes", segment: str = "segment_id",
                     week: str = "week_of_year") -> DataFrame:
    """B1: mean, sample std, min and max of the target per (segment, ISO week)."""
    y = F.col(target).cast("double")
    return panel.groupBy(segment, week).agg(
        F.avg(y).alias("seasonal_mean"),
        F.stddev_samp(y).alias("seasonal_std"),
        F.min(y).alias("seasonal_min"),
        F.max(y).alias("seasonal_max"),
        F.count(F.lit(1)).alias("seasonal_n"),
    )


def overall_stats(panel: DataFrame, target: str = "total_crashes", segment: str = "segment_id",
                  week_start: str = "week_start") -> DataFrame:
    """B2 + W11: overall mean, sample std, history length and forecast origin per segment."""
    y = F.col(target).cast("double")
    return panel.groupBy(segment).agg(
        F.avg(y).alias("overall_mean"),
        F.stddev_samp(y).alias("overall_std"),
        F.count(F.lit(1)).alias("n_weeks"),
        F.min(week_start).alias("first_week"),
        F.max(week_start).alias("last_week"),
    )


def seasonal_range(profile: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Range of the seasonal means per segment (lowest and highest ISO-week mean)."""
    return profile.groupBy(segment).agg(
        F.min("seasonal_mean").alias("seasonal_low"),
        F.max("seasonal_mean").alias("seasonal_high"),
        F.max_by("week_of_year", F.struct(F.col("seasonal_mean"), -F.col("week_of_year"))).alias("peak_week"),
    )


def seasonal_baseline(split_panel: DataFrame, target: str = "total_crashes", segment: str = "segment_id",
                      week: str = "week_of_year", train_flag: str = "is_train") -> DataFrame:
    """B3 + B4: train-only ISO-week mean mapped onto every row as ``baseline_pred``.

    Weeks never seen in training fall back to the segment's train mean (the
    reference produces NaN there and its metrics raise; quirk Q10).  Both
    means are window averages over training values only (test rows contribute
    NULL), partitioned by segment: the panel is already clustered by segment,
    so this adds a sort but no exchange and no join.
    """
    train_y = F.when(F.col(train_flag), F.col(target).cast("double"))
    season = F.avg(train_y).over(Window.partitionBy(segment, week))
    overall = F.avg(train_y).over(Window.partitionBy(segment))
    return split_panel.withColumn("baseline_pred", F.coalesce(season, overall))


def lookup_with_default(df: DataFrame, profile: DataFrame, stats: DataFrame, segment: str = "segment_id",
                        week: str = "week_of_year") -> DataFrame:
    """Attach seasonal mean/std of the row's ISO week, defaulting to the overall mean/std.

    A seasonal std that is NULL (ISO week seen once) also falls back to the
    overall std (quirk Q9).
    """
    return (df.join(profile.select(segment, week, "seasonal_mean", "seasonal_std"), [segment, week], "left")
              .join(stats.select(segment, "overall_mean", "overall_std"), [segment], "left")
              .withColumn("season_mean", F.coalesce("seasonal_mean", "overall_mean"))
              .withColumn("season_std", F.coalesce("seasonal_std", "overall_std")))
