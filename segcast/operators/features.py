"""Hourly features, weekly roll-up, calendar densification and window features.

Every function is ``DataFrame -> DataFrame`` and keyed by a segment column, so
one call processes any number of segments.  Window functions always partition
by segment and order by week: the exchange is on the segment key and the
partition size is bounded by the number of weeks in a segment's history, not
by the data volume.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hour sets and window sizes of the feature definitions.
RUSH_HOURS = [7, 8, 9, 16, 17, 18]
NIGHT_HOURS = [22, 23, 0, 1, 2, 3, 4, 5]
PEAK_HOURS = [15, 16, 17, 18]
LAGS = [1, 2, 3, 4, 8, 12]
ROLL_WINDOWS = [2, 4, 8, 12]
HOURS_PER_WEEK = 168

# Measures of the weekly roll-up that are sums (0 for an empty week); the rest
# are means/std/min/max (missing for an empty week, like a pandas resample).
SUM_MEASURES = [
    "total_crashes", "total_congestion_hours", "total_weekend_hours",
    "total_rush_hours", "total_night_hours", "total_peak_crash_hours",
]
STAT_MEASURES = [
    "avg_speed", "std_speed", "min_speed", "max_speed", "avg_npmrds", "std_npmrds",
    "avg_speed_deviation", "max_speed_deviation", "avg_speed_ratio", "min_speed_ratio",
]
DERIVED = ["speed_variability", "speed_range", "pct_congested", "pct_rush_hour"]
CALENDAR = ["year", "month", "quarter", "week_of_year"]
CYCLIC = ["week_sin", "week_cos", "month_sin", "month_cos"]
# Exogenous columns carried forward unchanged into forecast rows.
CARRIED = STAT_MEASURES + [c for c in SUM_MEASURES if c != "total_crashes"] + DERIVED


def lag_names() -> list[str]:
    return [f"crashes_lag_{k}w" for k in LAGS]


def rolling_names() -> list[str]:
    return [f"crashes_rolling_{s}_{w}w" for w in ROLL_WINDOWS for s in ("mean", "std", "max")]


CHANGE = ["crash_change_1w", "crash_change_4w"]
PANEL_COLUMNS = (["week_start", "total_crashes"] + STAT_MEASURES + SUM_MEASURES[1:] + DERIVED
                 + CALENDAR + CYCLIC + lag_names() + rolling_names() + CHANGE)


def safe_denominator(c: Column) -> Column:
    """``replace(0, 1)``: a zero denominator becomes 1, missing stays missing."""
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def add_hourly_features(df: DataFrame, speed: str = "speed", hist_speed: str = "historical_average_speed",
                        ref_speed: str = "reference_speed", hour: str = "hour") -> DataFrame:
    """Deviation, ratio, congestion flag and hour-of-day flags."""
    s, h, r, hr = F.col(speed), F.col(hist_speed), F.col(ref_speed), F.col(hour)
    return df.withColumns({
        "speed_deviation": F.abs(s - h),
        "speed_ratio": s / safe_denominator(r),
        "congestion_indicator": F.coalesce((s < r * 0.7).cast("int"), F.lit(0)),
        "is_rush_hour": hr.isin(RUSH_HOURS).cast("int"),
        "is_night": hr.isin(NIGHT_HOURS).cast("int"),
        "is_peak_crash_hour": hr.isin(PEAK_HOURS).cast("int"),
    })


def week_label(ts: Column) -> Column:
    """A1: Tuesday..Monday bin labelled by its closing Monday (pandas ``W-MON``)."""
    return F.next_day(F.date_sub(F.to_date(ts), 1), "MON")


def weekly_rollup(df: DataFrame, segment: str = "segment_id", ts: str = "timestamp",
                  count: str = "crash_count", npmrds: str = "npmrds") -> DataFrame:
    """A2: one row per (segment, week) with sums and distribution statistics.

    Expects the hourly features of :func:`add_hourly_features`.  Spark runs a
    partial aggregation before the exchange, so only one row per
    (segment, week, map task) crosses the shuffle whatever the input volume
    and however skewed the segments are.
    """
    return (df.groupBy(F.col(segment).alias("segment_id"), week_label(F.col(ts)).alias("week_start"))
              .agg(F.sum(count).cast("bigint").alias("total_crashes"),
                   F.avg("speed").alias("avg_speed"),
                   F.stddev_samp("speed").alias("std_speed"),
                   F.min("speed").alias("min_speed"),
                   F.max("speed").alias("max_speed"),
                   F.avg(npmrds).alias("avg_npmrds"),
                   F.stddev_samp(npmrds).alias("std_npmrds"),
                   F.avg("speed_deviation").alias("avg_speed_deviation"),
                   F.max("speed_deviation").alias("max_speed_deviation"),
                   F.avg("speed_ratio").alias("avg_speed_ratio"),
                   F.min("speed_ratio").alias("min_speed_ratio"),
                   F.sum("congestion_indicator").cast("bigint").alias("total_congestion_hours"),
                   F.sum("is_weekend").cast("bigint").alias("total_weekend_hours"),
                   F.sum("is_rush_hour").cast("bigint").alias("total_rush_hours"),
                   F.sum("is_night").cast("bigint").alias("total_night_hours"),
                   F.sum("is_peak_crash_hour").cast("bigint").alias("total_peak_crash_hours")))


def _segment_window(segment: str = "segment_id", order: str = "week_start"):
    return Window.partitionBy(segment).orderBy(order)


def densify_weeks(weekly: DataFrame, segment: str = "segment_id") -> DataFrame:
    """A3: emit the empty weeks between a segment's first and last week.

    Each observed week generates itself plus the missing weeks up to the next
    observed week (``lead`` over the segment window), so no calendar spine and
    no join are needed.  Filled weeks get 0 for sums and NULL for statistics.
    """
    w = _segment_window(segment)
    nxt = F.col("_next")
    weeks = F.when(nxt.isNull(), F.array(F.col("week_start"))).otherwise(
        F.sequence(F.col("week_start"), F.date_sub(nxt, 7), F.expr("INTERVAL 1 WEEK")))
    exploded = weekly.withColumn("_next", F.lead("week_start").over(w)).withColumn("_wk", F.explode(weeks))
    filled = F.col("_wk") != F.col("week_start")
    cols = {c: F.when(filled, F.lit(0).cast("bigint")).otherwise(F.col(c)) for c in SUM_MEASURES if c in weekly.columns}
    cols.update({c: F.when(filled, F.lit(None)).otherwise(F.col(c)) for c in STAT_MEASURES if c in weekly.columns})
    return exploded.withColumns(cols).withColumn("week_start", F.col("_wk")).drop("_wk", "_next")


def add_week_calendar(df: DataFrame, week: str = "week_start") -> DataFrame:
    """Derived ratios, calendar parts (ISO week) and cyclic encodings."""
    wk = F.col(week)
    out = df.withColumns({
        "speed_variability": F.col("std_speed") / safe_denominator(F.col("avg_speed")),
        "speed_range": F.col("max_speed") - F.col("min_speed"),
        "pct_congested": F.col("total_congestion_hours") / HOURS_PER_WEEK,
        "pct_rush_hour": F.col("total_rush_hours") / HOURS_PER_WEEK,
        "year": F.year(wk),
        "month": F.month(wk),
        "quarter": F.quarter(wk),
        "week_of_year": F.weekofyear(wk),
    })
    return out.withColumns(cyclic_columns(F.col("week_of_year"), F.col("month")))


def cyclic_columns(week_of_year: Column, month: Column) -> dict[str, Column]:
    """Sine/cosine encodings of ISO week (period 52) and month (period 12)."""
    two_pi = 2 * math.pi
    return {
        "week_sin": F.sin(two_pi * week_of_year / 52),
        "week_cos": F.cos(two_pi * week_of_year / 52),
        "month_sin": F.sin(two_pi * month / 12),
        "month_cos": F.cos(two_pi * month / 12),
    }


def add_lag_features(df: DataFrame, target: str = "total_crashes", segment: str = "segment_id",
                     leaky: bool = True, fill: bool = True) -> DataFrame:
    """Lags, rolling mean/std/max, changes, then NULL → 0.

    ``leaky=True`` reproduces the reference: rolling windows include the
    current week and the change features use the current value.  With
    ``leaky=False`` windows end at the previous week and changes are dropped.
    All window expressions share one partition/order spec, so Spark plans a
    single exchange and sort for the whole block.
    """
    w = _segment_window(segment)
    y = F.col(target)
    cols: dict[str, Column] = {f"crashes_lag_{k}w": F.lag(y, k).over(w) for k in LAGS}
    end = 0 if leaky else -1
    for n in ROLL_WINDOWS:
        frame = w.rowsBetween(-(n - 1) + end, end)
        cols[f"crashes_rolling_mean_{n}w"] = F.avg(y).over(frame)
        cols[f"crashes_rolling_std_{n}w"] = F.stddev_samp(y).over(frame)
        cols[f"crashes_rolling_max_{n}w"] = F.max(y).over(frame).cast("double")
    if leaky:
        cols["crash_change_1w"] = y - F.lag(y, 1).over(w)
        cols["crash_change_4w"] = y - F.lag(y, 4).over(w)
    out = df.withColumns(cols)
    return fill_missing(out) if fill else out


def fill_missing(df: DataFrame, value: float = 0.0) -> DataFrame:
    """NULL and NaN → 0 on every numeric column."""
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    return df.na.fill(value, subset=numeric).na.fill(0, subset=numeric)


def weekly_panel(hourly: DataFrame, leaky: bool = True) -> DataFrame:
    """Hourly observations → densified weekly feature panel (D3), all segments at once."""
    weekly = weekly_rollup(add_hourly_features(hourly))
    return add_lag_features(add_week_calendar(densify_weeks(weekly)), leaky=leaky)


def centered_moving_average(df: DataFrame, target: str = "total_crashes", n: int = 4,
                            segment: str = "segment_id", name: str = "trend") -> DataFrame:
    """Pandas ``rolling(n, center=True)`` – frame [i-n//2, i+(n-1)//2], NULL unless full."""
    frame = _segment_window(segment).rowsBetween(-(n // 2), (n - 1) // 2)
    return df.withColumn(name, F.when(F.count(target).over(frame) == n, F.avg(target).over(frame)))


def time_split(df: DataFrame, frac: float = 0.75, segment: str = "segment_id") -> DataFrame:
    """First floor(frac·n) weeks of each segment are train (``is_train``), the rest test."""
    w = _segment_window(segment)
    n = F.count(F.lit(1)).over(Window.partitionBy(segment))
    return (df.withColumn("row_idx", F.row_number().over(w))
              .withColumn("n_weeks", n)
              .withColumn("is_train", F.col("row_idx") <= F.floor(F.col("n_weeks") * frac)))
