"""Check queries for sources, hourly features, weekly roll-up and window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segcast.operators import features as fe
from segcast.plans.common import register, tidy
from segcast.plans.oracle import r, rcols, with_
from segcast.session import store
from segcast.sources import fixtures as fx


def hourly_panel(spark: SparkSession, sf_dir: str, segment: str = "nation") -> DataFrame:
    return fe.weekly_panel(fx.hourly(spark, sf_dir, segment=segment))


def stored_panel(spark: SparkSession, sf_dir: str, segment: str = "nation") -> DataFrame:
    """The weekly panel, written once: queries with several branches over it scan the facts once."""
    return store(hourly_panel(spark, sf_dir, segment), "weekly-panel")


@register("hourly_profile", with_() + """
SELECT segment_id, count(*)::bigint AS n_rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
       sum(crash_count)::bigint AS n_events, count(DISTINCT hour)::bigint AS n_hours
FROM hourly GROUP BY segment_id""")
def hourly_profile(spark, sf_dir):
    """Per-segment profile of the hourly scan."""
    from segcast.sources.io import profile
    return profile(fx.hourly(spark, sf_dir))


@register("hourly_features", with_() + f"""
SELECT segment_id, timestamp, {r('speed_deviation', 'speed_deviation')}, {r('speed_ratio', 'speed_ratio')},
       congestion_indicator, is_rush_hour, is_night, is_peak_crash_hour
FROM hf""")
def hourly_features(spark, sf_dir):
    """F1–F6, F11."""
    df = fe.add_hourly_features(fx.hourly(spark, sf_dir))
    return tidy(df.select("segment_id", "timestamp", "speed_deviation", "speed_ratio", "congestion_indicator",
                          "is_rush_hour", "is_night", "is_peak_crash_hour"))


WEEKLY_COLS = ["segment_id", "week_start"] + fe.SUM_MEASURES + fe.STAT_MEASURES
_W_DBL = fe.STAT_MEASURES


@register("weekly_rollup", with_() + f"""
SELECT segment_id, week_start, {', '.join(fe.SUM_MEASURES)},
  {rcols(_W_DBL)}
FROM weekly""")
def weekly_rollup(spark, sf_dir):
    """A1, A2."""
    return tidy(fe.weekly_rollup(fe.add_hourly_features(fx.hourly(spark, sf_dir))).select(*WEEKLY_COLS))


@register("densified_weeks", with_() + f"""
SELECT segment_id, week_start, {', '.join(fe.SUM_MEASURES)},
  {rcols(_W_DBL)}
FROM dense""")
def densified_weeks(spark, sf_dir):
    """A3."""
    w = fe.weekly_rollup(fe.add_hourly_features(fx.hourly(spark, sf_dir)))
    return tidy(fe.densify_weeks(w).select(*WEEKLY_COLS))


_CAL_DBL = fe.DERIVED + fe.CYCLIC


@register("weekly_calendar", with_() + f"""
SELECT segment_id, week_start, year, month, quarter, week_of_year,
  {rcols(_CAL_DBL)}
FROM cal""")
def weekly_calendar(spark, sf_dir):
    """A4, A5, A6."""
    w = fe.weekly_rollup(fe.add_hourly_features(fx.hourly(spark, sf_dir)))
    out = fe.add_week_calendar(fe.densify_weeks(w))
    return tidy(out.select("segment_id", "week_start", *fe.CALENDAR, *_CAL_DBL))


@register("lag_features", with_() + f"""
SELECT segment_id, week_start, total_crashes, {', '.join(fe.lag_names())} FROM panel""")
def lag_features(spark, sf_dir):
    """W1."""
    return hourly_panel(spark, sf_dir).select("segment_id", "week_start", "total_crashes", *fe.lag_names())


@register("rolling_features", with_() + f"""
SELECT segment_id, week_start, {rcols(fe.rolling_names())} FROM panel""")
def rolling_features(spark, sf_dir):
    """W2, W3, W4."""
    return tidy(hourly_panel(spark, sf_dir).select("segment_id", "week_start", *fe.rolling_names()))


@register("change_features", with_() + f"""
SELECT segment_id, week_start, total_crashes, {', '.join(fe.CHANGE)} FROM panel""")
def change_features(spark, sf_dir):
    """W5 (and the leakage identity y = lag1 + change1 from row 2 on)."""
    return hourly_panel(spark, sf_dir).select("segment_id", "week_start", "total_crashes", *fe.CHANGE)


_PANEL_DBL = [c for c in fe.PANEL_COLUMNS
              if c in fe.STAT_MEASURES + fe.DERIVED + fe.CYCLIC + fe.rolling_names()]
_PANEL_INT = [c for c in fe.PANEL_COLUMNS if c not in _PANEL_DBL and c != "week_start"]


@register("feature_panel", with_() + f"""
SELECT segment_id, week_start, {', '.join(_PANEL_INT)},
  {rcols(_PANEL_DBL)}
FROM panel""")
def feature_panel(spark, sf_dir):
    """W6, B5 (the full 49-column NULL-free panel that feeds the assembler)."""
    return tidy(hourly_panel(spark, sf_dir).select("segment_id", "week_start", *_PANEL_INT, *_PANEL_DBL))


@register("centered_trend", with_() + f"""
SELECT segment_id, week_start, total_crashes,
  CASE WHEN count(total_crashes) OVER w = 4 THEN {r('avg(total_crashes) OVER w', 'x').replace(' AS x', '')} END AS trend
FROM dense WINDOW w AS (PARTITION BY segment_id ORDER BY week_start ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def centered_trend(spark, sf_dir):
    """History series with its centred 4-week trend."""
    w = fe.weekly_rollup(fe.add_hourly_features(fx.hourly(spark, sf_dir)))
    d = fe.densify_weeks(w).select("segment_id", "week_start", "total_crashes")
    return tidy(fe.centered_moving_average(d))


@register("time_split", with_() + """
SELECT segment_id, week_start, row_idx, n_weeks, row_idx <= floor(n_weeks * 0.75) AS is_train
FROM (SELECT segment_id, week_start,
             row_number() OVER (PARTITION BY segment_id ORDER BY week_start)::int AS row_idx,
             count(*) OVER (PARTITION BY segment_id)::bigint AS n_weeks
      FROM panel)""")
def time_split(spark, sf_dir):
    """W8."""
    return fe.time_split(hourly_panel(spark, sf_dir)).select("segment_id", "week_start", "row_idx", "n_weeks", "is_train")


@register("supplier_panel_summary", with_(segment="supplier") + f"""
SELECT segment_id, count(*)::bigint AS n_weeks, sum(total_crashes)::bigint AS total,
  {r('avg(crashes_rolling_mean_4w)', 'mean_rolling_4w')}, {r('max(crashes_rolling_std_12w)', 'max_rolling_std_12w')},
  max(crashes_lag_12w)::bigint AS max_lag_12w, min(week_start) AS first_week, max(week_start) AS last_week
FROM panel GROUP BY segment_id""")
def supplier_panel_summary(spark, sf_dir):
    """A1–A3, W1–W6 at many segments: the feature panel keyed by supplier, summarised per segment."""
    p = hourly_panel(spark, sf_dir, "supplier")
    return tidy(p.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n_weeks"), F.sum("total_crashes").cast("bigint").alias("total"),
        F.avg("crashes_rolling_mean_4w").alias("mean_rolling_4w"),
        F.max("crashes_rolling_std_12w").alias("max_rolling_std_12w"),
        F.max("crashes_lag_12w").cast("bigint").alias("max_lag_12w"),
        F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week")))


_NL = ",\n  ".join(
    f"{r(f'coalesce(avg(total_crashes) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)', f'crashes_rolling_mean_{n}w')},\n  "
    f"{r(f'coalesce(stddev_samp(total_crashes) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)', f'crashes_rolling_std_{n}w')},\n  "
    f"{r(f'coalesce(max(total_crashes) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)', f'crashes_rolling_max_{n}w')}"
    for n in fe.ROLL_WINDOWS)


@register("rolling_features_nonleaky", with_() + f"""
SELECT segment_id, week_start,
  {_NL}
FROM cal WINDOW w AS (PARTITION BY segment_id ORDER BY week_start)""")
def rolling_features_nonleaky(spark, sf_dir):
    """W2–W4 with ``leaky=False`` (Q3 fix): windows end at the previous week, no change features."""
    w = fe.weekly_rollup(fe.add_hourly_features(fx.hourly(spark, sf_dir)))
    p = fe.add_lag_features(fe.add_week_calendar(fe.densify_weeks(w)), leaky=False)
    return tidy(p.select("segment_id", "week_start", *fe.rolling_names()))
