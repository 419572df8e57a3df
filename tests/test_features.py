"""Edge literals of the hourly features, weekly roll-up, densification and window features."""

import datetime as dt

from pyspark.sql import functions as F

from segcast.operators import features as fe
from segcast.sources.io import HOURLY_SCHEMA
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("segment_id", T.StringType())] + HOURLY_SCHEMA.fields)


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_hourly_features_edges(spark):
    ts = dt.datetime(2024, 1, 1, 8)
    df = _rows(spark, [("a", ts, 1, 50.0, 55.0, 0.0, 1.0, 8, 0),     # reference speed 0 → ratio uses 1
                       ("a", ts, 0, None, 55.0, 60.0, 1.0, 23, 1)])  # missing speed → congestion 0
    out = fe.add_hourly_features(df).orderBy(F.col("speed").desc_nulls_last()).collect()
    assert out[0]["speed_ratio"] == 50.0 and out[0]["speed_deviation"] == 5.0
    assert out[0]["is_rush_hour"] == 1 and out[0]["is_night"] == 0 and out[0]["is_peak_crash_hour"] == 0
    assert out[0]["congestion_indicator"] == 0  # 50 < 0*0.7 is false
    assert out[1]["congestion_indicator"] == 0 and out[1]["speed_ratio"] is None and out[1]["is_night"] == 1


def test_week_label_closing_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 8, 23, 59),), (dt.datetime(2024, 1, 9, 0, 0),),
                                (dt.datetime(2020, 12, 28, 12),)], "ts timestamp_ntz")
    got = [r[0] for r in df.select(fe.week_label(F.col("ts"))).collect()]
    assert got == [dt.date(2024, 1, 8), dt.date(2024, 1, 15), dt.date(2020, 12, 28)]
    wk = spark.createDataFrame([(dt.date(2020, 12, 28),)], "d date").select(F.weekofyear("d")).first()[0]
    assert wk == 53


def test_rollup_densify_and_lags(spark):
    rows = []
    # week 1 (label 2024-01-08): two hours; week 2 empty; week 3 (label 2024-01-22): one hour
    rows.append(("a", dt.datetime(2024, 1, 2, 1), 1, 40.0, 50.0, 40.0, 1.0, 1, 0))
    rows.append(("a", dt.datetime(2024, 1, 8, 23), 2, 60.0, 50.0, 40.0, 3.0, 23, 0))
    rows.append(("a", dt.datetime(2024, 1, 16, 5), 4, 30.0, 50.0, 40.0, 2.0, 5, 0))
    panel = fe.weekly_panel(_rows(spark, rows)).orderBy("week_start").collect()
    assert [r["week_start"] for r in panel] == [dt.date(2024, 1, 8), dt.date(2024, 1, 15), dt.date(2024, 1, 22)]
    w1, w2, w3 = panel
    assert w1["total_crashes"] == 3 and w1["avg_speed"] == 50.0 and w1["total_night_hours"] == 2
    assert w2["total_crashes"] == 0 and w2["avg_speed"] == 0.0          # empty week: sums 0, stats NULL → 0
    assert w3["total_crashes"] == 4 and w3["std_speed"] == 0.0          # single observation: std NULL → 0
    assert w3["crashes_lag_1w"] == 0 and w3["crashes_lag_2w"] == 3 and w3["crash_change_1w"] == 4
    assert w3["crashes_rolling_mean_2w"] == 2.0 and w3["crashes_rolling_max_4w"] == 4.0


def test_densify_fills_gap(spark):
    weekly = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1), 2, 10.0), ("a", dt.date(2024, 1, 22), 1, 20.0), ("b", dt.date(2024, 1, 1), 5, 1.0)],
        "segment_id string, week_start date, total_crashes bigint, avg_speed double")
    d = fe.densify_weeks(weekly).orderBy("segment_id", "week_start").collect()
    assert [(r["segment_id"], r["week_start"].isoformat(), r["total_crashes"], r["avg_speed"]) for r in d] == [
        ("a", "2024-01-01", 2, 10.0), ("a", "2024-01-08", 0, None), ("a", "2024-01-15", 0, None),
        ("a", "2024-01-22", 1, 20.0), ("b", "2024-01-01", 5, 1.0)]


def test_leakage_identity_and_non_leaky(spark):
    panel = fe.weekly_panel(__import__("segcast.sources.fixtures", fromlist=["hourly"]).hourly(spark, "/root/testdata/sf0.001"))
    w = panel.withColumn("rn", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window
                                                   .partitionBy("segment_id").orderBy("week_start")))
    bad = w.where((F.col("rn") >= 2) & (F.col("total_crashes") != F.col("crashes_lag_1w") + F.col("crash_change_1w")))
    assert bad.count() == 0
    nl = fe.add_lag_features(fe.add_week_calendar(fe.densify_weeks(fe.weekly_rollup(fe.add_hourly_features(
        __import__("segcast.sources.fixtures", fromlist=["hourly"]).hourly(spark, "/root/testdata/sf0.001"))))),
        leaky=False)
    assert "crash_change_1w" not in nl.columns
    # non-leaky rolling mean over 2 weeks ends at t-1: equals the mean of lag1 and lag2 when both exist
    chk = nl.withColumn("rn", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window
                                                  .partitionBy("segment_id").orderBy("week_start")))
    off = chk.where((F.col("rn") >= 3) & (F.abs(F.col("crashes_rolling_mean_2w")
                                                 - (F.col("crashes_lag_1w") + F.col("crashes_lag_2w")) / 2) > 1e-9))
    assert off.count() == 0


def test_centered_average_needs_full_window(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(weeks=i), float(i)) for i in range(5)],
                               "segment_id string, week_start date, total_crashes double")
    got = [r["trend"] for r in fe.centered_moving_average(df).orderBy("week_start").collect()]
    assert got == [None, None, 1.5, 2.5, None]


def test_time_split_floor(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(weeks=i)) for i in range(7)],
                               "segment_id string, week_start date")
    got = [r["is_train"] for r in fe.time_split(df).orderBy("week_start").collect()]
    assert got == [True] * 5 + [False] * 2  # floor(7 * 0.75) = 5


def test_segment_independence_and_contiguity(spark):
    from pyspark.sql import Window
    from segcast.sources import fixtures as fx
    hourly = fx.hourly(spark, "/root/testdata/sf0.001")
    seg = hourly.select("segment_id").orderBy("segment_id").first()[0]
    together = fe.weekly_panel(hourly).where(F.col("segment_id") == seg)
    alone = fe.weekly_panel(hourly.where(F.col("segment_id") == seg))
    cols = [c for c in together.columns]
    assert together.select(*cols).exceptAll(alone.select(*cols)).count() == 0
    assert alone.select(*cols).exceptAll(together.select(*cols)).count() == 0
    w = Window.partitionBy("segment_id").orderBy("week_start")
    gaps = fe.weekly_panel(hourly).select(F.datediff("week_start", F.lag("week_start").over(w)).alias("d")) \
        .where(F.col("d").isNotNull()).distinct().collect()
    assert [r["d"] for r in gaps] == [7]
