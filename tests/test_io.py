"""Readers: mixed date formats, absent files, source headers, registry mapping, display export."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.errors import AnalysisException

from segcast.session import ensure_checkpoint_dir
from segcast.sources import io


def _dir(spark, tag):
    d = ensure_checkpoint_dir(spark).rstrip("/").replace("file:", "") + f"/{tag}-{uuid.uuid4().hex}"
    os.makedirs(d, exist_ok=True)
    return d


def test_read_forecast_mixed_dates_and_absent(spark):
    d = _dir(spark, "fc")
    with open(f"{d}/a.csv", "w") as f:
        f.write("week_start,lambda,most_likely_crashes,probability_%,risk_level,method\n"
                "1/13/2025,0.98,0,37.5,Very Low,ML\n2025-01-20,0.573,0,56.4,Very Low,ML\nbad,1.0,1,36.8,Low,ML\n")
    rows = io.read_forecast(spark, f"{d}/a.csv").orderBy("lambda").collect()
    assert [r["week_start"] for r in rows] == [dt.date(2025, 1, 20), dt.date(2025, 1, 13), None]
    assert rows[0]["probability_pct"] == 56.4
    empty = io.read_forecast(spark, f"{d}/missing.csv")
    assert empty.count() == 0 and "lambda" in empty.columns


def test_read_event_records_headers(spark):
    d = _dir(spark, "ev")
    with open(f"{d}/e.csv", "w") as f:
        f.write("Route,Segment ID,Year Of Crash,Date of Crash,Hit and Run,Light Conditions\n"
                "I0040,S1,2024,01/05/2024,Yes,Daylight\n")
    r = io.read_event_records(spark, f"{d}/e.csv").first()
    assert r["route"] == "I0040" and r["segment_id"] == "S1" and r["year_of_crash"] == 2024
    assert r["light_condition"] == "Daylight" and r["hit_and_run"] == "Yes"


def test_read_hourly_column_map(spark):
    d = _dir(spark, "hr")
    with open(f"{d}/I0040_Seg26_traffic_crash_merged.csv", "w") as f:
        f.write("timestamp,crash_count,speed,historical_average_speed,reference_speed,NPMRDS2 2021,hour,is_weekend\n"
                "2024-01-01 08:00:00,1,50.5,55,60,1.5,8,0\n")
    reg = spark.createDataFrame([("segment_01", "I0040_Seg26")], "segment_id string, route_segment string")
    r = io.read_segments(spark, f"{d}/*_traffic_crash_merged.csv", registry=reg).first()
    assert r["segment_id"] == "segment_01" and r["npmrds"] == 1.5 and r["timestamp"] == dt.datetime(2024, 1, 1, 8)
    h = io.read_hourly(spark, f"{d}/I0040_Seg26_traffic_crash_merged.csv", segment_id="x").first()
    assert h["segment_id"] == "x" and h["speed"] == 50.5


def test_export_display_table(spark):
    d = _dir(spark, "out")
    df = spark.createDataFrame([("Jan 13, 2025", 3, "0-2")], "week_starting string, week_no int, expected_range string")
    io.export_display_table(df, f"{d}/t")
    back = spark.read.option("header", True).csv(f"{d}/t").first()
    assert back["expected_range"] == "0-2"


def test_read_metrics_and_write_summary(spark):
    d = _dir(spark, "met")
    with open(f"{d}/m.csv", "w") as f:
        f.write("Model,MAE,RMSE,R²\nBaseline (Seasonal),1.217,1.5035,-0.657\nML Ensemble (Mean),0.0724,0.1095,0.9912\n")
    m = {r["model"]: r for r in io.read_metrics(spark, f"{d}/m.csv").collect()}
    assert m["Baseline (Seasonal)"]["r2"] == -0.657 and m["ML Ensemble (Mean)"]["mae"] == 0.0724
    io.write_summary(spark.createDataFrame([("s1", 1.0)], "segment_id string, forecast_total double"), f"{d}/summary")
    back = spark.read.option("header", True).csv(f"{d}/summary")
    assert back.count() == 1


def test_headers_per_file_lenient_cells_and_absent_paths(spark):
    d = _dir(spark, "mix")
    with open(f"{d}/a_traffic_crash_merged.csv", "w") as f:
        f.write("timestamp,crash_count,speed,NPMRDS2,hour\n2024-01-01 08:00:00,1.0,50.5,1.5,8\n2024-01-01 09:00:00,x,oops,,9\n")
    with open(f"{d}/b_traffic_crash_merged.csv", "w") as f:
        f.write("speed,crash_count,timestamp,NPMRDS2 2021,hour\n40.5,2,1/2/2024 7:00,2.5,7\n")
    open(f"{d}/c_traffic_crash_merged.csv", "w").close()
    rows = {(r["segment_id"], r["hour"]): r for r in io.read_segments(spark, f"{d}/*.csv", bad_cells="bad").collect()}
    assert len(rows) == 3
    assert (rows["a", 8]["crash_count"], rows["a", 8]["speed"], rows["a", 8]["npmrds"], rows["a", 8]["bad"]) == (1, 50.5, 1.5, 0)
    assert (rows["b", 7]["crash_count"], rows["b", 7]["speed"], rows["b", 7]["npmrds"]) == (2, 40.5, 2.5)
    assert rows["b", 7]["timestamp"] == dt.datetime(2024, 1, 2, 7)
    assert (rows["a", 9]["crash_count"], rows["a", 9]["speed"], rows["a", 9]["bad"]) == (None, None, 2)
    for _ in range(2):
        empty = io.read_forecast(spark, f"{d}/none.csv")
        assert empty.columns.count("segment_id") == 1 and empty.select("segment_id").count() == 0
    assert io.read_weekly_history(spark, f"{d}/none.csv").count() == 0
    with pytest.raises(AnalysisException):
        io.read_weekly_history(spark, f"{d}/b_traffic_crash_merged.csv")  # there, but without a week_start


def test_bucketed_writer_keeps_segments_together(spark):
    d = _dir(spark, "buckets")
    df = spark.range(300).selectExpr("concat('s', id % 100) AS segment_id", "date'2024-01-01' AS week_start", "id AS total_crashes")
    io.write_partitioned(df, f"{d}/w", fmt="csv", buckets=8)
    assert len([x for x in os.listdir(f"{d}/w") if x.startswith(io.BUCKET)]) <= 8
    back = io.read_weekly_history(spark, f"{d}/w")
    assert back.columns == ["week_start", "total_crashes", "segment_id"] and back.count() == 300


def test_headers_of_5000_files_come_from_executors(spark):
    """Each file by its own header, without a file opened or listed by name in the driver."""
    d = _dir(spark, "many")
    want = 0
    for i in range(5000):
        with open(f"{d}/S{i}_traffic_crash_merged.csv", "w") as f:
            cells = [("timestamp", "2024-01-01 08:00:00"), ("crash_count", "1"), ("speed", str(i % 7)), ("hour", "8")]
            cells = cells[::-1] if i % 3 == 0 else cells + [("NPMRDS2", "2.5")] if i % 3 == 1 else cells
            f.write(",".join(k for k, _ in cells) + "\n" + ",".join(v for _, v in cells) + "\n")
        want += i % 7
    open(f"{d}/S_empty_traffic_crash_merged.csv", "w").close()
    r = io.read_segments(spark, d).selectExpr(
        "count(distinct segment_id) n", "sum(crash_count) c", "sum(speed) s", "sum(npmrds) p", "count(timestamp) t").first()
    assert (r["n"], r["c"], r["s"], r["p"], r["t"]) == (5000, 5000, want, 1667 * 2.5, 5000)


def test_header_pass_stops_early_and_reads_odd_headers(spark):
    d = _dir(spark, "odd")
    with open(f"{d}/a.csv", "w", encoding="utf-8") as f:
        f.write('﻿"speed, mean",Speed,speed\n' + '"1,5",2,3\n' * 200_000)
    with open(f"{d}/b.csv", "w") as f:
        f.write("SPEED\n7\n")
    with open(f"{d}/c.csv", "w") as f:
        f.write("speed,x\n8\n9,y,too many\n")
    assert io._headers(spark, d).count() == 3
    df = io.read_csv(spark, d)
    assert {c.lower() for c in df.columns} == {"speed, mean", "speed", "x", "file_path"}
    rows = df.groupBy("speed").count().collect()
    assert {r[0]: r[1] for r in rows} == {"2": 200_000, "7": 1, "8": 1, "9": 1}
    assert [r["x"] for r in df.where("speed = '9'").collect()] == ["y"]


def test_replace_segments_leaves_other_buckets(spark):
    base = _dir(spark, "buckets") + "/t"
    df = spark.range(400).selectExpr("concat('s', id % 40) AS segment_id", "id AS week", "cast(1 as double) AS v")
    io.write_partitioned(df.where("segment_id != 's7'"), base, buckets=8)
    files = {os.path.join(p, f): os.stat(os.path.join(p, f)).st_mtime_ns for p, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}
    redo = spark.createDataFrame([("s7", 1, 9.0), ("s7", 2, 9.0), ("s8", 1, 9.0)], "segment_id string, week long, v double")
    io.replace_segments(redo, base, buckets=8)
    back = spark.read.parquet(base)
    got = {r[0]: (r[1], r[2]) for r in back.groupBy("segment_id").agg({"v": "sum", "week": "count"}).select("segment_id", "count(week)", "sum(v)").collect()}
    assert got == {**{f"s{i}": (10, 10.0) for i in range(40)}, "s7": (2, 18.0), "s8": (1, 9.0)}
    mine = {r[0] for r in redo.select(io._bucket("segment_id", 8)).distinct().collect()}
    for f, t in files.items():
        if not any(f"{io.BUCKET}={b}/" in f for b in mine):
            assert os.stat(f).st_mtime_ns == t
    with pytest.raises(Exception, match="not written with 5 buckets"):
        io.replace_segments(redo, base, buckets=5)
    io.replace_segments(redo.limit(0), base, buckets=8)
    io.replace_segments(redo, base + "-new", buckets=8)
    assert spark.read.parquet(base + "-new").count() == 3
