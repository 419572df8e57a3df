import datetime as dt

from pyspark.sql import functions as F

from segcast.functions import labels as lb
from segcast.functions.numeric import round_half_even


def test_risk_scales_and_bins(spark):
    vals = [0.0, 0.5, 0.99, 1.0, 1.5, 2.0, 2.5, 4.0, 10.0, 10.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    rows = df.select("v", lb.risk_level_5(F.col("v")).alias("r5"), lb.risk_bin(F.col("v")).alias("b"),
                     lb.risk_bin(F.col("v"), parity=True).alias("pb"),
                     lb.interpretation(F.col("v")).alias("t")).collect()
    by = {r["v"]: r for r in rows}
    assert by[0.5]["r5"] == "Low Risk" and by[0.0]["r5"] == "Very Low Risk" and by[2.0]["r5"] == "Very High Risk"
    assert by[0.0]["b"] == by[0.5]["b"] == "Very Low" and by[10.0]["b"] == by[10.5]["b"] == "Very High"
    assert by[0.0]["pb"] is None and by[10.5]["pb"] is None and by[0.5]["pb"] == "Very Low" and by[10.0]["pb"] == "Very High"
    assert by[1.0]["b"] == "Low" and by[1.5]["b"] == "Moderate"
    assert by[0.0]["t"] == "0% chance of a crash" and by[1.0]["t"] == "Likely 1 crash(es)"
    assert by[2.5]["t"] == "Likely 2-3 crashes"


def test_strings(spark):
    df = spark.createDataFrame([("I0040_Seg26", "segment_01", dt.date(2025, 1, 13))], "rs string, id string, w date")
    r = df.select(lb.segment_display_name(F.col("rs"), F.col("id")).alias("n"), lb.week_label(F.col("w")).alias("l"),
                  lb.normalize_route(F.lit("I0055")).alias("a"), lb.normalize_route(F.lit("I240")).alias("b"),
                  lb.crash_range(F.lit(0.73), F.lit(1.34)).alias("c"), lb.month_name(F.col("w")).alias("m")).first()
    assert r["n"] == "I-40 Seg26" and r["l"] == "Jan 13 – Jan 19, 2025" and r["a"] == "I-55" and r["b"] == "I-240"
    assert r["c"] == "0-2" and r["m"] == "January"
    unk = df.select(lb.segment_display_name(F.lit(None).cast("string"), F.col("id"))).first()[0]
    assert unk == "segment_01"


def test_bucket_mode_first_max(spark):
    df = spark.createDataFrame([(36.8, 36.8, 18.4, 6.1, 1.9)], "a double, b double, c double, d double, e double")
    lab, p = lb.bucket_mode([F.col(c) for c in "abcde"])
    r = df.select(lab, p).first()
    assert r[0] == "0" and r[1] == 36.8


def test_round_half_even_binary(spark):
    df = spark.createDataFrame([(1.225,), (0.285,), (2.5,), (-0.0,)], "x double")
    got = [r[0] for r in df.select(round_half_even(F.col("x"), 2)).collect()]
    assert got == [round(1.225, 2), round(0.285, 2), 2.5, 0.0]
