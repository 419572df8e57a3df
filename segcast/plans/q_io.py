"""Check queries for the CSV sources: data is written in the source layout, then read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segcast.operators import analytics as an
from segcast.operators import features as fe
from segcast.plans.common import ORACLE, register, tidy
from segcast.plans.oracle import r, with_
from segcast.plans.q_eval import standin_metrics
from segcast.plans.q_forecast import N_RISK, risk_sql, standin_risk_forecast
from segcast.plans.q_panel import _standin_summary
from segcast.session import ensure_checkpoint_dir
from segcast.sources import fixtures as fx
from segcast.sources import io


def _scratch(spark, tag: str) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{tag}-{uuid.uuid4().hex}"


@register("csv_sources", ORACLE["hourly_profile"])
def csv_sources(spark, sf_dir):
    """Per-segment hourly CSVs (``NPMRDS2`` header, file named by route/segment code)
    → one glob scan, id from the path mapped through the registry → profile."""
    reg = fx.registry(spark, sf_dir)
    hourly = fx.hourly(spark, sf_dir).join(reg, "segment_id")
    base = _scratch(spark, "hourly-csv")
    (hourly.drop("segment_id").withColumnRenamed("npmrds", "NPMRDS2")
           .write.partitionBy("route_segment").option("header", True)
           .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(base))
    back = io.read_segments(spark, f"{base}/route_segment=*/*.csv", registry=reg,
                            pattern=r"route_segment=([^/]+)/")
    return io.profile(back)


@register("event_csv", ORACLE["day_night"])
def event_csv(spark, sf_dir):
    """S5 (+ Q18): event records with spaced source headers, light column found by name → day/night split."""
    ev = fx.event_records(spark, sf_dir)
    src = ev.withColumnsRenamed({v: k for k, v in io.EVENT_HEADERS.items()}).withColumnRenamed(
        "light_condition", "Light Condition")
    base = _scratch(spark, "event-csv")
    src.write.option("header", True).csv(base)
    return an.day_night(io.read_event_records(spark, base))


@register("weekly_history_csv", with_() + "SELECT segment_id, count(*)::bigint AS n_weeks, sum(total_crashes)::double AS total, "
            "min(week_start) AS first_week, max(week_start) AS last_week FROM panel GROUP BY segment_id")
def weekly_history_csv(spark, sf_dir):
    """S4 + S7: weekly panel written per segment, read back by the history reader (absent path → empty)."""
    panel = fe.weekly_panel(fx.hourly(spark, sf_dir)).select("segment_id", "week_start", "total_crashes")
    base = _scratch(spark, "weekly-csv")
    io.write_partitioned(panel, base, fmt="csv")
    back = io.read_weekly_history(spark, base)
    missing = io.read_weekly_history(spark, base + "-absent")
    assert missing.columns == ["week_start", "total_crashes"]
    return back.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_weeks"), F.sum("total_crashes").alias("total"),
                                          F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week"))


@register("segment_rerun", with_() + """
SELECT segment_id, count(*)::bigint AS n_weeks,
  sum(CASE WHEN right(segment_id, 1) = '3' THEN 2 * total_crashes ELSE total_crashes END)::bigint AS total
FROM panel WHERE right(segment_id, 1) != '3' OR year(week_start) > 1994 GROUP BY segment_id""")
def segment_rerun(spark, sf_dir):
    """A bucketed panel whose segments ending in 3 are made anew (other weeks, doubled) and replaced; the others stay."""
    panel = fe.weekly_panel(fx.hourly(spark, sf_dir)).select("segment_id", "week_start", "total_crashes")
    base = _scratch(spark, "rerun")
    io.write_partitioned(panel, base)
    again = spark.read.parquet(base).where((F.substring("segment_id", -1, 1) == "3") & (F.year("week_start") > 1994))
    io.replace_segments(again.withColumn("total_crashes", F.col("total_crashes") * 2).drop(io.BUCKET), base)
    return spark.read.parquet(base).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_weeks"), F.sum("total_crashes").alias("total"))


@register("mixed_headers", with_() + f"""
SELECT segment_id, count(*)::bigint AS n_rows, sum(crash_count)::bigint AS n_events, {r('sum(speed)', 'speed')}, {r('sum(npmrds)', 'npmrds')}
FROM hourly GROUP BY segment_id""")
def mixed_headers(spark, sf_dir):
    """One glob over files whose columns differ in order and name; counts written as 1.0."""
    hourly = fx.hourly(spark, sf_dir).withColumn("crash_count", F.col("crash_count").cast("double"))
    base = _scratch(spark, "mixed-csv")
    even = F.substring("segment_id", -1, 1).cast("int") % 2 == 0
    swapped = ["speed", "crash_count", "npmrds", "hour", "is_weekend", "timestamp", "reference_speed", "historical_average_speed"]
    for part, name, cols in ((even, "NPMRDS2", None), (~even, "NPMRDS2 2021", swapped)):
        rows = hourly.where(part)
        rows = rows.select("segment_id", *cols) if cols else rows
        (rows.withColumnRenamed("npmrds", name).write.mode("append").partitionBy("segment_id").option("header", True)
             .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(base))
    back = io.read_segments(spark, f"{base}/segment_id=*/*.csv", pattern=r"segment_id=([^/]+)/")
    return tidy(back.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("crash_count").cast("long").alias("n_events"),
                                               F.sum("speed").alias("speed"), F.sum("npmrds").alias("npmrds")))


@register("hourly_csv", with_() + """
SELECT hour, count(*)::bigint AS n_rows, sum(crash_count)::bigint AS n_events,
  count(*) FILTER (WHERE hour != 3)::bigint AS n_speeds, count(*) FILTER (WHERE hour = 3)::bigint AS n_bad
FROM hourly GROUP BY hour""")
def hourly_csv(spark, sf_dir):
    """Hourly CSV with counts written as 1.0 and malformed speeds, which are counted."""
    speed = F.when(F.col("hour") == 3, "n/a").otherwise(F.col("speed").cast("string"))
    hourly = fx.hourly(spark, sf_dir).drop("segment_id").withColumn("speed", speed)
    base = _scratch(spark, "hourly-one-csv")
    (hourly.withColumn("crash_count", F.col("crash_count").cast("double")).withColumnRenamed("npmrds", "NPMRDS2").write
           .option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(base))
    back = io.read_hourly(spark, base, bad_cells="n_bad")
    return back.groupBy("hour").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("crash_count").cast("long").alias("n_events"),
                                    F.count("speed").alias("n_speeds"), F.sum("n_bad").cast("long").alias("n_bad"))


@register("forecast_dates_csv", with_(risk_sql(N_RISK)) + """
SELECT segment_id, week_start, lam3 AS "lambda", risk_level FROM riskf""")
def forecast_dates_csv(spark, sf_dir):
    """S3: forecast CSV with ISO and slash dates in one column; absent paths, twice, add no row and no column."""
    f = standin_risk_forecast(spark, sf_dir, N_RISK)
    label = F.when(F.col("step") % 2 == 0, F.date_format("week_start", "M/d/yyyy")).otherwise(F.date_format("week_start", "yyyy-MM-dd"))
    base = _scratch(spark, "forecast-csv")
    f.select("segment_id", label.alias("week_start"), "lambda", "risk_level").write.option("header", True).csv(base)
    cols = ["segment_id", "week_start", "lambda", "risk_level"]
    back = io.read_forecast(spark, base).select(cols)
    for _ in range(2):
        back = back.unionByName(io.read_forecast(spark, f"{base}-absent").select(cols))
    return back


@register("metrics_csv", with_(risk_sql(N_RISK)) + f"""
SELECT model, count(*)::bigint AS n, {r('avg(mae)', 'mae')}, {r('avg(rmse)', 'rmse')}, {r('avg(r2)', 'r2')} FROM met GROUP BY model""")
def metrics_csv(spark, sf_dir):
    """Metrics CSV whose columns stand in another order, mapped by header."""
    m = standin_metrics(spark, sf_dir)
    base = _scratch(spark, "metrics-csv")
    m.select(F.col("r2").alias("R²"), F.col("model").alias("Model"), F.col("rmse").alias("RMSE"), F.col("mae").alias("MAE")
             ).write.option("header", True).csv(base)
    back = io.read_metrics(spark, base)
    return tidy(back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("mae", "rmse", "r2")]))


@register("summary_csv", ORACLE["segment_summary"])
def summary_csv(spark, sf_dir):
    """The segment summary written as CSV and read back."""
    summary = _standin_summary(spark, sf_dir)
    base = _scratch(spark, "summary-csv")
    io.write_summary(summary, base)
    back = spark.read.schema(summary.schema).option("header", True).csv(base)
    return tidy(back)


@register("display_csv", with_(risk_sql(N_RISK)) + """
SELECT segment_id, strftime(week_start, '%b %d, %Y') AS week_starting, (step + 1)::varchar AS week_no, risk_level AS risk,
  predicted_lower::varchar || '-' || predicted_upper::varchar AS expected_range
FROM riskf""")
def display_csv(spark, sf_dir):
    """The formatted forecast table exported as CSV and read back as text."""
    f = standin_risk_forecast(spark, sf_dir, N_RISK)
    shown = f.select("segment_id", F.date_format("week_start", "MMM dd, yyyy").alias("week_starting"), (F.col("step") + 1).alias("week_no"),
                     F.col("risk_level").alias("risk"), F.format_string("%d-%d", "predicted_lower", "predicted_upper").alias("expected_range"))
    base = _scratch(spark, "display-csv")
    io.export_display_table(shown, base)
    return spark.read.option("header", True).csv(base)
