"""Check queries for seasonal baseline, stand-in ensemble scoring and evaluation.

The deterministic stand-ins for the three models are the train seasonal
baseline, last week's value and the 4-week rolling mean; they exercise every
given-prediction operator (M5, M6, E1–E8) exactly, independent of MLlib.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segcast.operators import evaluate as ev
from segcast.operators import features as fe
from segcast.operators import seasonal as se
from segcast.plans.common import register, tidy
from segcast.plans.oracle import r, rcols, with_
from segcast.plans.q_features import hourly_panel, stored_panel

PRED_COLS = ["pred_a", "pred_b", "pred_c"]


def standin_scored(spark: SparkSession, sf_dir: str, segment: str = "nation", panel: DataFrame | None = None) -> DataFrame:
    """Panel rows with the train/test flag, seasonal baseline and three stand-in predictions."""
    sp = se.seasonal_baseline(fe.time_split(stored_panel(spark, sf_dir, segment) if panel is None else panel))
    return sp.withColumns({
        "pred_a": F.col("baseline_pred"),
        "pred_b": F.col("crashes_lag_1w").cast("double"),
        "pred_c": F.col("crashes_rolling_mean_4w"),
    })


def standin_intervals(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """Test rows with M6 intervals, residual std taken from the training rows (M5)."""
    sc = standin_scored(spark, sf_dir, panel=panel)
    res = ev.residual_stats(sc.where("is_train"), "total_crashes", PRED_COLS)
    test = sc.where(~F.col("is_train")).join(res.select("segment_id", "residual_std"), "segment_id")
    return ev.predict_interval(test, PRED_COLS)


def standin_metrics(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    iv = standin_intervals(spark, sf_dir, panel)
    return ev.model_metrics_long(iv, "total_crashes", {"baseline": "baseline_pred", "ensemble": "pred_mean"})


SCORED = """
split AS (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY week_start) AS row_idx,
         count(*) OVER (PARTITION BY segment_id) AS n_weeks FROM panel),
split2 AS (SELECT *, row_idx <= floor(n_weeks * 0.75) AS is_train FROM split),
tr_season AS (SELECT segment_id, week_of_year, avg(total_crashes::double) AS sm FROM split2 WHERE is_train GROUP BY 1, 2),
tr_mean AS (SELECT segment_id, avg(total_crashes::double) AS tm FROM split2 WHERE is_train GROUP BY 1),
scored AS (
  SELECT s.*, coalesce(a.sm, b.tm) AS baseline_pred, coalesce(a.sm, b.tm) AS pred_a,
         s.crashes_lag_1w::double AS pred_b, s.crashes_rolling_mean_4w AS pred_c
  FROM split2 s LEFT JOIN tr_season a USING (segment_id, week_of_year) LEFT JOIN tr_mean b USING (segment_id)),
resid AS (
  SELECT segment_id, stddev_pop(total_crashes - (pred_a + pred_b + pred_c) / 3) AS residual_std,
         quantile_cont(total_crashes - (pred_a + pred_b + pred_c) / 3, 0.05) AS q05,
         quantile_cont(total_crashes - (pred_a + pred_b + pred_c) / 3, 0.25) AS q25,
         quantile_cont(total_crashes - (pred_a + pred_b + pred_c) / 3, 0.5) AS q50,
         quantile_cont(total_crashes - (pred_a + pred_b + pred_c) / 3, 0.95) AS q95,
         count(*)::bigint AS n_train
  FROM scored WHERE is_train GROUP BY 1),
iv0 AS (
  SELECT s.*, r.residual_std, (pred_a + pred_b + pred_c) / 3 AS m
  FROM scored s JOIN resid r USING (segment_id) WHERE NOT is_train),
iv1 AS (SELECT *, sqrt(((pred_a - m)^2 + (pred_b - m)^2 + (pred_c - m)^2) / 3) AS model_std FROM iv0),
iv AS (
  SELECT *, greatest(m, 0) AS pred_mean,
         greatest(m - 1.96 * sqrt(residual_std^2 + model_std^2), 0) AS pred_lower,
         greatest(m + 1.96 * sqrt(residual_std^2 + model_std^2), 0) AS pred_upper
  FROM iv1),
long AS (
  SELECT segment_id, 'baseline' AS model, total_crashes::double AS y, baseline_pred AS p FROM iv
  UNION ALL SELECT segment_id, 'ensemble', total_crashes::double, pred_mean FROM iv),
met0 AS (
  SELECT segment_id, model, count(*)::bigint AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p)^2)) AS rmse,
         sum((y - p)^2) AS sse, var_pop(y) * count(*) AS sst,
         avg(abs((y - p) / CASE WHEN y = 0 THEN 1 ELSE y END)) * 100 AS mape
  FROM long GROUP BY 1, 2),
met AS (
  SELECT *, CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM met0)"""


@register("seasonal_profile", with_("""
prof AS (SELECT segment_id, week_of_year, avg(total_crashes::double) AS seasonal_mean,
                stddev_samp(total_crashes::double) AS seasonal_std, min(total_crashes)::double AS seasonal_min,
                max(total_crashes)::double AS seasonal_max, count(*)::bigint AS seasonal_n
         FROM panel GROUP BY 1, 2),
rng AS (SELECT segment_id, min(seasonal_mean) AS seasonal_low, max(seasonal_mean) AS seasonal_high FROM prof GROUP BY 1)""")
 + f"""SELECT p.segment_id, week_of_year, seasonal_n,
  {rcols(['seasonal_mean', 'seasonal_std', 'seasonal_min', 'seasonal_max', 'seasonal_low', 'seasonal_high'])}
FROM prof p JOIN rng USING (segment_id)""")
def seasonal_profile(spark, sf_dir):
    """B1, B6."""
    prof = se.seasonal_profile(hourly_panel(spark, sf_dir))
    rng = se.seasonal_range(prof).drop("peak_week")
    return tidy(prof.join(rng, "segment_id").select(
        "segment_id", "week_of_year", "seasonal_n", "seasonal_mean", "seasonal_std", "seasonal_min",
        "seasonal_max", "seasonal_low", "seasonal_high"))


@register("overall_stats", with_() + f"""
SELECT segment_id, {r('avg(total_crashes)', 'overall_mean')}, {r('stddev_samp(total_crashes)', 'overall_std')},
       count(*)::bigint AS n_weeks, min(week_start) AS first_week, max(week_start) AS last_week
FROM panel GROUP BY segment_id""")
def overall_stats(spark, sf_dir):
    """B2, W11."""
    return tidy(se.overall_stats(hourly_panel(spark, sf_dir)))


@register("seasonal_baseline", with_(SCORED) + f"""
SELECT segment_id, week_start, week_of_year, total_crashes, {r('baseline_pred', 'baseline_pred')}
FROM scored WHERE NOT is_train""")
def seasonal_baseline(spark, sf_dir):
    """Train ISO-week mean mapped onto test weeks (unseen week → train mean)."""
    sc = standin_scored(spark, sf_dir).where(~F.col("is_train"))
    return tidy(sc.select("segment_id", "week_start", "week_of_year", "total_crashes", "baseline_pred"))


@register("baseline_metrics", with_(SCORED) + f"""
SELECT segment_id, model, n, {rcols(['mae', 'rmse', 'r2'])} FROM met""")
def baseline_metrics(spark, sf_dir):
    """Holdout MAE/RMSE/R² of the seasonal baseline and the (stand-in) ensemble."""
    return tidy(standin_metrics(spark, sf_dir).select("segment_id", "model", "n", "mae", "rmse", "r2"))


@register("baseline_mape", with_(SCORED) + f"""
SELECT segment_id, model, {r('mape', 'mape')} FROM met""")
def baseline_mape(spark, sf_dir):
    """E2."""
    return tidy(standin_metrics(spark, sf_dir).select("segment_id", "model", "mape"))


@register("residual_stats", with_(SCORED) + f"""
SELECT segment_id, n_train, {rcols(['residual_std', 'q05', 'q25', 'q50', 'q95'])} FROM resid""")
def residual_stats(spark, sf_dir):
    """M5: population std and exact quantiles of training residuals."""
    sc = standin_scored(spark, sf_dir).where("is_train")
    return tidy(ev.residual_stats(sc, "total_crashes", PRED_COLS))


@register("predict_interval", with_(SCORED) + f"""
SELECT segment_id, week_start, total_crashes,
  {rcols(['model_std', 'pred_mean', 'pred_lower', 'pred_upper'])},
  {r('pred_mean - pred_lower', 'lower_error')}, {r('pred_upper - pred_mean', 'upper_error')}
FROM iv""")
def predict_interval(spark, sf_dir):
    """M6, F10, E7."""
    iv = ev.error_bars(standin_intervals(spark, sf_dir))
    return tidy(iv.select("segment_id", "week_start", "total_crashes", "model_std", "pred_mean", "pred_lower",
                          "pred_upper", "lower_error", "upper_error"))


@register("interval_quality", with_(SCORED) + f"""
SELECT segment_id,
  {r('avg(((total_crashes >= pred_lower) AND (total_crashes <= pred_upper))::int::double) * 100', 'coverage_pct')},
  {r('avg(pred_upper - pred_lower)', 'avg_width')},
  {r('avg(pred_mean - pred_lower)', 'avg_lower_error')},
  {r('avg(pred_upper - pred_mean)', 'avg_upper_error')}
FROM iv GROUP BY segment_id""")
def interval_quality(spark, sf_dir):
    """Coverage %, mean interval width and error-bar sizes per segment."""
    return tidy(ev.interval_quality(standin_intervals(spark, sf_dir)))


@register("model_improvement", with_(SCORED, """
imp AS (
  SELECT segment_id,
         max(CASE WHEN model = 'baseline' THEN mae END) AS mae_baseline,
         max(CASE WHEN model = 'ensemble' THEN mae END) AS mae_model,
         max(CASE WHEN model = 'baseline' THEN r2 END) AS r2_baseline,
         max(CASE WHEN model = 'ensemble' THEN r2 END) AS r2_model
  FROM met GROUP BY 1)""") + f"""
SELECT segment_id, {rcols(['mae_baseline', 'mae_model', 'r2_baseline', 'r2_model'])},
  {r('CASE WHEN r2_baseline <> 0 THEN (r2_model - r2_baseline) / abs(r2_baseline) * 100 END', 'r2_improvement_pct')},
  {r('CASE WHEN mae_baseline <> 0 THEN (mae_baseline - mae_model) / mae_baseline * 100 END', 'mae_improvement_pct')}
FROM imp""")
def model_improvement(spark, sf_dir):
    """E5."""
    return tidy(ev.improvement(standin_metrics(spark, sf_dir)))


@register("metrics_long", with_(SCORED) + f"""
SELECT segment_id, model, metric, {r('value', 'value')}
FROM met UNPIVOT (value FOR metric IN (mae, rmse, r2))""")
def metrics_long(spark, sf_dir):
    """Per-model metrics in long form."""
    return tidy(ev.metrics_long(standin_metrics(spark, sf_dir)))
