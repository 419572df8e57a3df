"""Check queries for models, the flagship panel run, segment status/summary and CSV round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segcast.operators import features as fe
from segcast.operators import models as md
from segcast.plans import panel as pn
from segcast.functions import labels as lb
from segcast.plans.common import ORACLE, register, tidy
from segcast.plans.oracle import r, with_
from segcast.plans.q_eval import SCORED, standin_metrics
from segcast.plans.q_features import hourly_panel, stored_panel
from segcast.plans.q_forecast import N_LONG, N_RISK, fut_sql, risk_sql, standin_risk_forecast
from segcast.session import ensure_checkpoint_dir, store
from segcast.sources import fixtures as fx
from segcast.sources import io

# The queries over fitted models are invariant checks: SQL cannot refit the models, so it states what must hold of
# every fitted value (who is scored, how the mean follows from its members, normal equations, bands and bounds).  A match
# proves these properties, not the model values; entry() and panel.run_panel return the predictions themselves.

VALID = """
ok AS (SELECT segment_id FROM panel GROUP BY 1 HAVING floor(count(*) * 0.75) >= 2 AND count(*) - floor(count(*) * 0.75) >= 1)"""


def _scored_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, md.Ensemble]:
    """Panel rows with baseline and the three model scores, and the fitted ensemble."""
    _, sp = pn.training_frame(stored_panel(spark, sf_dir))
    sp = store(sp, "training-frame")
    ens = md.fit_ensemble(sp.where("is_train"), md.feature_columns(sp), **md.PRESETS["default"])
    return ens.score(sp), ens


@register("ensemble_scores", with_(SCORED, VALID) + """
SELECT segment_id, week_start, total_crashes, true AS members_finite, true AS mean_of_members
FROM split2 JOIN ok USING (segment_id) WHERE NOT is_train""")
def ensemble_scores(spark, sf_dir):
    """M1, M2, M4 (checks): every holdout week has three finite predictions, and the clamped mean is theirs."""
    sc, _ = _scored_split(spark, sf_dir)
    finite = F.lit(True)
    for c in md.MODEL_COLS:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)
    mean = F.greatest((F.col("pred_rf") + F.col("pred_gb") + F.col("pred_ridge")) / 3, F.lit(0.0))
    return sc.where(~F.col("is_train")).select(
        "segment_id", "week_start", "total_crashes", finite.alias("members_finite"),
        (F.abs(F.col("ensemble_pred") - mean) < 1e-9).alias("mean_of_members"))


@register("ridge_scores", with_(SCORED, VALID) + """
SELECT segment_id, count(*)::bigint AS n_train, true AS solves_normal_equations
FROM split2 JOIN ok USING (segment_id) WHERE is_train GROUP BY 1""")
def ridge_scores(spark, sf_dir):
    """M3 (check): the per-segment ridge (α = 1) solves its normal equations to 1e-6 of their terms."""
    _, sp = pn.training_frame(stored_panel(spark, sf_dir))
    train = store(sp.where("is_train"), "ridge-train")
    cols = [c for c in md.feature_columns(train) if c != md.SEGMENT_MEAN]
    coefs = store(md.fit_ridge_per_segment(train, cols), "ridge")
    res = md.ridge_residuals(train, coefs, cols)
    return res.select("segment_id", "n_train", (F.col("residual") < 1e-6).alias("solves_normal_equations"))


@register("feature_importance", with_(SCORED, VALID) + """
SELECT count(*)::bigint AS n_train_rows, 47::bigint AS n_features, true AS none_negative, true AS sum_is_one, 15::bigint AS n_top
FROM split2 JOIN ok USING (segment_id) WHERE is_train""")
def feature_importance(spark, sf_dir):
    """M7 (check): random-forest importances of all features, none negative, their sum one; the top 15 of them."""
    sc, ens = _scored_split(spark, sf_dir)
    every = ens.feature_importance(spark, 10_000).agg(
        F.count(F.lit(1)).alias("n_features"), (F.min("importance") >= 0).alias("none_negative"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_one"))
    top = ens.feature_importance(spark, 15).agg(F.count(F.lit(1)).alias("n_top"))
    rows = sc.where("is_train").agg(F.count(F.lit(1)).alias("n_train_rows"))
    return rows.join(F.broadcast(every)).join(F.broadcast(top))  # three single rows


def _forecast_check_sql(n: int, cols: str) -> str:
    return with_(fut_sql(n), VALID) + f"""
SELECT segment_id, step, week_start, {cols} FROM fcal JOIN ok USING (segment_id)"""


_METHOD_SQL = "CASE WHEN step < 4 THEN 'ML' WHEN step < 12 THEN 'ML+Season' WHEN step < 24 THEN 'Hybrid' ELSE 'Seasonal' END AS method"


@register("risk_forecast_panel", _forecast_check_sql(N_RISK, f"""{_METHOD_SQL}, true AS bounds_hold, true AS probabilities_sum,
  true AS risk_follows, true AS interval_follows"""))
def risk_forecast_panel(spark, sf_dir):
    """Flagship (G1 over F/A/W/B/M/E/H/P, checks): the 12-week risk forecast of every segment."""
    f = pn.risk_forecast_panel_query(spark, sf_dir)
    lam = F.col("lambda")
    probs = sum(F.col(f"prob_{k}_crash") for k in (0, 1, 2, 3, "ge4"))
    near = F.lit(False)  # lambda is rounded to 3 decimals after the level was taken
    for bound in (1.0, 2.5, 4.0, 5.0):
        near = near | (F.abs(lam - bound) <= 0.0005)
    return f.select(
        "segment_id", "step", "week_start", "method",
        ((lam >= 0.01) & (F.col("predicted_lower") <= F.col("predicted_upper")) & (F.col("most_likely_crashes") >= 0)).alias("bounds_hold"),
        (F.abs(probs - 100) <= 0.5).alias("probabilities_sum"),
        (near | (F.col("risk_level") == lb.risk_level_4(lam))).alias("risk_follows"),
        (near | ((lam < 5) == (F.col("ci_method") == "Poisson"))).alias("interval_follows"))


BROKEN = "seg_03"


@register("failure_isolation", with_(fut_sql(2), VALID) + f"""
SELECT p.segment_id, CASE WHEN p.segment_id = '{BROKEN}' OR ok.segment_id IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN p.segment_id = '{BROKEN}' THEN true ELSE ok.segment_id IS NULL END AS has_reason,
  CASE WHEN p.segment_id = '{BROKEN}' OR ok.segment_id IS NULL THEN 0 ELSE 2 END::bigint AS n_forecast
FROM (SELECT DISTINCT segment_id FROM panel) p LEFT JOIN ok USING (segment_id)""")
def failure_isolation(spark, sf_dir):
    """G1: one segment's speeds are infinite; it is FAILED with a reason and has no forecast, the others are forecast."""
    speed = F.when(F.col("segment_id") == BROKEN, F.lit(float("inf"))).otherwise(F.col("speed"))
    run = pn.run_panel(fx.hourly(spark, sf_dir).withColumn("speed", speed), n_weeks=2,
                       model_params={"rf_trees": 3, "rf_depth": 3, "gbt_iter": 2})
    rows = run.forecast.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_forecast"))
    return run.status.join(rows, "segment_id", "left").select(
        "segment_id", "status", F.col("error").isNotNull().alias("has_reason"), F.coalesce("n_forecast", F.lit(0)).alias("n_forecast"))


@register("segment_status", with_("""
st AS (SELECT segment_id, count(*)::bigint AS n_weeks, floor(count(*) * 0.75)::bigint AS n_train FROM panel GROUP BY 1)""") + """
SELECT segment_id, n_weeks, n_train, n_weeks - n_train AS n_test,
  CASE WHEN n_train < 2 OR n_weeks - n_train < 1 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN n_train < 2 THEN 'only ' || n_train::varchar || ' training weeks'
       WHEN n_weeks - n_train < 1 THEN 'no test weeks' END AS error,
  count(*) OVER (PARTITION BY CASE WHEN n_train < 2 OR n_weeks - n_train < 1 THEN 'FAILED' ELSE 'SUCCESS' END)::bigint
    AS n_with_status
FROM st""")
def segment_status(spark, sf_dir):
    """Per-segment validation status and the count of segments per status."""
    st = pn.validate_segments(fe.time_split(hourly_panel(spark, sf_dir)))
    counts = st.groupBy("status").agg(F.count(F.lit(1)).alias("n_with_status"))  # G4: at most 2 rows
    return st.join(F.broadcast(counts), "status").select(
        "segment_id", "n_weeks", F.col("n_train").cast("bigint").alias("n_train"),
        F.col("n_test").cast("bigint").alias("n_test"), "status", "error", "n_with_status")


SUMMARY_SQL = risk_sql(N_RISK) + """,
summ AS (
  SELECT m.segment_id,
    max(CASE WHEN model = 'baseline' THEN mae END) AS mae_baseline, max(CASE WHEN model = 'baseline' THEN rmse END) AS rmse_baseline,
    max(CASE WHEN model = 'baseline' THEN r2 END) AS r2_baseline, max(CASE WHEN model = 'ensemble' THEN mae END) AS mae_ensemble,
    max(CASE WHEN model = 'ensemble' THEN rmse END) AS rmse_ensemble, max(CASE WHEN model = 'ensemble' THEN r2 END) AS r2_ensemble
  FROM met m GROUP BY 1),
ftot AS (SELECT segment_id, sum(lam3) AS forecast_total, count(*)::bigint AS horizon FROM riskf GROUP BY 1),
summary AS (SELECT * FROM summ JOIN (SELECT segment_id, count(*)::bigint AS total_historical_weeks FROM panel GROUP BY 1) h
            USING (segment_id) JOIN ftot USING (segment_id))"""


def _standin_summary(spark, sf_dir):
    panel = stored_panel(spark, sf_dir)
    st = pn.validate_segments(fe.time_split(panel))
    return pn.segment_summary(standin_metrics(spark, sf_dir, panel), standin_risk_forecast(spark, sf_dir, N_RISK, panel), st)


@register("segment_summary", with_(SUMMARY_SQL) + f"""
SELECT segment_id, {', '.join(r(c, c) for c in ['mae_baseline', 'rmse_baseline', 'r2_baseline', 'mae_ensemble',
                                                'rmse_ensemble', 'r2_ensemble', 'forecast_total'])},
  total_historical_weeks, horizon FROM summary""")
def segment_summary(spark, sf_dir):
    """G2 on the stand-in ensemble: metrics pivot, real history length, forecast total (Q11–Q13 fixed)."""
    return tidy(_standin_summary(spark, sf_dir))


@register("top_improvement", with_(SUMMARY_SQL) + """
SELECT segment_id, (round_even(mae_baseline, 2) + 0.0) AS mae_baseline, (round_even(mae_ensemble, 2) + 0.0) AS mae_ensemble,
  (round_even(mae_baseline - mae_ensemble, 2) + 0.0) AS mae_improvement, (round_even(forecast_total, 2) + 0.0) AS forecast_total
FROM summary ORDER BY mae_baseline - mae_ensemble DESC, segment_id LIMIT 5""")
def top_improvement(spark, sf_dir):
    """Top-5 segments by MAE reduction."""
    return pn.top_improvement(_standin_summary(spark, sf_dir))


@register("csv_roundtrip", with_(risk_sql(N_RISK)) + """
SELECT segment_id, week_start, lam3 AS "lambda", predicted_lower, predicted_upper, ci_method, model_uncertainty,
  residual_uncertainty, total_uncertainty, most_likely_crashes, probability_pct, risk_level, method,
  prob_0_crash, prob_1_crash, prob_2_crash, prob_3_crash, prob_ge4_crash FROM riskf""")
def csv_roundtrip(spark, sf_dir):
    """Write the forecast as per-segment CSV and read it back with the forecast reader.

    The files go under the session's shared checkpoint folder (a fresh
    sub-folder per call), never a machine-local path.
    """
    f = standin_risk_forecast(spark, sf_dir, N_RISK).drop("step", "week_of_year")
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/csv-roundtrip-{uuid.uuid4().hex}"
    io.write_partitioned(f.withColumnRenamed("probability_pct", "probability_%"), base, fmt="csv")
    back = io.read_forecast(spark, base)
    return back.select("segment_id", *[c for c in pn.RISK_COLUMNS])


@register("interval_forecast_panel", _forecast_check_sql(N_LONG, f"""{_METHOD_SQL}, week_of_year,
  strftime(week_start, '%B') AS month_name, true AS bounds_hold"""))
def interval_forecast_panel(spark, sf_dir):
    """Interval variant (H5 over the ensemble, D6 rows, 36 weeks; checks) for every segment."""
    f = pn.interval_forecast_panel_query(spark, sf_dir)
    holds = (F.col("predicted_lower") >= 0) & (F.col("predicted_lower") <= F.col("predicted_mean") + 0.005) & (
        F.col("predicted_mean") <= F.col("predicted_upper") + 0.005) & (F.col("most_likely_crashes") >= 0)
    return f.select("segment_id", "step", "week_start", "method", "week_of_year", "month_name", holds.alias("bounds_hold"))


def _mean_checks(f: DataFrame) -> DataFrame:
    p = F.col("predicted_crashes")
    return f.select("segment_id", "step", "week_start", "method", "week_of_year", "month_name",
                    ((p >= 0) & ~F.isnan(p) & (p < 1e9)).alias("bounds_hold"))


@register("mean_forecast_panel", ORACLE["interval_forecast_panel"])
def mean_forecast_panel(spark, sf_dir):
    """Mean variant (H6 over the tuned ensemble, D7 rows, 36 weeks, noise off; checks) for every segment."""
    return _mean_checks(pn.mean_forecast_panel_query(spark, sf_dir))


@register("factor_forecast_panel", _forecast_check_sql(N_LONG, """'ML+SeasonalFactor' AS method, week_of_year,
  strftime(week_start, '%B') AS month_name, true AS bounds_hold"""))
def factor_forecast_panel(spark, sf_dir):
    """Seasonal-factor variant (H8 over the tuned ensemble, 36 weeks; checks) for every segment."""
    return _mean_checks(pn.factor_forecast_panel_query(spark, sf_dir))
