"""Check queries for the forecast operators (H1–H12, W9) on deterministic stand-in predictions.

The three "models" are the ISO-week seasonal mean, the last observed value
and the mean of the last 4 values.  ``recursive_forecast_naive`` runs the real
recursive engine with those stand-ins (the oracle is a recursive CTE); the
blend queries score a 36-week calendar so every horizon band is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segcast.functions.numeric import round_half_even

from segcast.functions import labels as lb
from segcast.functions import noise as ns
from segcast.operators import evaluate as ev
from segcast.operators import features as fe
from segcast.operators import forecast as fc
from segcast.operators import seasonal as se
from segcast.plans.common import register, tidy
from segcast.plans.oracle import r, rcols, with_
from segcast.plans.q_eval import PRED_COLS, SCORED, standin_scored
from segcast.plans.q_features import hourly_panel, stored_panel
from segcast.plans.q_poisson import mode_sql, ppf_sql, probs_sql, risk4_sql

N_RISK = 12
N_LONG = 36


def standin_residuals(spark: SparkSession, sf_dir: str, segment: str = "nation", panel: DataFrame | None = None) -> DataFrame:
    sc = standin_scored(spark, sf_dir, segment, panel).where("is_train")
    return ev.residual_stats(sc, "total_crashes", PRED_COLS).select("segment_id", "residual_std")


def standin_future(spark: SparkSession, sf_dir: str, n_weeks: int, panel: DataFrame | None = None) -> DataFrame:
    """(segment, step) rows: calendar, seasonal lookups, stand-in predictions, spread, residual std."""
    panel = stored_panel(spark, sf_dir) if panel is None else panel
    stats = se.overall_stats(panel)
    prof = se.seasonal_profile(panel)
    cal = se.lookup_with_default(fc.future_calendar(stats, n_weeks), prof, stats)
    hist = fc.history_state(panel)
    df = cal.join(hist, "segment_id").join(standin_residuals(spark, sf_dir, panel=panel), "segment_id")
    df = df.withColumns({"pred_a": F.col("season_mean"), "pred_b": F.element_at("hist", -1),
                         "pred_c": fc.tail_mean(F.col("hist"), 4)})
    ml, sd = ev.model_spread(PRED_COLS)
    return df.withColumns({"ml": ml, "model_std": sd})


def _risk_blend(df: DataFrame, n_weeks: int) -> DataFrame:
    b = fc.blend_risk(F.col("step"), n_weeks, F.col("ml"), F.col("model_std"), F.col("season_mean"),
                      F.col("overall_std"), F.col("residual_std"))
    return df.withColumns(b).withColumn("horizon_factor", fc.horizon_factor(F.col("step").cast("double"), n_weeks))


RISK_OUT = ["predicted_lower", "predicted_upper", "ci_method", "model_uncertainty", "residual_uncertainty",
            "total_uncertainty", "most_likely_crashes", "probability_pct", "risk_level", "prob_0_crash",
            "prob_1_crash", "prob_2_crash", "prob_3_crash", "prob_ge4_crash"]


def standin_risk_forecast(spark: SparkSession, sf_dir: str, n_weeks: int = N_RISK, panel: DataFrame | None = None) -> DataFrame:
    """D5 risk rows per (segment, step) from the stand-in predictions (feeds the dashboard queries)."""
    b = _risk_blend(standin_future(spark, sf_dir, n_weeks, panel), n_weeks)
    out = b.withColumns(fc.risk_columns(F.col("lambda"), F.col("total_std"), F.col("model_std"), F.col("residual_std")))
    return out.select("segment_id", "step", "week_start", "week_of_year", (round_half_even("lambda", 3) + 0.0).alias("lambda"),
                      *RISK_OUT, "method")


def fut_sql(n: int) -> str:
    return SCORED + f""",
ostats AS (SELECT segment_id, avg(total_crashes::double) AS overall_mean, stddev_samp(total_crashes::double) AS overall_std,
                  count(*)::bigint AS n_weeks, min(week_start) AS first_week, max(week_start) AS last_week FROM panel GROUP BY 1),
prof AS (SELECT segment_id, week_of_year, avg(total_crashes::double) AS seasonal_mean,
                stddev_samp(total_crashes::double) AS seasonal_std FROM panel GROUP BY 1, 2),
fcal0 AS (SELECT o.*, s.step::int AS step, (o.last_week + ((s.step + 1) * 7)::int) AS week_start
          FROM ostats o CROSS JOIN range(0, {n}) s(step)),
fcal AS (SELECT *, year(week_start)::int AS year, month(week_start)::int AS month, quarter(week_start)::int AS quarter,
                weekofyear(week_start)::int AS week_of_year FROM fcal0),
rk AS (SELECT segment_id, total_crashes::double AS y,
              row_number() OVER (PARTITION BY segment_id ORDER BY week_start DESC) AS k FROM panel),
recent AS (SELECT segment_id, max(y) FILTER (WHERE k = 1) AS last_value, avg(y) FILTER (WHERE k <= 4) AS mean4
           FROM rk GROUP BY 1),
fut0 AS (SELECT f.*, coalesce(p.seasonal_mean, f.overall_mean) AS season_mean,
                coalesce(p.seasonal_std, f.overall_std) AS season_std, q.residual_std, n.last_value, n.mean4
         FROM fcal f LEFT JOIN prof p USING (segment_id, week_of_year) JOIN recent n USING (segment_id)
              JOIN resid q USING (segment_id)),
fut1 AS (SELECT *, (season_mean + last_value + mean4) / 3 AS ml FROM fut0),
fut AS (SELECT *, sqrt(((season_mean - ml)^2 + (last_value - ml)^2 + (mean4 - ml)^2) / 3) AS model_std FROM fut1)"""


def risk_sql(n: int) -> str:
    return fut_sql(n) + f""",
br0 AS (SELECT *, least((step - 4) / 8, 1) * 0.3 AS w1, 0.3 + (step - 12) / 12 * 0.4 AS w2,
               1 + step / {n} * 0.5 AS horizon_factor FROM fut),
br1 AS (SELECT *,
  greatest(CASE WHEN step < 4 THEN ml WHEN step < 12 THEN ml * (1 - w1) + season_mean * w1
                WHEN step < 24 THEN ml * (1 - w2) + season_mean * w2 ELSE season_mean END, 0.01) AS lam_v,
  CASE WHEN step < 4 THEN model_std WHEN step < 12 THEN model_std * (1 - w1) + overall_std * 0.3 * w1
       WHEN step < 24 THEN model_std * (1 - w2) + overall_std * 0.5 * w2 ELSE overall_std END AS base_std,
  CASE WHEN step < 4 THEN 'ML' WHEN step < 12 THEN 'ML+Season' WHEN step < 24 THEN 'Hybrid' ELSE 'Seasonal' END AS method
  FROM br0),
br2 AS (SELECT *, sqrt(residual_std^2 + base_std^2) * horizon_factor AS total_std FROM br1),
{ppf_sql('br2', 'segment_id, step').strip()},
riskf AS (
  SELECT segment_id, step, week_start, week_of_year, (round_even(lam_v, 3) + 0.0) AS lam3,
    trunc(CASE WHEN lam_v < 5 THEN lower_p ELSE greatest(greatest(lam_v - 1.96 * total_std, 0), lower_p) END)::int AS predicted_lower,
    trunc(CASE WHEN lam_v < 5 THEN upper_p ELSE greatest(greatest(lam_v + 1.96 * total_std, lam_v), upper_p) END)::int AS predicted_upper,
    CASE WHEN lam_v < 5 THEN 'Poisson' ELSE 'Hybrid-Uncertainty' END AS ci_method,
    (round_even(model_std, 3) + 0.0) AS model_uncertainty, (round_even(residual_std, 3) + 0.0) AS residual_uncertainty,
    (round_even(total_std, 3) + 0.0) AS total_uncertainty,
    {mode_sql('lam_v')} AS most_likely_crashes,
    (round_even(exp(-lam_v + {mode_sql('lam_v')} * ln(lam_v) - lgamma({mode_sql('lam_v')} + 1)) * 100, 1) + 0.0) AS probability_pct,
    {risk4_sql('lam_v')} AS risk_level, method,
    {probs_sql('lam_v')}
  FROM br2 JOIN pq USING (segment_id, step))"""


@register("future_calendar", with_(fut_sql(N_RISK)) + f"""
SELECT segment_id, step, week_start, year, month, quarter, week_of_year,
  {r('sin(2 * pi() * week_of_year / 52)', 'week_sin')}, {r('cos(2 * pi() * week_of_year / 52)', 'week_cos')},
  {r('sin(2 * pi() * month / 12)', 'month_sin')}, {r('cos(2 * pi() * month / 12)', 'month_cos')},
  strftime(week_start, '%B') AS month_name
FROM fcal""")
def future_calendar(spark, sf_dir):
    """H1, R17."""
    stats = se.overall_stats(hourly_panel(spark, sf_dir))
    cal = fc.future_calendar(stats, N_RISK).withColumn("month_name", lb.month_name(F.col("week_start")))
    return tidy(cal.select("segment_id", "step", "week_start", "year", "month", "quarter", "week_of_year", *fe.CYCLIC,
                           "month_name"))


@register("carry_forward", with_() + f"""
SELECT segment_id, {', '.join(c for c in fe.CARRIED if c.startswith('total_'))},
  {rcols([c for c in fe.CARRIED if not c.startswith('total_')])}
FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY week_start DESC) AS rk FROM panel) WHERE rk = 1""")
def carry_forward(spark, sf_dir):
    """H2: exogenous measures of each segment's last week."""
    out = fc.carry_forward(hourly_panel(spark, sf_dir))
    ints = [c for c in fe.CARRIED if c.startswith("total_")]
    return tidy(out.select("segment_id", *ints, *[c for c in fe.CARRIED if c not in ints]))


_TAIL = fe.lag_names() + fe.rolling_names()


@register("tail_stats", with_(fut_sql(1), """
h AS (SELECT segment_id, list(y ORDER BY k DESC) AS hist FROM rk WHERE k <= 12 GROUP BY 1)""") + """
SELECT segment_id, """ + ",\n  ".join(
    [f"hist[len(hist) - {k - 1}] AS crashes_lag_{k}w" for k in fe.LAGS]
    + [r(f"list_avg(hist[len(hist) - {w - 1}:])", f"crashes_rolling_mean_{w}w") + ",\n  "
       + r(f"list_stddev_samp(hist[len(hist) - {w - 1}:])", f"crashes_rolling_std_{w}w") + ",\n  "
       + r(f"list_max(hist[len(hist) - {w - 1}:])", f"crashes_rolling_max_{w}w") for w in fe.ROLL_WINDOWS]) + """
FROM h""")
def tail_stats(spark, sf_dir):
    """Next-week lag/rolling features from the last 12 values of each segment's history."""
    h = fc.history_state(hourly_panel(spark, sf_dir)).withColumn("n", F.size("hist"))
    feats = fc.next_row_features(F.col("hist"), F.col("n"))
    return tidy(h.select("segment_id", *[feats[c].alias(c) for c in _TAIL]))


SHORT_WEEKS = 5


@register("short_history_features", with_(SCORED, f"""
sh AS (SELECT segment_id, list(total_crashes::double ORDER BY row_idx) AS h, avg(total_crashes::double) AS m
       FROM split2 WHERE row_idx <= {SHORT_WEEKS} GROUP BY 1)""") + "SELECT segment_id, " + ", ".join(
    [r(f"CASE WHEN len(h) >= {k} THEN h[len(h) - {k - 1}] ELSE m END", f"crashes_lag_{k}w") for k in fe.LAGS]
    + [r(f"CASE WHEN len(h) >= {w} THEN list_avg(h[len(h) - {w - 1}:]) ELSE 0 END", f"crashes_rolling_mean_{w}w") for w in fe.ROLL_WINDOWS]
    + [r("CASE WHEN len(h) >= 2 THEN h[len(h)] - h[len(h) - 1] ELSE 0 END", "crash_change_1w"),
       r("CASE WHEN len(h) >= 4 THEN h[len(h)] - h[len(h) - 3] ELSE 0 END", "crash_change_4w")]) + " FROM sh")
def short_history_features(spark, sf_dir):
    """Policies "value" (missing lags become the mean) and "recent" (changes) on histories shorter than the lags."""
    panel = fe.time_split(hourly_panel(spark, sf_dir)).where(F.col("row_idx") <= SHORT_WEEKS)
    state = fc.history_state(panel).join(se.overall_stats(panel).select("segment_id", "overall_mean"), "segment_id")
    feats = fc.next_row_features(F.col("hist"), F.size("hist"), "value", F.col("overall_mean"), True, "recent")
    names = [*fe.lag_names(), *[f"crashes_rolling_mean_{w}w" for w in fe.ROLL_WINDOWS], "crash_change_1w", "crash_change_4w"]
    return tidy(state.select("segment_id", *[feats[n].alias(n) for n in names]))


@register("blend_risk", with_(risk_sql(N_LONG)) + f"""
SELECT segment_id, step, week_start, method, {r('lam_v', '"lambda"')}, {r('horizon_factor', 'horizon_factor')},
  {r('base_std', 'base_std')}
FROM br2""")
def blend_risk(spark, sf_dir):
    """Risk blend of ML and seasonal λ over a 36-week horizon."""
    b = _risk_blend(standin_future(spark, sf_dir, N_LONG), N_LONG)
    return tidy(b.select("segment_id", "step", "week_start", "method", "lambda", "horizon_factor", "base_std"))


@register("dual_uncertainty", with_(risk_sql(N_LONG)) + """
SELECT segment_id, step, week_start, week_of_year, lam3 AS "lambda", predicted_lower, predicted_upper, ci_method,
  model_uncertainty, residual_uncertainty, total_uncertainty, most_likely_crashes, probability_pct, risk_level, method,
  prob_0_crash, prob_1_crash, prob_2_crash, prob_3_crash, prob_ge4_crash
FROM riskf""")
def dual_uncertainty(spark, sf_dir):
    """H10 (+ P6, P7, P1–P4 on forecast rows): full risk forecast rows, 36 weeks."""
    return standin_risk_forecast(spark, sf_dir, N_LONG)


def interval_sql(n: int) -> str:
    return fut_sql(n) + f""",
bi0 AS (SELECT *, sqrt(residual_std^2 + model_std^2) AS tstd FROM fut),
bi1 AS (SELECT *, greatest(ml, 0) AS ml_mean, greatest(ml - 1.96 * tstd, 0) AS ml_lower,
               greatest(ml + 1.96 * tstd, 0) AS ml_upper, 1 + step / {n} * 0.5 AS hf,
               (step - 4) / 8 * 0.2 AS w1, 0.2 + (step - 12) / 12 * 0.3 AS w2,
               0.5 + least((step - 24) / 12 * 0.3, 0.3) AS w3 FROM bi0),
bi2 AS (SELECT *, CASE WHEN step < 4 THEN 0 WHEN step < 12 THEN w1 WHEN step < 24 THEN w2 ELSE w3 END AS w FROM bi1),
bi3 AS (SELECT *, ml_mean * (1 - w) + season_mean * w AS mean0 FROM bi2),
bi4 AS (SELECT *,
  CASE WHEN step < 4 THEN ml_lower WHEN step < 12 THEN ml_lower * (1 - w1) + (season_mean - season_std * 1.96) * w1
       WHEN step < 24 THEN mean0 - (ml_upper - ml_lower) * hf / 2 ELSE mean0 - season_std * 2.5 * hf END AS lower0,
  CASE WHEN step < 4 THEN ml_upper WHEN step < 12 THEN ml_upper * (1 - w1) + (season_mean + season_std * 1.96) * w1
       WHEN step < 24 THEN mean0 + (ml_upper - ml_lower) * hf / 2 ELSE mean0 + season_std * 2.5 * hf END AS upper0,
  CASE WHEN step < 4 THEN 'ML' WHEN step < 12 THEN 'ML+Season' WHEN step < 24 THEN 'Hybrid' ELSE 'Seasonal' END AS method
  FROM bi3),
bi5 AS (SELECT *, greatest(mean0, 0) AS fm, greatest(lower0, 0) AS fl FROM bi4),
bi AS (SELECT *, greatest(upper0, fm) AS fu, {mode_sql('fm', 'trunc(greatest(upper0, fm))::int + 2')} AS mode_k FROM bi5)"""


@register("blend_interval", with_(interval_sql(N_LONG)) + """
SELECT segment_id, step, week_start, week_of_year, method,
  (round_even(fm, 2) + 0.0) AS predicted_mean, (round_even(fl, 2) + 0.0) AS predicted_lower,
  (round_even(fu, 2) + 0.0) AS predicted_upper,
  trunc(fl)::int::varchar || '-' || ceil(fu)::int::varchar AS crash_range,
  mode_k AS most_likely_crashes,
  CASE WHEN fm <= 0 THEN 100.0 ELSE (round_even(exp(-fm + mode_k * ln(fm) - lgamma(mode_k + 1)) * 100, 1) + 0.0) END AS likelihood_percent,
  strftime(week_start, '%B') AS month_name
FROM bi""")
def blend_interval(spark, sf_dir):
    """H5 (+ P5, P8, R17): interval forecast rows over 36 weeks."""
    f = standin_future(spark, sf_dir, N_LONG)
    f = ev.predict_interval(f, PRED_COLS)
    b = f.withColumns(fc.blend_interval(F.col("step"), N_LONG, F.col("pred_mean"), F.col("pred_lower"),
                                        F.col("pred_upper"), F.col("season_mean"), F.col("season_std")))
    out = b.withColumns(fc.interval_columns(F.col("final_mean"), F.col("final_lower"), F.col("final_upper"),
                                            F.col("week_start")))
    return out.select("segment_id", "step", "week_start", "week_of_year", "method", "predicted_mean", "predicted_lower",
                      "predicted_upper", "crash_range", "most_likely_crashes", "likelihood_percent", "month_name")


def mean_sql(n: int) -> str:
    return fut_sql(n) + """,
bm AS (SELECT *, greatest(ml, 0) AS mlc,
  CASE WHEN step < 4 THEN 0 WHEN step < 12 THEN (step - 4) / 8 * 0.2 WHEN step < 24 THEN 0.2 + (step - 12) / 12 * 0.3
       ELSE 0.5 + least((step - 24) / 12 * 0.3, 0.3) END AS w,
  CASE WHEN step < 4 THEN 'ML' WHEN step < 12 THEN 'ML+Season' WHEN step < 24 THEN 'Hybrid' ELSE 'Seasonal' END AS method
  FROM fut)"""


@register("blend_mean", with_(mean_sql(N_LONG)) + """
SELECT segment_id, step, week_start, week_of_year, method,
  (round_even(greatest(mlc * (1 - w) + season_mean * w, 0), 1) + 0.0) AS predicted_crashes,
  strftime(week_start, '%B') AS month_name
FROM bm""")
def blend_mean(spark, sf_dir):
    """H6, H7 (noise switched off): mean forecast rows over 36 weeks."""
    f = standin_future(spark, sf_dir, N_LONG)
    b = f.withColumns(fc.blend_mean(F.col("step"), F.col("ml"), F.col("season_mean"), F.col("season_std")))
    return b.select("segment_id", "step", "week_start", "week_of_year", "method",
                    (round_half_even("final_pred", 1) + 0.0).alias("predicted_crashes"),
                    lb.month_name(F.col("week_start")).alias("month_name"))


@register("blend_mean_noise", with_(mean_sql(N_LONG)) + f"""
SELECT segment_id, step, week_start, {r(ns.normal_sql(42, 'segment_id', 'step'), 'z')},
  {r("""greatest(mlc * (1 - w) + season_mean * w
     + CASE WHEN step < 12 THEN 0 WHEN step < 24 THEN 0.15 ELSE 0.2 END * coalesce(season_std, 0) * """ + ns.normal_sql(42, 'segment_id', 'step') + ", 0)", 'final_pred')}
FROM bm""")
def blend_mean_noise(spark, sf_dir):
    """H6 with its noise on: every (segment, week) has a normal number of its own, whatever the partitions."""
    f = standin_future(spark, sf_dir, N_LONG).withColumn("season_std", F.coalesce("season_std", F.lit(0.0)))
    b = f.withColumns(fc.blend_mean(F.col("step"), F.col("ml"), F.col("season_mean"), F.col("season_std"), noise_scale=1.0,
                                    seed=42, segment=F.col("segment_id")))
    return tidy(b.select("segment_id", "step", "week_start", ns.normal(42, F.col("segment_id"), F.col("step")).alias("z"), "final_pred"))


@register("seasonal_factor_forecast", with_(fut_sql(N_LONG)) + """
SELECT segment_id, step, week_start, (round_even(CASE WHEN step < 12 THEN greatest(ml, 0) ELSE greatest(
    greatest(ml, 0) * (1 - least((step - 12) / 24, 0.3))
    + greatest(ml, 0) * coalesce(season_mean / CASE WHEN overall_mean <> 0 THEN overall_mean END, 1.0) * least((step - 12) / 24, 0.3), 0) END, 1) + 0.0)
  AS predicted_crashes
FROM fut""")
def seasonal_factor_forecast(spark, sf_dir):
    """H8: seasonal-factor adjustment of the ensemble mean from week 13 on."""
    f = standin_future(spark, sf_dir, N_LONG)
    p = fc.seasonal_factor(F.col("step"), F.col("ml"), F.col("season_mean"), F.col("overall_mean"))
    return f.select("segment_id", "step", "week_start", (round_half_even(p, 1) + 0.0).alias("predicted_crashes"))


@register("forecast_summary", with_(risk_sql(N_RISK)) + f"""
SELECT segment_id, count(*)::bigint AS n_weeks, {r('sum(lam3)', 'lambda_sum')}, {r('avg(lam3)', 'lambda_mean')},
  {r('min(lam3)', 'lambda_min')}, {r('max(lam3)', 'lambda_max')}, {r('stddev_samp(lam3)', 'lambda_std')},
  {r('avg(predicted_upper - predicted_lower)', 'avg_ci_width')}, {r('avg(model_uncertainty)', 'avg_model_uncertainty')},
  {r('avg(total_uncertainty)', 'avg_total_uncertainty')},
  {r('arg_min(lam3, step)', 'first_lambda')}, {r('arg_max(lam3, step)', 'last_lambda')}
FROM riskf GROUP BY segment_id""")
def forecast_summary(spark, sf_dir):
    """Per-segment summary of a 12-week risk forecast."""
    f = standin_risk_forecast(spark, sf_dir, N_RISK)
    return tidy(fc.forecast_summary(f))


# --- recursive engine with the stand-in predictor ----------------------------------------
def _naive_predictor(df: DataFrame) -> DataFrame:
    return df.withColumns({"pred_a": F.col("season_mean"), "pred_b": F.col("crashes_lag_1w"),
                           "pred_c": F.col("crashes_rolling_mean_4w")})


def _naive_risk_blend(n_weeks: int):
    def blend(df: DataFrame) -> DataFrame:
        ml, sd = ev.model_spread(PRED_COLS)
        b = fc.blend_risk(F.col("step"), n_weeks, ml, sd, F.col("season_mean"), F.col("overall_std"),
                          F.col("residual_std"))
        return df.withColumns({"ml": ml, "model_std": sd, **b, "next_value": b["lambda"]})
    return blend


def recursive_sql(n: int, segment: str = "nation") -> str:
    return with_(fut_sql(n), f"""
h AS (SELECT segment_id, list(y ORDER BY k DESC) AS hist FROM rk WHERE k <= 12 GROUP BY 1),
rec(segment_id, step, hist, n_hist, lam_out, method_out) AS (
  SELECT h.segment_id, 0, h.hist, o.n_weeks, NULL::double, NULL::varchar FROM h JOIN ostats o USING (segment_id)
  UNION ALL
  SELECT segment_id, step + 1,
         CASE WHEN len(hist) >= 12 THEN list_append(hist, lam)[2:] ELSE list_append(hist, lam) END,
         n_hist + 1, lam, method
  FROM (
    SELECT segment_id, step, hist, n_hist, method,
      greatest(CASE WHEN step < 4 THEN ml WHEN step < 12 THEN ml * (1 - w1) + season_mean * w1
                    WHEN step < 24 THEN ml * (1 - w2) + season_mean * w2 ELSE season_mean END, 0.01) AS lam
    FROM (
      SELECT r.segment_id, r.step, r.hist, r.n_hist, f.season_mean,
             (f.season_mean + hist[len(hist)] + CASE WHEN r.n_hist >= 4 THEN list_avg(hist[len(hist) - 3:]) ELSE 0 END) / 3 AS ml,
             least((r.step - 4) / 8, 1) * 0.3 AS w1, 0.3 + (r.step - 12) / 12 * 0.4 AS w2,
             CASE WHEN r.step < 4 THEN 'ML' WHEN r.step < 12 THEN 'ML+Season' WHEN r.step < 24 THEN 'Hybrid' ELSE 'Seasonal' END AS method
      FROM rec r JOIN fut f ON f.segment_id = r.segment_id AND f.step = r.step
      WHERE r.step < {n})))""", segment=segment).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT r.segment_id, r.step - 1 AS step, f.week_start, r.method_out AS method, {r('r.lam_out', '"lambda"')}
FROM rec r JOIN fut f ON f.segment_id = r.segment_id AND f.step = r.step - 1 WHERE r.step > 0"""


def _naive_advance(n_weeks: int):
    """The stand-in models and the risk blend as column expressions of one step."""
    def advance(row):
        preds = [row["season_mean"], row["crashes_lag_1w"], row["crashes_rolling_mean_4w"]]
        ml = sum(preds) / len(preds)
        sd = F.sqrt(sum((p - ml) * (p - ml) for p in preds) / len(preds))
        b = fc.blend_risk(row["step"], n_weeks, ml, sd, row["season_mean"], F.col("overall_std"), F.col("residual_std"))
        return {**b, "next_value": b["lambda"]}
    return advance


def _recursive_naive(spark, sf_dir, segment: str = "nation"):
    panel = stored_panel(spark, sf_dir, segment)
    state = fc.initial_state(panel, N_RISK).join(standin_residuals(spark, sf_dir, segment, panel), "segment_id")
    out = fc.fold_recursive(state, N_RISK, _naive_advance(N_RISK), "step int, week_start date, method string, lambda double")
    return tidy(out.select("segment_id", "step", "week_start", "method", "lambda"))


@register("recursive_forecast_naive", recursive_sql(N_RISK))
def recursive_forecast_naive(spark, sf_dir):
    """The recursive engine (ring-buffer state, all segments per step) with stand-in models."""
    return _recursive_naive(spark, sf_dir)


@register("supplier_recursive_forecast", recursive_sql(N_RISK, "supplier"))
def supplier_recursive_forecast(spark, sf_dir):
    """H3 at many segments: the same engine keyed by supplier (10/100/1,000 segments at sf 0.001/0.01/0.1)."""
    return _recursive_naive(spark, sf_dir, "supplier")
