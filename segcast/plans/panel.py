"""Flagship: weekly risk forecast for every segment at once (G1–G4 over F, A, W, B, M, E, H, P).

The reference loops over segments and runs a pandas/scikit-learn script per
segment; here the segment is only a grouping key.  One lazy lineage builds
the weekly feature panel for all segments, MLlib fits the ensemble on all
training weeks, and the recursive forecast advances every segment together in one
job.  Segment failures are isolated at every stage: validation, fit and forecast each
return (segment, error) instead of ending the run; such a segment is FAILED with the
first reason, has no forecast, and changes nothing for the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segcast.functions.numeric import is_finite, round_half_even
from segcast.operators import evaluate as ev
from segcast.operators import features as fe
from segcast.operators import forecast as fc
from segcast.operators import horizon as hz
from segcast.operators import models as md
from segcast.operators import seasonal as se
from segcast.plans.stages import Stages
from segcast.session import store as stored
from segcast.sources import fixtures as fx
from segcast.sources import io

RISK_COLUMNS = ["week_start", "lambda", "predicted_lower", "predicted_upper", "ci_method", "model_uncertainty",
                "residual_uncertainty", "total_uncertainty", "most_likely_crashes", "probability_pct", "risk_level",
                "method", "prob_0_crash", "prob_1_crash", "prob_2_crash", "prob_3_crash", "prob_ge4_crash"]


@dataclass
class PanelResult:
    panel: DataFrame
    status: DataFrame
    metrics: DataFrame
    interval_quality: DataFrame
    forecast: DataFrame
    summary: DataFrame
    top_improvement: DataFrame
    status_counts: DataFrame
    ensemble: md.Ensemble
    scored: DataFrame


def validate_segments(split: DataFrame, min_train: int = 2, segment: str = "segment_id") -> DataFrame:
    """G1: one status row per segment – SUCCESS, or FAILED with the reason."""
    measured = [c for c in fe.PANEL_COLUMNS if c in split.columns and c not in ("week_start", "total_crashes")]
    finite = reduce(lambda a, c: a & is_finite(F.col(c)), measured, F.lit(True))
    agg = split.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.sum(F.col("is_train").cast("int")).alias("n_train"),
        F.sum(F.col("total_crashes").isNull().cast("int")).alias("n_null_target"),
        F.count_if(~finite).alias("n_not_finite"),
    ).withColumn("n_test", F.col("n_weeks") - F.col("n_train"))
    err = (F.when(F.col("n_null_target") > 0, "target has missing values")
            .when(F.col("n_not_finite") > 0, F.format_string("%d weeks hold values that are not finite", F.col("n_not_finite")))
            .when(F.col("n_train") < min_train, F.format_string("only %d training weeks", F.col("n_train")))
            .when(F.col("n_test") < 1, "no test weeks"))
    return agg.withColumns({"status": F.when(err.isNull(), "SUCCESS").otherwise("FAILED"), "error": err})


def segment_summary(metrics: DataFrame, forecast: DataFrame, status: DataFrame, value: str = "lambda",
                    segment: str = "segment_id") -> DataFrame:
    """Baseline vs ensemble MAE/RMSE/R², real history length and forecast total per segment."""
    p = metrics.groupBy(segment).agg(*[
        F.max(F.when(F.col("model") == m, F.col(k))).alias(f"{k}_{m}")
        for m in ("baseline", "ensemble") for k in ("mae", "rmse", "r2")])
    tot = forecast.groupBy(segment).agg(F.sum(value).alias("forecast_total"), F.count(F.lit(1)).alias("horizon"))
    hist = status.select(segment, F.col("n_weeks").alias("total_historical_weeks"))
    return p.join(hist, segment).join(tot, segment)


def top_improvement(summary: DataFrame, n: int = 5, segment: str = "segment_id") -> DataFrame:
    """The n segments with the largest MAE reduction (ties by segment), values rounded to 2."""
    s = summary.withColumn("mae_improvement", F.col("mae_baseline") - F.col("mae_ensemble"))
    top = s.orderBy(F.col("mae_improvement").desc(), segment).limit(n)
    return top.select(segment, *[round_half_even(c, 2).alias(c) for c in
                                 ("mae_baseline", "mae_ensemble", "mae_improvement", "forecast_total")])


def training_frame(panel: DataFrame, frac: float = 0.75, segment: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """G1 + W8 + B3: segment status, and the valid segments' rows with split flag, training mean and seasonal baseline."""
    split = fe.time_split(panel, frac)
    status = validate_segments(split)
    ok = status.where(F.col("status") == "SUCCESS").select(segment)
    return status, se.seasonal_baseline(md.with_segment_mean(split.join(ok, segment, "left_semi")))


# The horizon in weeks and the estimator configuration of each forecast variant of the reference.
HORIZON = {"risk": 12, "interval": 36, "mean": 36, "factor": 36}
PRESET = {"risk": "default", "interval": "default", "mean": "tuned", "factor": "tuned"}


def run_panel(hourly: DataFrame, n_weeks: int | None = None, frac: float = 0.75, leaky: bool = True,
              model_params: dict | None = None, variant: str = "risk", noise_scale: float = 0.0, seed: int = 42,
              segment: str = "segment_id", ensemble: md.Ensemble | None = None, output: str | None = None,
              run_dir: str | None = None) -> PanelResult:
    """The whole per-segment process of the reference, for all segments in one plan.

    ``variant`` picks the forecast family: ``"risk"`` (D5: blend A, dual
    uncertainty, Poisson columns), ``"interval"`` (D6: blend B with interval
    rules), ``"mean"`` (D7: blend C, missing lags → overall mean, recent
    changes) or ``"factor"`` (D7 without method: seasonal-factor adjustment).
    Each has its own horizon and estimators (HORIZON, PRESET); the reference's
    short interval run is ``variant="interval", n_weeks=4``.  A fitted
    ``ensemble`` is used as it is.  ``output`` names a folder to which panel,
    forecast, metrics and summary are written.

    The panel and the other shared results are stored under the checkpoint
    folder, so the facts are scanned once and nothing stays cached.  With
    ``run_dir`` they are stored there under stable names: a run that ended
    early goes on after its last finished stage (see ``stages``).
    """
    n_weeks = HORIZON[variant] if n_weeks is None else n_weeks
    store, stages = stored, None
    if run_dir is not None:
        stages = Stages(hourly.sparkSession, run_dir, {
            "n_weeks": n_weeks, "frac": frac, "leaky": leaky, "model_params": model_params, "variant": variant,
            "noise_scale": noise_scale, "seed": seed, "segment": segment, "own_ensemble": ensemble is not None})
        store = stages.keep
    panel = store(fe.weekly_panel(hourly, leaky=leaky), "panel")
    status, scored0 = training_frame(panel, frac, segment)
    status, scored0 = store(status, "validation"), store(scored0, "training-frame")
    valid = status.where(F.col("status") == "SUCCESS").select(segment)

    def fit() -> md.Ensemble:
        return md.fit_ensemble(scored0.where("is_train"), md.feature_columns(scored0),
                               **{**md.PRESETS[PRESET[variant]], **(model_params or {})})

    ens = ensemble or (stages.keep_ensemble(fit) if stages else fit())
    scored = store(ens.score(scored0), "scored")
    res = store(ev.residual_stats(scored.where("is_train"), "total_crashes", md.MODEL_COLS), "residuals")

    means = scored0.groupBy(segment).agg(F.max(md.SEGMENT_MEAN).alias(md.SEGMENT_MEAN))
    state = (fc.initial_state(panel.join(valid, segment, "left_semi"), n_weeks)
               .join(res.select(segment, "residual_std"), segment).join(means, segment))
    horizon = store(hz.forecast_horizon(ens.with_ridge(state), ens, n_weeks, variant, noise_scale, seed, segment), "horizon")
    errors = horizon.where("error is not null").select(segment, "error")
    status = store(with_errors(status, errors if ens.errors is None else ens.errors.unionByName(errors), segment), "status")
    ok = status.where(F.col("status") == "SUCCESS").select(segment)

    test = ev.predict_interval(scored.where(~F.col("is_train")).join(ok, segment, "left_semi")
                               .join(res.select(segment, "residual_std"), segment), md.MODEL_COLS)
    metrics = store(ev.model_metrics_long(test, "total_crashes", {  # M8: each model beside the baseline and the mean
        "baseline": "baseline_pred", "ensemble": "pred_mean", "rf": "pred_rf", "gb": "pred_gb", "ridge": "pred_ridge"}), "metrics")
    quality = ev.interval_quality(test)
    forecast = store(forecast_columns(hz.horizon_rows(horizon, variant, segment), variant, segment), "forecast")
    value = {"risk": "lambda", "interval": "predicted_mean"}.get(variant, "predicted_crashes")
    summary = segment_summary(metrics, forecast, status, value=value)
    if output is not None:
        for name, df in (("panel", panel), ("forecast", forecast), ("metrics", metrics)):
            io.write_partitioned(df, f"{output.rstrip('/')}/{name}")
        io.write_summary(summary, f"{output.rstrip('/')}/summary")
    return PanelResult(panel, status, metrics, quality, forecast, summary, top_improvement(summary),
                       status.groupBy("status").agg(F.count(F.lit(1)).alias("n_segments")), ens, scored)


def with_errors(status: DataFrame, errors: DataFrame, segment: str = "segment_id") -> DataFrame:
    """``status`` after a stage: segments of ``errors`` (segment, error) become FAILED; the first reason stays."""
    found = errors.groupBy(segment).agg(F.min("error").alias("_error"))
    joined = status.join(found, segment, "left").withColumn("error", F.coalesce("error", "_error"))
    return joined.withColumn("status", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED")).select(*status.columns)


INTERVAL_COLUMNS = ["week_start", "week_of_year", "predicted_mean", "predicted_lower", "predicted_upper", "crash_range",
                    "most_likely_crashes", "likelihood_percent", "month_name", "method"]
MEAN_COLUMNS = ["week_start", "week_of_year", "predicted_crashes", "month_name", "method"]


def forecast_columns(raw: DataFrame, variant: str = "risk", segment: str = "segment_id") -> DataFrame:
    """The published columns of a variant (D5–D7) from its raw outputs, one row per (segment, step)."""
    if variant == "risk":
        risk = raw.withColumns(fc.risk_columns(F.col("lambda"), F.col("total_std"), F.col("model_std"),
                                               F.col("residual_std")))
        return risk.select(segment, "step", *[round_half_even("lambda", 3).alias("lambda") if c == "lambda"
                                              else F.col(c) for c in RISK_COLUMNS])
    if variant == "interval":
        out = raw.withColumns(fc.interval_columns(F.col("final_mean"), F.col("final_lower"), F.col("final_upper"),
                                                  F.col("week_start")))
        return out.select(segment, "step", *INTERVAL_COLUMNS)
    out = raw.withColumns({"predicted_crashes": round_half_even("final_pred", 1),
                           "month_name": F.date_format("week_start", "MMMM")})
    return out.select(segment, "step", *MEAN_COLUMNS)


def stepwise_forecast(state: DataFrame, ens: md.Ensemble, n_weeks: int, variant: str = "risk", noise_scale: float = 0.0,
                      seed: int = 42, segment: str = "segment_id") -> DataFrame:
    """H3 step by step with MLlib's own scoring: the raw outputs that ``horizon`` gives in one pass.

    A job chain and a stored state per week; for predictors that are no flat trees, and for tests.
    """
    step = F.col("step")

    def blend(df: DataFrame) -> DataFrame:
        ml, sd = ev.model_spread(md.MODEL_COLS)
        df = df.withColumns({"ml": ml, "model_std": sd})
        if variant == "risk":
            made = fc.blend_risk(step, n_weeks, F.col("ml"), F.col("model_std"), F.col("season_mean"), F.col("overall_std"),
                                 F.col("residual_std"))
        elif variant == "interval":
            df = ev.predict_interval(df, md.MODEL_COLS)
            made = fc.blend_interval(step, n_weeks, F.col("pred_mean"), F.col("pred_lower"), F.col("pred_upper"),
                                     F.col("season_mean"), F.col("season_std"))
        elif variant == "mean":
            made = fc.blend_mean(step, F.col("ml"), F.col("season_mean"), F.col("season_std"), noise_scale=noise_scale,
                                 seed=seed, segment=F.col(segment))
        else:
            made = {"final_pred": fc.seasonal_factor(step, F.col("ml"), F.col("season_mean"), F.col("overall_mean"))}
        made["method"] = hz.method_of(step, variant)
        return df.withColumns(made).withColumn("next_value", F.col(hz.OUTPUTS[variant][0]))

    return fc.run_recursive(state, n_weeks, ens.score, blend,
                            ["step", "week_start", "week_of_year", "residual_std", "method", *hz.OUTPUTS[variant]],
                            feature_kwargs=hz.POLICIES[variant])


def interval_forecast_panel_query(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Interval variant (D6) of the all-segment forecast."""
    return run_panel(fx.hourly(spark, sf_dir), variant="interval", **kw).forecast


def mean_forecast_panel_query(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Mean variant (D7) of the all-segment forecast, noise off."""
    return run_panel(fx.hourly(spark, sf_dir), variant="mean", **kw).forecast


def factor_forecast_panel_query(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Seasonal-factor variant (D7 without bands) of the all-segment forecast."""
    return run_panel(fx.hourly(spark, sf_dir), variant="factor", **kw).forecast


def risk_forecast_panel_query(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Flagship query: the 12-week risk forecast of every segment of the hourly fixture."""
    return run_panel(fx.hourly(spark, sf_dir), **kw).forecast
