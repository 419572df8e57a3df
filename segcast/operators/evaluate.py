"""Evaluation operators (E1–E8, M5, M6): all are grouped aggregations or projections.

Metrics are computed in one aggregation pass per (segment, model) from
mergeable states (n, Σ|e|, Σe², central moments of y), so they combine map-side and
never gather a group's rows; R² uses SST = n·var(y), which does not cancel for large y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segcast.functions.numeric import at_least

Z95 = 1.96


def regression_metrics(df: DataFrame, actual: str, pred: str, by: list[str]) -> DataFrame:
    """E1 + E2: n, MAE, RMSE, R² and MAPE (zero actuals count with denominator 1).

    R² follows the usual convention for a constant actual series: 1 when the
    predictions are exact, else 0.
    """
    y = F.col(actual).cast("double")
    e = y - F.col(pred).cast("double")
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(y).alias("_var"),
        (F.avg(F.abs(e / F.when(y == 0, F.lit(1.0)).otherwise(y))) * 100).alias("mape"),
    )
    sst = F.col("_var") * F.col("n")
    r2 = (F.when(sst > 0, 1 - F.col("_sse") / sst)
           .when(F.col("_sse") == 0, F.lit(1.0))
           .otherwise(F.lit(0.0)))
    return agg.withColumn("r2", r2).drop("_sse", "_var")


def model_metrics_long(df: DataFrame, actual: str, preds: dict[str, str], segment: str = "segment_id") -> DataFrame:
    """M8: metrics for several prediction columns at once, one row per (segment, model).

    The prediction columns are unpivoted with ``stack`` so a single grouped
    aggregation computes every model's metrics.
    """
    stacked = df.select(
        segment, F.col(actual).alias("_y"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("_p"))
                           for n, c in preds.items()])))
    return regression_metrics(stacked, "_y", "_p", [segment, "model"])


def residual_stats(df: DataFrame, actual: str, pred_cols: list[str], segment: str = "segment_id",
                   quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.95)) -> DataFrame:
    """M5: residuals of the ensemble mean on training rows → population std and exact quantiles.

    Quantiles use exact ``percentile`` (linear interpolation), never the
    approximate sketch, as the reference uses ``np.percentile``.
    """
    mean = sum(F.col(c) for c in pred_cols) / len(pred_cols)
    res = F.col(actual).cast("double") - mean
    q = F.percentile(res, F.array(*[F.lit(x) for x in quantiles]))
    agg = df.groupBy(segment).agg(F.stddev_pop(res).alias("residual_std"), q.alias("_q"),
                                  F.count(F.lit(1)).alias("n_train"))
    names = {f"q{int(round(x * 100)):02d}": F.element_at("_q", i + 1) for i, x in enumerate(quantiles)}
    return agg.withColumns(names).drop("_q")


def model_spread(pred_cols: list[str]) -> tuple[Column, Column]:
    """Mean and population std across model predictions of one row."""
    k = len(pred_cols)
    mean = sum(F.col(c) for c in pred_cols) / k
    var = sum((F.col(c) - mean) * (F.col(c) - mean) for c in pred_cols) / k
    return mean, F.sqrt(var)


def predict_interval(df: DataFrame, pred_cols: list[str], residual_std: str = "residual_std",
                     z: float = Z95) -> DataFrame:
    """M6 + F10: mean ± z·√(σ_res² + σ_model²), every output clamped at 0; a missing member leaves them null."""
    mean, spread = model_spread(pred_cols)
    total = F.sqrt(F.col(residual_std) ** 2 + spread ** 2)
    return df.withColumns({
        "model_std": spread,
        "pred_mean": at_least(mean, 0.0),
        "pred_lower": at_least(mean - z * total, 0.0),
        "pred_upper": at_least(mean + z * total, 0.0),
    })


def interval_quality(df: DataFrame, actual: str = "total_crashes", lower: str = "pred_lower",
                     upper: str = "pred_upper", mean: str = "pred_mean", segment: str = "segment_id") -> DataFrame:
    """Coverage % (inclusive), mean width and mean error-bar sizes per segment."""
    y = F.col(actual).cast("double")
    inside = ((y >= F.col(lower)) & (y <= F.col(upper))).cast("double")
    return df.groupBy(segment).agg(
        (F.avg(inside) * 100).alias("coverage_pct"),
        F.avg(F.col(upper) - F.col(lower)).alias("avg_width"),
        F.avg(F.col(mean) - F.col(lower)).alias("avg_lower_error"),
        F.avg(F.col(upper) - F.col(mean)).alias("avg_upper_error"),
    )


def error_bars(df: DataFrame, mean: str = "pred_mean", lower: str = "pred_lower", upper: str = "pred_upper") -> DataFrame:
    """Per-row error-bar sizes."""
    return df.withColumns({"lower_error": F.col(mean) - F.col(lower), "upper_error": F.col(upper) - F.col(mean)})


def improvement(metrics: DataFrame, base: str = "baseline", model: str = "ensemble",
                segment: str = "segment_id") -> DataFrame:
    """E5: R² gain relative to |baseline R²| and MAE reduction relative to baseline MAE, in %."""
    p = metrics.groupBy(segment).agg(
        F.max(F.when(F.col("model") == base, F.col("mae"))).alias("mae_baseline"),
        F.max(F.when(F.col("model") == model, F.col("mae"))).alias("mae_model"),
        F.max(F.when(F.col("model") == base, F.col("r2"))).alias("r2_baseline"),
        F.max(F.when(F.col("model") == model, F.col("r2"))).alias("r2_model"),
    )
    return p.withColumns({
        "r2_improvement_pct": F.when(F.col("r2_baseline") != 0,
                                     (F.col("r2_model") - F.col("r2_baseline")) / F.abs("r2_baseline") * 100),
        "mae_improvement_pct": F.when(F.col("mae_baseline") != 0,
                                      (F.col("mae_baseline") - F.col("mae_model")) / F.col("mae_baseline") * 100),
    })


def metrics_long(metrics: DataFrame, segment: str = "segment_id") -> DataFrame:
    """(segment, model, metric, value) long form for comparison charts."""
    return metrics.unpivot([segment, "model"], ["mae", "rmse", "r2"], "metric", "value")
