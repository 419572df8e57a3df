"""Recursive multi-week forecasting for all segments at once.

Design: the horizon is sequential (step i needs the prediction of step i−1)
but segments are independent, so the engine keeps **one state row per
segment** and advances every segment together, one DataFrame transform per
step.  The state holds only what the next step can read: the last 12 target
values (as many as the longest lag or rolling window needs), the carried exogenous
measures, and the pre-computed future calendar with its seasonal lookups as an
array of ``n_weeks`` structs.  Per step: project features → score with the
predictor → blend → append the prediction to the ring buffer.  Lineage is cut
by storing it under the checkpoint folder (executor-loss safe).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segcast.functions import noise as ns
from segcast.functions import labels as lb
from segcast.functions import poisson as po
from segcast.functions.numeric import at_least, round_half_even
from segcast.operators import features as fe
from segcast.operators import seasonal as se
from segcast.session import store

HIST = max(*fe.LAGS, *fe.ROLL_WINDOWS)
Z95 = 1.96
CALENDAR_FIELDS = ["step", "week_start", "year", "month", "quarter", "week_of_year", *fe.CYCLIC, "season_mean", "season_std"]


# ---------------------------------------------------------------------------------------
# H1, H2: future calendar and carried exogenous values
# ---------------------------------------------------------------------------------------
def future_calendar(origins: DataFrame, n_weeks: int, segment: str = "segment_id",
                    origin: str = "last_week") -> DataFrame:
    """H1: the next ``n_weeks`` week labels after each segment's origin, with calendar parts.

    ``step`` is 0-based (step i is week origin + 7·(i+1)).
    """
    out = (origins.select(segment, origin)
                  .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_weeks - 1))))
                  .withColumn("week_start", F.date_add(F.col(origin), (F.col("step") + 1) * 7)))
    wk = F.col("week_start")
    out = out.withColumns({"year": F.year(wk), "month": F.month(wk), "quarter": F.quarter(wk),
                           "week_of_year": F.weekofyear(wk)})
    return out.withColumns(fe.cyclic_columns(F.col("week_of_year"), F.col("month")))


def carry_forward(panel: DataFrame, cols: list[str] | None = None, segment: str = "segment_id",
                  week: str = "week_start") -> DataFrame:
    """H2: the last row's exogenous measures per segment (``max_by`` aggregation, no sort)."""
    cols = [c for c in (cols or fe.CARRIED) if c in panel.columns]
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(week))
    return panel.groupBy(segment).agg(last.alias("_last")).select(segment, "_last.*")


def history_state(panel: DataFrame, target: str = "total_crashes", segment: str = "segment_id",
                  week: str = "week_start", n: int = HIST) -> DataFrame:
    """W9 state: the last ``n`` target values (oldest first) and the history length per segment.

    Built with a window rank + bounded ``collect_list`` (at most ``n`` values
    per segment), never by collecting a whole history.
    """
    w = Window.partitionBy(segment).orderBy(F.col(week).desc())
    recent = panel.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
    return recent.groupBy(segment).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(week).alias("w"),
                                                         F.col(target).cast("double").alias("y")))),
                    lambda s: s["y"]).alias("hist"))


# ---------------------------------------------------------------------------------------
# Features of the next row from the state
# ---------------------------------------------------------------------------------------
def tail(h: Column, n: int) -> Column:
    """The last ``n`` values, or all if there are fewer."""
    return F.slice(h, F.greatest(F.size(h) - n, F.lit(0)) + 1, F.lit(n))


def tail_mean(h: Column, n: int) -> Column:
    t = tail(h, n)
    return F.aggregate(t, F.lit(0.0), lambda a, x: a + x) / F.size(t)


def tail_std(h: Column, n: int) -> Column:
    """Sample std of the last n values (0 for a single value)."""
    t = tail(h, n)
    m = tail_mean(h, n)
    ss = F.aggregate(t, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(t) > 1, F.sqrt(ss / (F.size(t) - 1))).otherwise(F.lit(0.0))


def tail_max(h: Column, n: int) -> Column:
    return F.array_max(tail(h, n))


def next_row_features(hist: Column, n_hist: Column, lag_policy: str = "zero", missing_lag: Column | None = None,
                      rolling_guard: bool = True, change_policy: str = "zero") -> dict[str, Column]:
    """Lag, rolling and change features of the next week from the extended history.

    * ``lag_policy``: ``"zero"`` (risk/interval variants; unset → 0) or
      ``"value"`` (use ``missing_lag``, e.g. the overall mean) when the history
      is shorter than the lag.
    * ``rolling_guard``: rolling stats only when ≥ window values exist (else 0).
    * ``change_policy``: ``"zero"`` (left unset → 0) or ``"recent"``:
      y[-1]−y[-2] and y[-1]−y[-4] (a 3-step difference, as the reference).
    """
    out: dict[str, Column] = {}
    for k in fe.LAGS:
        fallback = missing_lag if (lag_policy == "value" and missing_lag is not None) else F.lit(0.0)
        out[f"crashes_lag_{k}w"] = F.when(n_hist >= k, F.element_at(hist, -k)).otherwise(fallback)
    for w in fe.ROLL_WINDOWS:
        ok = (n_hist >= w) if rolling_guard else F.size(hist) > 0
        out[f"crashes_rolling_mean_{w}w"] = F.when(ok, tail_mean(hist, w)).otherwise(F.lit(0.0))
        out[f"crashes_rolling_std_{w}w"] = F.when(ok, tail_std(hist, w)).otherwise(F.lit(0.0))
        out[f"crashes_rolling_max_{w}w"] = F.when(ok, tail_max(hist, w)).otherwise(F.lit(0.0))
    if change_policy == "recent":
        out["crash_change_1w"] = F.when(n_hist >= 2, F.element_at(hist, -1) - F.element_at(hist, -2)).otherwise(F.lit(0.0))
        out["crash_change_4w"] = F.when(n_hist >= 4, F.element_at(hist, -1) - F.element_at(hist, -4)).otherwise(F.lit(0.0))
    else:
        out["crash_change_1w"] = F.lit(0.0)
        out["crash_change_4w"] = F.lit(0.0)
    return out


def push(hist: Column, value: Column, n: int = HIST) -> Column:
    """Append ``value`` and keep the last ``n`` entries."""
    h = F.concat(hist, F.array(value.cast("double")))
    return F.when(F.size(h) > n, F.slice(h, 2, n)).otherwise(h)


# ---------------------------------------------------------------------------------------
# Blends (pure column arithmetic on step i)
# ---------------------------------------------------------------------------------------
def horizon_factor(step: Column, n_weeks: int) -> Column:
    """H9: 1 + i/n·0.5 (1.0 → 1.5)."""
    return 1 + step / F.lit(float(n_weeks)) * 0.5


def blend_risk(step: Column, n_weeks: int, ml: Column, model_std: Column, seasonal: Column,
               overall_std: Column, residual_std: Column, floor: float = 0.01) -> dict[str, Column]:
    """H4 + H10 + H11 (risk variant): λ, base/total uncertainty and method label."""
    i = step.cast("double")
    w1 = F.least((i - 4) / 8, F.lit(1.0)) * 0.3
    w2 = 0.3 + (i - 12) / 12 * 0.4
    lam = (F.when(i < 4, ml)
            .when(i < 12, ml * (1 - w1) + seasonal * w1)
            .when(i < 24, ml * (1 - w2) + seasonal * w2)
            .otherwise(seasonal))
    base = (F.when(i < 4, model_std)
             .when(i < 12, model_std * (1 - w1) + overall_std * 0.3 * w1)
             .when(i < 24, model_std * (1 - w2) + overall_std * 0.5 * w2)
             .otherwise(overall_std))
    method = (F.when(i < 4, "ML").when(i < 12, "ML+Season").when(i < 24, "Hybrid").otherwise("Seasonal"))
    total = F.sqrt(residual_std * residual_std + base * base) * horizon_factor(i, n_weeks)
    return {"lambda": at_least(lam, floor), "base_std": base, "total_std": total, "method": method}


def risk_columns(lam: Column, total_std: Column, model_std: Column, residual_std: Column,
                 mode_max: int | None = None) -> dict[str, Column]:
    """D5 output columns from λ: bounds, ``ci_method``, mode, probabilities, 4-tier risk, rounded.

    The mode is the true one; ``mode_max=19`` gives the reference's search range.
    """
    iv = po.select_interval(lam, total_std)
    mode, pmode = po.mode(lam, mode_max)
    out = {
        "predicted_lower": iv["predicted_lower"],
        "predicted_upper": iv["predicted_upper"],
        "ci_method": iv["ci_method"],
        "model_uncertainty": round_half_even(model_std, 3) + 0.0,
        "residual_uncertainty": round_half_even(residual_std, 3) + 0.0,
        "total_uncertainty": round_half_even(total_std, 3) + 0.0,
        "most_likely_crashes": mode,
        "probability_pct": round_half_even(pmode, 1) + 0.0,
        "risk_level": lb.risk_level_4(lam),
    }
    out.update(po.prob_columns(lam))
    return out


def blend_interval(step: Column, n_weeks: int, ml_mean: Column, ml_lower: Column, ml_upper: Column,
                   s_mean: Column, s_std: Column) -> dict[str, Column]:
    """H5: interval blend (weights 0→0.2, 0.2→0.5, 0.5→0.8) with band-specific interval rules."""
    i = step.cast("double")
    hf = horizon_factor(i, n_weeks)
    w1 = (i - 4) / 8 * 0.2
    w2 = 0.2 + (i - 12) / 12 * 0.3
    w3 = 0.5 + F.least((i - 24) / 12 * 0.3, F.lit(0.3))
    w = F.when(i < 4, F.lit(0.0)).when(i < 12, w1).when(i < 24, w2).otherwise(w3)
    mean = ml_mean * (1 - w) + s_mean * w
    width2 = (ml_upper - ml_lower) * hf
    width3 = s_std * 2.5 * hf
    lower = (F.when(i < 4, ml_lower)
              .when(i < 12, ml_lower * (1 - w1) + (s_mean - s_std * Z95) * w1)
              .when(i < 24, mean - width2 / 2)
              .otherwise(mean - width3))
    upper = (F.when(i < 4, ml_upper)
              .when(i < 12, ml_upper * (1 - w1) + (s_mean + s_std * Z95) * w1)
              .when(i < 24, mean + width2 / 2)
              .otherwise(mean + width3))
    method = F.when(i < 4, "ML").when(i < 12, "ML+Season").when(i < 24, "Hybrid").otherwise("Seasonal")
    mean_c = at_least(mean, 0.0)
    return {"final_mean": mean_c, "final_lower": at_least(lower, 0.0),
            "final_upper": F.when(upper.isNotNull(), F.greatest(upper, mean_c)), "method": method}


def interval_columns(mean: Column, lower: Column, upper: Column, week: Column) -> dict[str, Column]:
    """D6 output: rounded mean/bounds, ``crash_range``, bounded mode + likelihood, month name."""
    mode, pmode = po.mode(mean, upper.cast("int") + 2)
    return {
        "predicted_mean": round_half_even(mean, 2) + 0.0,
        "predicted_lower": round_half_even(lower, 2) + 0.0,
        "predicted_upper": round_half_even(upper, 2) + 0.0,
        "crash_range": lb.crash_range(lower, upper),
        "most_likely_crashes": mode,
        "likelihood_percent": round_half_even(pmode, 1) + 0.0,
        "month_name": lb.month_name(week),
    }


def blend_mean(step: Column, ml: Column, s_mean: Column, s_std: Column, noise: tuple[float, float] = (0.15, 0.2),
               noise_scale: float = 0.0, seed: int = 42, segment: Column | None = None) -> dict[str, Column]:
    """H6/H7: mean blend with optional Gaussian noise for the long bands.

    ``noise=(0.15, 0.2)`` is the hybrid variant (H6), ``(0.1, 0.1)`` the earlier
    one (H7).  The reference's noise is unseeded; here each (seed, ``segment``, step) has
    a normal number of its own (``functions.noise``), scaled by ``noise_scale`` (0: none).
    """
    i = step.cast("double")
    ml = at_least(ml, 0.0)
    w = (F.when(i < 4, F.lit(0.0)).when(i < 12, (i - 4) / 8 * 0.2).when(i < 24, 0.2 + (i - 12) / 12 * 0.3)
          .otherwise(0.5 + F.least((i - 24) / 12 * 0.3, F.lit(0.3))))
    mean = ml * (1 - w) + s_mean * w
    if noise_scale:
        z = ns.normal(seed, F.lit("") if segment is None else segment, step) * noise_scale
        mean = mean + F.when(i < 12, F.lit(0.0)).when(i < 24, z * s_std * noise[0]).otherwise(z * s_std * noise[1])
    method = F.when(i < 4, "ML").when(i < 12, "ML+Season").when(i < 24, "Hybrid").otherwise("Seasonal")
    return {"final_pred": at_least(mean, 0.0), "method": method}


def seasonal_factor(step: Column, pred: Column, s_mean: Column, overall_mean: Column) -> Column:
    """H8: from step 12 on, move up to 30 % of the way to ``pred · seasonal/overall``."""
    i = step.cast("double")
    factor = F.coalesce(s_mean / F.when(overall_mean != 0, overall_mean), F.lit(1.0))
    w = F.least((i - 12) / 24, F.lit(0.3))
    p = at_least(pred, 0.0)
    return F.when(i < 12, p).otherwise(at_least(p * (1 - w) + p * factor * w, 0.0))


# ---------------------------------------------------------------------------------------
# H3: the recursive engine
# ---------------------------------------------------------------------------------------
Predictor = Callable[[DataFrame], DataFrame]


def initial_state(panel: DataFrame, n_weeks: int, segment: str = "segment_id") -> DataFrame:
    """State row per segment: ring buffer, carried measures, stats and the future calendar."""
    stats = se.overall_stats(panel)
    prof = se.seasonal_profile(panel)
    cal = future_calendar(stats, n_weeks)
    cal = se.lookup_with_default(cal, prof, stats)
    cal_arr = cal.groupBy(segment).agg(
        F.array_sort(F.collect_list(F.struct(*CALENDAR_FIELDS))).alias("calendar"))
    carried = carry_forward(panel)
    hist = history_state(panel)
    return (stats.join(hist, segment).join(carried, segment).join(cal_arr, segment)
                 .withColumn("outputs", F.array().cast("array<struct<step:int>>")))


def fold_recursive(state: DataFrame, n_weeks: int, advance: Callable[[dict[str, Column]], dict[str, Column]],
                   out_schema: str, segment: str = "segment_id", feature_kwargs: dict | None = None) -> DataFrame:
    """H3 for predictors that are column expressions: the whole horizon in one ``aggregate`` over the calendar.

    ``advance`` gets the next row's columns by name (calendar, seasonal lookups,
    features) and returns the output columns and ``next_value``; ``out_schema`` is
    the DDL of the output columns.  State columns are read with ``F.col``.
    """
    kw = feature_kwargs or {}
    names = [f.split()[0].strip("`") for f in out_schema.split(", ")]
    missing = F.col("overall_mean") if kw.get("lag_policy") == "value" else None

    def step(acc: Column, cal: Column) -> Column:
        row = {c: cal[c] for c in CALENDAR_FIELDS}
        row |= next_row_features(acc["hist"], F.col("n_weeks") + cal["step"], missing_lag=missing, **kw)
        made = advance(row)
        out = F.struct(*[(cal[c] if c in ("step", "week_start") else made[c]).alias(c) for c in names])
        return F.struct(push(acc["hist"], made["next_value"]).alias("hist"), F.concat(acc["rows"], F.array(out)).alias("rows"))

    start = F.struct(F.col("hist"), F.array().cast(f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in out_schema.split(', '))}>>").alias("rows"))
    rows = F.aggregate(F.slice("calendar", 1, n_weeks), start, step, lambda acc: acc["rows"])
    return state.select(segment, F.inline(rows))


def run_recursive(state: DataFrame, n_weeks: int, predictor: Predictor, blend: Callable[[DataFrame], DataFrame],
                  out_cols: list[str], checkpoint_every: int = 1, segment: str = "segment_id",
                  feature_kwargs: dict | None = None) -> DataFrame:
    """Advance all segments ``n_weeks`` steps and return one row per (segment, step).

    ``predictor`` adds model columns to a frame of next-week feature rows;
    ``blend`` turns them into the final value (column ``next_value``) plus the
    output columns listed in ``out_cols``.

    Each step's state is stored under the checkpoint folder (default every
    step): the next step reads the ring buffer many times, so without that the
    expression trees compound from step to step.  The state is one row per
    segment, so a store costs O(segments).  Predictors that are plain column
    expressions need no steps: see ``fold_recursive``.
    """
    kw = feature_kwargs or {}
    cur = store(state.drop("outputs"), "state") if checkpoint_every else state.drop("outputs")
    for i in range(n_weeks):
        # one projection for the next row's features, one for the state update: few analyses per step
        row = F.element_at("calendar", i + 1)
        missing = F.col("overall_mean") if kw.get("lag_policy") == "value" else None
        feats = [row[c].alias(c) for c in CALENDAR_FIELDS]
        feats += [c.alias(n) for n, c in
                  next_row_features(F.col("hist"), F.col("n_weeks") + i, missing_lag=missing, **kw).items()]
        scored = blend(predictor(cur.select("*", *feats)))
        out = F.array(F.struct(*[F.col(c) for c in out_cols]))
        acc = F.concat(F.col("_acc"), out) if "_acc" in cur.columns else out
        keep = [c for c in cur.columns if c not in ("hist", "_acc")]
        cur = scored.select(*keep, push(F.col("hist"), F.col("next_value")).alias("hist"), acc.alias("_acc"))
        if checkpoint_every and (i + 1) % checkpoint_every == 0 and i + 1 < n_weeks:
            cur = store(cur, "state")
    return cur.select(segment, F.inline("_acc"))


def forecast_summary(fcst: DataFrame, value: str = "lambda", segment: str = "segment_id",
                     step: str = "step") -> DataFrame:
    """Per-segment totals, spread, mean CI width, mean uncertainties and first/last value."""
    v = F.col(value)
    return fcst.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.sum(v).alias(f"{value}_sum"),
        F.avg(v).alias(f"{value}_mean"),
        F.min(v).alias(f"{value}_min"),
        F.max(v).alias(f"{value}_max"),
        F.stddev_samp(v).alias(f"{value}_std"),
        F.avg(F.col("predicted_upper") - F.col("predicted_lower")).alias("avg_ci_width"),
        F.avg("model_uncertainty").alias("avg_model_uncertainty"),
        F.avg("total_uncertainty").alias("avg_total_uncertainty"),
        F.min_by(v, F.col(step)).alias(f"first_{value}"),
        F.max_by(v, F.col(step)).alias(f"last_{value}"),
    )
