"""The whole forecast horizon of all segments in one pass (H3–H8 with fitted members, G1).

One row per segment goes in (ring buffer, carried measures, calendar, ridge coefficients),
one row per segment comes out, with an array of ``n_weeks`` values for each output.  In
between a task advances all segments of a batch together, step by step, as numpy arrays:
features of the next week, three members, blend, push.  Segments are independent, so
there is one job for the horizon, whatever its length, and nothing is stored per step.

The arithmetic is that of ``forecast`` (``next_row_features``, ``blend_*``) in the same
order, and tests hold it equal to ``forecast.run_recursive`` step by step.  A segment whose
values stop being finite gets an error and no forecast; the others are not touched by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segcast.functions import noise
from segcast.operators import features as fe
from segcast.operators import forecast as fc
from segcast.operators import models as md
from segcast.operators.trees import FlatTrees

#: Output arrays of each variant; the first is the value fed back.
OUTPUTS = {
    "risk": ["lambda", "model_std", "total_std"],
    "interval": ["final_mean", "final_lower", "final_upper"],
    "mean": ["final_pred"],
    "factor": ["final_pred"],
}
#: How each variant fills short histories (see ``forecast.next_row_features``).
POLICIES = {
    "risk": {}, "interval": {},
    "mean": {"lag_policy": "value", "change_policy": "recent"},
    "factor": {"rolling_guard": False, "change_policy": "recent"},
}
_CALENDAR = [c for c in fc.CALENDAR_FIELDS if c not in ("step", "week_start")]
_SCALARS = ["n_weeks", "overall_mean", "overall_std", "residual_std", "intercept", md.SEGMENT_MEAN]


class _State:
    """The segments of one batch: ring buffer (newest last), its filling, and everything else by name."""

    def __init__(self, rows: pd.DataFrame) -> None:
        n = len(rows)
        self.hist, self.filled = np.zeros((n, fc.HIST)), np.zeros(n, int)
        for i, h in enumerate(rows["hist"]):
            self.filled[i] = len(h)
            if len(h):
                self.hist[i, -len(h):] = h
        self.scalar = {c: rows[c].to_numpy(float) for c in [*_SCALARS, *fe.CARRIED]}
        self.calendar = {c: np.array(rows[c].tolist(), float).reshape(n, -1) for c in _CALENDAR}
        self.coef = np.array(rows["coef"].tolist(), float).reshape(n, -1)

    def tail(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, sample std and maximum of the last ``w`` values, or of those there are; added oldest first."""
        size = np.minimum(self.filled, w)
        there = [size >= back for back in range(w, 0, -1)]
        values = [self.hist[:, -back] for back in range(w, 0, -1)]
        total, squares, top = np.zeros(len(size)), np.zeros(len(size)), np.full(len(size), -np.inf)
        for ok, v in zip(there, values):
            total = np.where(ok, total + v, total)
            top = np.where(ok, np.maximum(top, v), top)
        mean = total / np.maximum(size, 1)
        for ok, v in zip(there, values):
            squares = np.where(ok, squares + (v - mean) * (v - mean), squares)
        std = np.where(size > 1, np.sqrt(squares / np.maximum(size - 1, 1)), 0.0)
        return mean, std, np.where(size > 0, top, 0.0)

    def push(self, value: np.ndarray) -> None:
        self.hist = np.concatenate([self.hist[:, 1:], value[:, None]], axis=1)
        self.filled = np.minimum(self.filled + 1, fc.HIST)


def next_features(state: _State, step: int, lag_policy: str = "zero", rolling_guard: bool = True,
                  change_policy: str = "zero") -> dict[str, np.ndarray]:
    """``forecast.next_row_features`` for all segments of a batch, with the calendar and carried columns."""
    n_hist, h = state.scalar["n_weeks"] + step, state.hist
    out = {c: v[:, step] for c, v in state.calendar.items()} | {c: state.scalar[c] for c in [*fe.CARRIED, md.SEGMENT_MEAN]}
    missing = state.scalar["overall_mean"] if lag_policy == "value" else 0.0
    for k in fe.LAGS:
        out[f"crashes_lag_{k}w"] = np.where(n_hist >= k, h[:, -k], missing)
    for w in fe.ROLL_WINDOWS:
        ok = (n_hist >= w) if rolling_guard else state.filled > 0
        for name, v in zip(("mean", "std", "max"), state.tail(w)):
            out[f"crashes_rolling_{name}_{w}w"] = np.where(ok, v, 0.0)
    for k in (1, 4):
        recent = change_policy == "recent"
        back = {1: 2, 4: 4}[k]
        out[f"crash_change_{k}w"] = np.where(recent & (n_hist >= back), h[:, -1] - h[:, -back], 0.0)
    return out


def _blend_risk(i: int, n: int, s: _State, m: dict) -> dict[str, np.ndarray]:
    w1, w2 = min((i - 4) / 8, 1.0) * 0.3, 0.3 + (i - 12) / 12 * 0.4
    season, overall, std = m["season_mean"], s.scalar["overall_std"], m["std"]
    if i < 4:
        lam, base = m["mean"], std
    elif i < 12:
        lam, base = m["mean"] * (1 - w1) + season * w1, std * (1 - w1) + overall * 0.3 * w1
    elif i < 24:
        lam, base = m["mean"] * (1 - w2) + season * w2, std * (1 - w2) + overall * 0.5 * w2
    else:
        lam, base = season, overall
    residual = s.scalar["residual_std"]
    total = np.sqrt(residual * residual + base * base) * (1 + i / n * 0.5)
    return {"lambda": np.maximum(lam, 0.01), "model_std": std, "total_std": total}


def _long_weight(i: int) -> float:
    return 0.0 if i < 4 else (i - 4) / 8 * 0.2 if i < 12 else 0.2 + (i - 12) / 12 * 0.3 if i < 24 else 0.5 + min((i - 24) / 12 * 0.3, 0.3)


def _blend_interval(i: int, n: int, s: _State, m: dict) -> dict[str, np.ndarray]:
    total = np.sqrt(s.scalar["residual_std"] ** 2 + m["std"] ** 2)
    ml = np.maximum(m["mean"], 0.0)
    low, high = (np.maximum(m["mean"] + z * total, 0.0) for z in (-fc.Z95, fc.Z95))
    w, wider = _long_weight(i), 1 + i / n * 0.5
    season, spread = m["season_mean"], m["season_std"]
    mean = ml * (1 - w) + season * w
    if i < 4:
        lower, upper = low, high
    elif i < 12:
        lower = low * (1 - w) + (season - spread * fc.Z95) * w
        upper = high * (1 - w) + (season + spread * fc.Z95) * w
    else:
        half = (high - low) * wider / 2 if i < 24 else spread * 2.5 * wider
        lower, upper = mean - half, mean + half
    mean = np.maximum(mean, 0.0)
    return {"final_mean": mean, "final_lower": np.maximum(lower, 0.0), "final_upper": np.maximum(upper, mean)}


def _blend_mean(i: int, n: int, s: _State, m: dict) -> dict[str, np.ndarray]:
    w = _long_weight(i)
    mean = np.maximum(m["mean"], 0.0) * (1 - w) + m["season_mean"] * w
    if i >= 12:
        mean = mean + m["noise"] * m["season_std"] * (0.15 if i < 24 else 0.2)
    return {"final_pred": np.maximum(mean, 0.0)}


def _blend_factor(i: int, n: int, s: _State, m: dict) -> dict[str, np.ndarray]:
    p = np.maximum(m["mean"], 0.0)
    if i >= 12:
        overall = s.scalar["overall_mean"]
        factor = np.where(overall != 0, m["season_mean"] / np.where(overall != 0, overall, 1.0), 1.0)
        w = min((i - 12) / 24, 0.3)
        p = np.maximum(p * (1 - w) + p * factor * w, 0.0)
    return {"final_pred": p}


_BLENDS: dict[str, Callable] = {"risk": _blend_risk, "interval": _blend_interval, "mean": _blend_mean, "factor": _blend_factor}


def advance(rows: pd.DataFrame, n_weeks: int, variant: str, rf: FlatTrees, gb: FlatTrees, feature_cols: list[str],
            noise_scale: float, seed: int, segment: str) -> tuple[dict[str, np.ndarray], list[str | None]]:
    """Outputs (segments by weeks) of a batch of state rows, and each segment's error, if any."""
    state = _State(rows)
    ridge_cols = [c for c in feature_cols if c != md.SEGMENT_MEAN]
    made = {name: np.zeros((len(rows), n_weeks)) for name in OUTPUTS[variant]}
    error: list[str | None] = [None] * len(rows)
    for i in range(n_weeks):
        f = next_features(state, i, **POLICIES[variant])
        x = np.stack([f[c] for c in feature_cols], axis=1)
        ridge = state.scalar["intercept"].copy()
        for j, c in enumerate(ridge_cols):
            ridge = ridge + state.coef[:, j] * np.nan_to_num(f[c], nan=0.0, posinf=np.inf, neginf=-np.inf)
        members = [rf.predict(x), gb.predict(x), ridge]
        mean = (members[0] + members[1] + members[2]) / 3
        spread = ((members[0] - mean) ** 2 + (members[1] - mean) ** 2 + (members[2] - mean) ** 2) / 3
        m = {"mean": mean, "std": np.sqrt(spread), "season_mean": f["season_mean"], "season_std": f["season_std"]}
        if noise_scale and variant == "mean" and i >= 12:
            m["noise"] = np.array([noise.normal_value(seed, s, i) for s in rows[segment]]) * noise_scale
        else:
            m["noise"] = np.zeros(len(rows))
        out = _BLENDS[variant](i, n_weeks, state, m)
        finite = np.isfinite(mean)
        for name, v in out.items():
            made[name][:, i] = v
            finite &= np.isfinite(v)
        for k in np.flatnonzero(~finite).tolist():
            error[k] = error[k] or f"forecast of week {i + 1} is not finite"
        state.push(out[OUTPUTS[variant][0]])
    return made, error


def forecast_horizon(state: DataFrame, ens: md.Ensemble, n_weeks: int, variant: str = "risk", noise_scale: float = 0.0,
                     seed: int = 42, segment: str = "segment_id") -> DataFrame:
    """One row per segment: ``last_week``, ``residual_std``, an array per output of the variant, and ``error``.

    ``state`` is ``forecast.initial_state`` with ``residual_std``, the segment mean and the ridge
    coefficients.  Of a segment with an error the arrays are null.
    """
    if variant not in OUTPUTS:
        raise ValueError(f"unknown variant {variant!r}")
    spark = state.sparkSession
    rf, gb = ens.flat(spark)
    cols, names = list(ens.feature_cols), OUTPUTS[variant]
    arrays = [F.col("calendar").getField(f).cast("array<double>").alias(f) for f in _CALENDAR]
    base = state.select(segment, "last_week", "hist", "coef", *[F.col(c).cast("double").alias(c) for c in [*_SCALARS, *fe.CARRIED]], *arrays)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(all="ignore"):
            for rows in batches:
                made, error = advance(rows, n_weeks, variant, rf, gb, cols, noise_scale, seed, segment)
                out = rows[[segment, "last_week", "residual_std"]].copy()
                for name in names:
                    out[name] = [None if e else v.tolist() for v, e in zip(made[name], error)]
                out["error"] = pd.Series(error, index=out.index, dtype=object)
                yield out

    kind = dict(base.dtypes)
    schema = f"{segment} {kind[segment]}, last_week date, residual_std double, " + ", ".join(f"`{n}` array<double>" for n in names)
    return base.mapInPandas(run, schema + ", error string")


def method_of(step: Column, variant: str) -> Column:
    """The method label of each step (H4–H8)."""
    if variant == "factor":
        return F.lit("ML+SeasonalFactor")
    return F.when(step < 4, "ML").when(step < 12, "ML+Season").when(step < 24, "Hybrid").otherwise("Seasonal")


def horizon_rows(horizon: DataFrame, variant: str, segment: str = "segment_id") -> DataFrame:
    """The forecast of the segments without error: one row per (segment, step) with calendar, outputs and method."""
    names = OUTPUTS[variant]
    fields = F.arrays_zip(*[F.col(f"`{n}`") for n in names])
    rows = horizon.where(F.col("error").isNull()).select(segment, "last_week", "residual_std", F.posexplode(fields).alias("step", "o"))
    week = F.date_add("last_week", (F.col("step") + 1) * 7)
    rows = rows.select(segment, "step", week.alias("week_start"), "residual_std", *[F.col("o")[n].alias(n) for n in names])
    return rows.withColumns({"week_of_year": F.weekofyear("week_start"), "method": method_of(F.col("step"), variant)})
