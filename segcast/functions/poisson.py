"""Poisson count-distribution operators as pure Column expressions.

Everything runs inside whole-stage codegen or as a built-in higher-order
function over a short per-row array; no Python UDF.  Probabilities use log
space (``log p_k = log p_{k-1} + ln λ − ln k``) so large λ (where ``exp(-λ)``
underflows) stays exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from segcast.functions.numeric import round_half_even

Z95 = 1.96


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def pmf(k: int, lam: Column) -> Column:
    """P(X = k) for a small literal k (λ = 0 gives 1 for k = 0, else 0)."""
    fact = 1
    for j in range(2, k + 1):
        fact *= j
    return F.exp(-lam) * F.pow(lam, F.lit(float(k))) / F.lit(float(fact))


#: ln(k!) for k below 16, where the Stirling series is not yet exact enough.
_SMALL = 16
_LOG_FACTORIAL = [math.lgamma(k + 1.0) for k in range(_SMALL)]


def log_pmf(k: Column, lam: Column) -> Column:
    """ln P(X = k) for λ > 0 and an integer column k ≥ 0 of any size, in O(1).

    From k = 16 on the saddle-point form −(k·ln(k/λ) + λ − k) − ½·ln(2πk) − δ(k)
    keeps the digits that −λ + k·ln λ − ln k! would lose for large λ.
    """
    kd = F.greatest(k, F.lit(1)).cast("double")
    table = F.element_at(F.array(*[F.lit(v) for v in _LOG_FACTORIAL]), F.least(k, F.lit(_SMALL - 1)).cast("int") + 1)
    small = -lam + k * F.log(lam) - table
    x = (kd - lam) / lam
    deviance = lam * ((1 + x) * F.log1p(x) - x)
    delta = 1 / (12 * kd) - 1 / (360 * kd * kd * kd) + 1 / (1260 * F.pow(kd, F.lit(5.0)))
    return F.when(k < _SMALL, small).otherwise(-deviance - 0.5 * F.log(2 * math.pi * kd) - delta)


def pmf_at(k: Column, lam: Column) -> Column:
    """P(X = k) for an integer column k, in log space."""
    return F.when(lam <= 0, F.when(k == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.exp(log_pmf(k, lam)))


def prob_columns(lam: Column, pct: bool = True, nd: int | None = 1) -> dict[str, Column]:
    """P1 + P2: ``prob_0_crash``..``prob_3_crash`` and ``prob_ge4_crash`` (in % by default)."""
    ps = [pmf(k, lam) for k in range(4)]
    tail = F.lit(1.0) - (ps[0] + ps[1] + ps[2] + ps[3])
    scale = 100.0 if pct else 1.0
    out = {f"prob_{k}_crash": ps[k] * scale for k in range(4)}
    out["prob_ge4_crash"] = tail * scale
    if nd is not None:
        out = {n: round_half_even(c, nd) + F.lit(0.0) for n, c in out.items()}
    return out


def quantiles(lam: Column, qs: tuple[float, ...]) -> Column:
    """Array of Poisson ``ppf(q, λ)`` – smallest k with cdf(k) ≥ q – for rising ``qs`` (0 for λ ≤ 0).

    One ``aggregate`` accumulates the cdf over the k within 12 standard
    deviations of λ (the mass below is under 1e-30), so a row costs O(√λ).
    """
    first = F.greatest(F.lit(0), F.floor(lam - 12 * F.sqrt(lam) - 20)).cast("bigint")
    last = F.ceil(lam + 12 * F.sqrt(lam) + 20).cast("bigint")
    unset = F.array(*[F.lit(-1).cast("bigint") for _ in qs])
    init = F.struct(F.lit(0.0).alias("lp"), F.lit(0.0).alias("cdf"), unset.alias("ans"))
    levels = F.array(*[F.lit(q) for q in qs])

    def step(acc, k):
        lp = F.when(k == first, log_pmf(first, lam)).otherwise(acc["lp"] + F.log(lam) - F.log(k.cast("double")))
        cdf = acc["cdf"] + F.exp(lp)
        ans = F.when((cdf >= qs[0]) & (F.element_at(acc["ans"], -1) < 0),
                     F.zip_with(acc["ans"], levels, lambda a, q: F.when((a < 0) & (cdf >= q), k).otherwise(a))
                     ).otherwise(acc["ans"])
        return F.struct(lp.alias("lp"), cdf.alias("cdf"), ans.alias("ans"))

    found = F.aggregate(F.sequence(first, last), init, step, lambda acc: acc["ans"])
    return F.when(lam <= 0, F.array(*[F.lit(0).cast("bigint") for _ in qs])).otherwise(found)


def quantile(lam: Column, q: float) -> Column:
    """P3 for one level."""
    return quantiles(lam, (q,))[0].cast("int")


def mode(lam: Column, k_max: Column | int | None = None) -> tuple[Column, Column]:
    """First most likely k and its probability (%, unrounded), over all k or over 0..k_max.

    The pmf rises while k < λ and falls after, with an exact tie between λ−1
    and λ for integer λ, so the first maximum is ``ceil(λ) − 1``, 0 at least.
    The reference searches 0..19 (``k_max=19``) or 0..int(upper)+2.
    """
    m = F.greatest(F.lit(0), (F.ceil(lam) - 1).cast("int"))
    if k_max is not None:
        m = F.least(_col(k_max).cast("int"), m)
    return m, pmf_at(m, lam) * 100


def select_interval(lam: Column, total_std: Column, threshold: float = 5.0, z: float = Z95) -> dict[str, Column]:
    """Poisson bounds below ``threshold``, else elementwise max of normal and Poisson bounds.

    Bounds are truncated to int, as the reference does with ``int()``.
    """
    both = quantiles(lam, (0.025, 0.975))
    lo_p, hi_p = both[0], both[1]
    lo_n = F.greatest(lam - z * total_std, F.lit(0.0))
    hi_n = F.greatest(lam + z * total_std, lam)
    small = lam < threshold
    return {
        "predicted_lower": F.when(small, lo_p.cast("double")).otherwise(F.greatest(lo_n, lo_p.cast("double"))).cast("int"),
        "predicted_upper": F.when(small, hi_p.cast("double")).otherwise(F.greatest(hi_n, hi_p.cast("double"))).cast("int"),
        "ci_method": F.when(small, F.lit("Poisson")).otherwise(F.lit("Hybrid-Uncertainty")),
    }


def count_band(lam: Column, z: float = Z95) -> dict[str, Column]:
    """λ ± z·√λ with the lower bound clipped at 0 (dashboard forecast band)."""
    se = z * F.sqrt(lam)
    return {"band_lower": F.greatest(lam - se, F.lit(0.0)), "band_upper": lam + se}
