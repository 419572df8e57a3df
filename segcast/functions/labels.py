"""Label, formatting and bucketing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two risk scales, the month abbreviations and the bucket labels.
RISK4 = [(4.0, "High"), (2.5, "Medium"), (1.0, "Low")]
RISK4_ELSE = "Very Low"
RISK5 = [(0.5, "Very Low Risk"), (1.0, "Low Risk"), (1.5, "Moderate Risk"), (2.0, "High Risk")]
RISK5_ELSE = "Very High Risk"
RISK_BINS = [0.5, 1.0, 1.5, 2.0]
RISK_BIN_TOP = 10.0
RISK_BIN_LABELS = ["Very Low", "Low", "Moderate", "High", "Very High"]
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
BUCKET_LABELS = ["0", "1", "2", "3", "4+"]
BUCKET_COLS = ["prob_0_crash", "prob_1_crash", "prob_2_crash", "prob_3_crash", "prob_ge4_crash"]


def risk_level_4(lam: Column) -> Column:
    """Batch scale, lower bounds inclusive (≥4 High, ≥2.5 Medium, ≥1 Low)."""
    out = F.lit(RISK4_ELSE)
    for bound, label in reversed(RISK4):
        out = F.when(lam >= bound, label).otherwise(out)
    return out


def risk_level_5(value: Column) -> Column:
    """Dashboard scale, upper bounds exclusive (<0.5, <1, <1.5, <2, else)."""
    out = F.lit(RISK5_ELSE)
    for bound, label in reversed(RISK5):
        out = F.when(value < bound, label).otherwise(out)
    return out


def risk_bin(value: Column, parity: bool = False) -> Column:
    """Right-closed bins up to 0.5, 1, 1.5, 2 and above 2; every value has a bin.

    With ``parity`` the outer bins end as the reference's do: 0 and below, and
    everything above 10, fall outside (NULL).
    """
    out = F.lit(RISK_BIN_LABELS[-1])
    for hi, label in reversed(list(zip(RISK_BINS, RISK_BIN_LABELS))):
        out = F.when(value <= hi, label).otherwise(out)
    out = F.when(value.isNotNull(), out)
    return F.when((value > 0) & (value <= RISK_BIN_TOP), out) if parity else out


def crash_range(lower: Column, upper: Column) -> Column:
    """``"int(lower)-ceil(upper)"``."""
    return F.format_string("%d-%d", lower.cast("int"), F.ceil(upper).cast("int"))


def interpretation(value: Column) -> Column:
    """Plain-language reading of an expected count."""
    iv = value.cast("int")
    return (F.when(value < 0.5, F.format_string("%d%% chance of a crash", (value * 100).cast("int")))
             .when(value < 1.5, F.format_string("Likely %d crash(es)", iv))
             .otherwise(F.format_string("Likely %d-%d crashes", iv, iv + 1)))


def bucket_mode(probs: list[Column] | None = None) -> tuple[Column, Column]:
    """P10: first maximum of the five bucket probabilities → (label, probability)."""
    probs = probs or [F.col(c) for c in BUCKET_COLS]
    arr = F.array(*probs)
    pos = F.array_position(arr, F.array_max(arr))
    return F.element_at(F.array(*[F.lit(b) for b in BUCKET_LABELS]), pos.cast("int")), F.array_max(arr)


def normalize_route(route: Column) -> Column:
    """Q28: ``I0040`` → ``I-40``, ``I55`` → ``I-55``; other codes pass through."""
    return F.regexp_replace(route, r"^I0*(\d+)$", "I-$1")


def segment_display_name(route_segment: Column, fallback: Column) -> Column:
    """``I0040_Seg26`` → ``I-40 Seg26``; an id without registry entry passes through."""
    route = F.split(route_segment, "_").getItem(0)
    seg = F.split(route_segment, "_").getItem(1)
    return F.when(route_segment.isNull(), fallback).otherwise(F.concat_ws(" ", normalize_route(route), seg))


def week_label(week: Column) -> Column:
    """``"Jan 13 – Jan 19, 2025"`` (label … label + 6 days)."""
    return F.concat(F.date_format(week, "MMM dd"), F.lit(" – "), F.date_format(F.date_add(week, 6), "MMM dd, yyyy"))


def month_name(week: Column) -> Column:
    """Full month name of a date."""
    return F.date_format(week, "MMMM")


def month_abbr(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBR]), month.cast("int"))
