"""Check queries for the kept weekly results: built from the earlier rows, updated by the rest, equal to the whole recomputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from segcast.operators import features as fe
from segcast.operators import incremental as inc
from segcast.operators import seasonal as se
from segcast.plans.common import ORACLE, register, tidy
from segcast.plans.q_features import _PANEL_DBL, _PANEL_INT, WEEKLY_COLS
from segcast.plans.oracle import r, with_
from segcast.session import store
from segcast.sources import fixtures as fx


# Sums added in another order differ in the last bits, and means of prices often end in a 5 at the seventh decimal:
# both sides are brought to 9 decimals first, so that the last bits do not decide how such a tie is rounded to 6.
def _settled(cols):
    return ",\n  ".join(r(f"round_even({c}::double, 9)", c) for c in cols)


def _settle(df):
    return tidy(tidy(df, 9))


def arrivals(spark, sf_dir):
    """(earlier rows, new rows): new are the last year, late night rows of some segments, and two segments as a whole; others have none."""
    h = fx.hourly(spark, sf_dir)
    digit = F.substring("segment_id", -1, 1).cast("int")
    new = (((digit % 3 == 0) & (F.year("timestamp") >= 1998)) | ((digit == 4) & (F.col("hour") < 5) & (F.year("timestamp") > 1994))
           | (digit == 7))
    return h.where(~new), h.where(new)


def _states(spark, sf_dir):
    """Kept state and the new rows' state, both stored."""
    return [store(inc.weekly_state(fe.add_hourly_features(part)), "weekly-state") for part in arrivals(spark, sf_dir)]


def _updated_panel(spark, sf_dir):
    old, new = _states(spark, sf_dir)
    panel = store(fe.add_lag_features(fe.add_week_calendar(fe.densify_weeks(inc.weekly_from_state(old)))), "old-panel")
    changed = store(inc.changed_segments(old, new), "changed")
    return panel, changed, inc.update_panel(panel, inc.merge_states(old, new), changed)


@register("weekly_rollup_incremental", with_() + f"""
SELECT segment_id, week_start, {', '.join(fe.SUM_MEASURES)},
  {_settled(fe.STAT_MEASURES)}
FROM weekly""")
def weekly_rollup_incremental(spark, sf_dir):
    """A2: states of earlier and new rows merged."""
    return _settle(inc.weekly_from_state(inc.merge_states(*_states(spark, sf_dir))).select(*WEEKLY_COLS))


@register("feature_panel_incremental", with_() + f"""
SELECT segment_id, week_start, {', '.join(_PANEL_INT)},
  {_settled(_PANEL_DBL)}
FROM panel""")
def feature_panel_incremental(spark, sf_dir):
    """Only the changed weeks of the touched segments made anew."""
    return _settle(_updated_panel(spark, sf_dir)[2].select("segment_id", "week_start", *_PANEL_INT, *_PANEL_DBL))


@register("overall_stats_incremental", ORACLE["overall_stats"])
def overall_stats_incremental(spark, sf_dir):
    """B2: kept for untouched segments."""
    old, changed, panel = _updated_panel(spark, sf_dir)
    return tidy(inc.refresh(se.overall_stats(old), panel, changed, se.overall_stats))


@register("seasonal_profile_incremental", ORACLE["seasonal_profile"])
def seasonal_profile_incremental(spark, sf_dir):
    """Kept for untouched segments."""
    old, changed, panel = _updated_panel(spark, sf_dir)
    prof = inc.refresh(se.seasonal_profile(old), panel, changed, se.seasonal_profile)
    return tidy(prof.join(se.seasonal_range(prof).drop("peak_week"), "segment_id"))


@register("hourly_profile_incremental", ORACLE["hourly_profile"])
def hourly_profile_incremental(spark, sf_dir):
    """Profile states merged."""
    old, new = arrivals(spark, sf_dir)
    return inc.profile_from_state(inc.merge_profiles(inc.profile_state(old), inc.profile_state(new)))
