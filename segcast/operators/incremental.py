"""Weekly results kept up to date from new rows alone.

The weekly roll-up is kept as a mergeable state per (segment, week): counts, sums, ranges, and count, sum and
squared deviation of each measure.  New rows (later weeks, late rows, new segments) become a state of their own, which
is merged into the kept one; the raw rows behind the kept state are not read again.  The feature panel is recomputed only for the
segments the new rows touch, from their first changed week on; profiles are recomputed for those segments only.
All tables here are of weekly size.  Rows with a NULL segment form a segment of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segcast.operators import features as fe

MEASURES = ["speed", "npmrds", "speed_deviation", "speed_ratio"]
# weekly sum -> its hourly column
SUMS = {"total_crashes": "crash_count", "total_congestion_hours": "congestion_indicator", "total_weekend_hours": "is_weekend",
        "total_rush_hours": "is_rush_hour", "total_night_hours": "is_night", "total_peak_crash_hours": "is_peak_crash_hour"}
KEYS = ["segment_id", "week_start"]


def moments(v: Column) -> Column:
    """Aggregate: count, sum, squared deviations from the mean, lowest and highest value of ``v``."""
    n = F.count(v)
    return F.struct(n.alias("n"), F.sum(v).alias("sum"), (F.var_pop(v) * n).alias("m2"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def merge_moments(a: Column, b: Column) -> Column:
    """Moments of both parts together, without the cancellation of plain sums of squares; a missing or empty part counts for nothing."""
    na, nb = a["n"], b["n"]
    n, apart = na + nb, mean(b) - mean(a)
    both = F.struct(n.alias("n"), (a["sum"] + b["sum"]).alias("sum"),
                    (a["m2"] + b["m2"] + apart * apart * (na / n * nb)).alias("m2"),
                    F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))
    return F.when(F.coalesce(na, F.lit(0)) == 0, F.coalesce(b, a)).when(F.coalesce(nb, F.lit(0)) == 0, a).otherwise(both)


def mean(m: Column) -> Column:
    return F.when(m["n"] > 0, m["sum"] / m["n"])


def sample_std(m: Column) -> Column:
    return F.when(m["n"] > 1, F.sqrt(m["m2"] / (m["n"] - 1)))


def weekly_state(hourly: DataFrame, segment: str = "segment_id", ts: str = "timestamp") -> DataFrame:
    """A2 as a state: one row per (segment, week) of hourly rows that carry the hourly features."""
    return hourly.groupBy(F.col(segment).alias("segment_id"), fe.week_label(F.col(ts)).alias("week_start")).agg(
        *[F.sum(c).cast("bigint").alias(n) for n, c in SUMS.items()],
        *[moments(F.col(m).cast("double")).alias(m) for m in MEASURES])


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of old and new rows together; weeks in one of them only pass through."""
    a, b = old.alias("a"), new.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS])
    pick = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEYS]
    sums = [F.coalesce(F.col(f"a.{c}") + F.col(f"b.{c}"), f"a.{c}", f"b.{c}").alias(c) for c in SUMS]
    return a.join(b, on, "full").select(*pick, *sums, *[merge_moments(F.col(f"a.{m}"), F.col(f"b.{m}")).alias(m) for m in MEASURES])


def weekly_from_state(state: DataFrame) -> DataFrame:
    """The weekly roll-up as ``features.weekly_rollup`` gives it."""
    of = {m: F.col(m) for m in MEASURES}
    stats = {"avg_speed": mean(of["speed"]), "std_speed": sample_std(of["speed"]), "min_speed": of["speed"]["lo"],
             "max_speed": of["speed"]["hi"], "avg_npmrds": mean(of["npmrds"]), "std_npmrds": sample_std(of["npmrds"]),
             "avg_speed_deviation": mean(of["speed_deviation"]), "max_speed_deviation": of["speed_deviation"]["hi"],
             "avg_speed_ratio": mean(of["speed_ratio"]), "min_speed_ratio": of["speed_ratio"]["lo"]}
    return state.select(*KEYS, *SUMS, *[c.alias(n) for n, c in stats.items()])


def changed_segments(old: DataFrame, new: DataFrame) -> DataFrame:
    """(segment_id, changed_from): the segments of the new state and the first week whose panel row may differ.

    That is the first week with new rows, or the week after the kept history if the new rows leave a gap.
    """
    first = new.groupBy("segment_id").agg(F.min("week_start").alias("changed_from"))
    last = old.groupBy(F.col("segment_id").alias("_id")).agg(F.max("week_start").alias("_last"))
    joined = first.join(last, F.col("segment_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("segment_id", F.least("changed_from", F.date_add("_last", 7)).alias("changed_from"))


def update_panel(panel: DataFrame, state: DataFrame, changed: DataFrame, leaky: bool = True) -> DataFrame:
    """A3 + W1–W6 for changed weeks: ``panel`` with the rows from each segment's first changed week on made anew.

    ``state`` is the merged state.  A changed row looks back at most as far as the longest lag or window, so a
    segment's weeks are taken from that far before its first changed week.
    """
    back = 7 * max(*fe.LAGS, *fe.ROLL_WINDOWS)
    ch = changed.select(F.col("segment_id").alias("_id"), "changed_from")
    mine = F.col("segment_id").eqNullSafe(F.col("_id"))
    weekly = weekly_from_state(state).join(ch, mine).drop("_id")
    early = F.when(F.col("week_start") <= F.date_sub("changed_from", back), F.col("week_start"))
    starts = weekly.groupBy(F.col("segment_id").alias("_id")).agg(F.coalesce(F.max(early), F.min("week_start")).alias("_start"))
    part = weekly.join(starts, mine).where(F.col("week_start") >= F.col("_start")).drop("_id", "_start")
    made = fe.add_lag_features(fe.add_week_calendar(fe.densify_weeks(part)), leaky=leaky)
    made = made.where(F.col("week_start") >= F.col("changed_from")).select(*panel.columns)
    kept = panel.join(ch, mine, "left").where(F.col("changed_from").isNull() | (F.col("week_start") < F.col("changed_from")))
    return kept.select(*panel.columns).unionByName(made)


def refresh(table: DataFrame, panel: DataFrame, changed: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """B1, B2 or any per-segment table: made anew from the updated panel for the changed segments, kept for the others."""
    ch = changed.select(F.col("segment_id").alias("_id"))
    mine = F.col("segment_id").eqNullSafe(F.col("_id"))
    made = make(panel.join(ch, mine, "left_semi"))
    return table.join(ch, mine, "left_anti").unionByName(made.select(*table.columns))


def profile_state(df: DataFrame, segment: str = "segment_id", ts: str = "timestamp", count: str = "crash_count") -> DataFrame:
    """S10 as a state: the different hours (0 to 23) are bits of one number."""
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.sum(count).cast("bigint").alias("n_events"), F.bit_or(F.expr("shiftleft(1L, hour)")).alias("hours"))


def merge_profiles(old: DataFrame, new: DataFrame, segment: str = "segment_id") -> DataFrame:
    return old.unionByName(new).groupBy(segment).agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.sum("n_events").alias("n_events"), F.bit_or("hours").alias("hours"))


def profile_from_state(state: DataFrame) -> DataFrame:
    """The profile as ``io.profile`` gives it."""
    return state.withColumn("n_hours", F.coalesce(F.bit_count("hours"), F.lit(0)).cast("long")).drop("hours")
