"""DuckDB SQL building blocks for the oracle twins of the registered queries.

These strings re-state each operator in plain ANSI SQL over the driver's
tables, independently of the Spark code (spine + left join for the calendar,
window functions for lags, recursive CTE for the recursive forecast), so a
match between the two is evidence for both.  Doubles are rounded half-even to
6 decimals on both sides.
"""

from __future__ import annotations

from segcast.operators import features as fe

DEC = 6


def r(expr: str, alias: str, nd: int = DEC) -> str:
    """Rounded double column (half-even, -0.0 normalised)."""
    return f"(round_even(({expr})::double, {nd}) + 0.0) AS {alias}"


def rcols(cols: list[str], prefix: str = "") -> str:
    return ",\n  ".join(r(f"{prefix}{c}", c) for c in cols)


# --- fixtures (FIXTURES §2) -------------------------------------------------------------
HOURLY = """
hourly AS (
  SELECT {segment_expr} AS segment_id,
         l_shipdate + to_hours(((l_orderkey*7 + l_linenumber) % 24)::int) AS timestamp,
         (l_returnflag = 'R')::int AS crash_count,
         l_quantity AS speed,
         25.5::double AS historical_average_speed,
         (CASE WHEN l_linenumber = 1 THEN 0 ELSE 40 END)::double AS reference_speed,
         l_extendedprice / 1000 AS npmrds,
         ((l_orderkey*7 + l_linenumber) % 24)::int AS hour,
         (isodow(l_shipdate) IN (6, 7))::int AS is_weekend
  FROM {source}),
hf AS (
  SELECT *, abs(speed - historical_average_speed) AS speed_deviation,
         speed / (CASE WHEN reference_speed = 0 THEN 1 ELSE reference_speed END) AS speed_ratio,
         coalesce((speed < reference_speed * 0.7)::int, 0) AS congestion_indicator,
         (hour IN (7, 8, 9, 16, 17, 18))::int AS is_rush_hour,
         (hour IN (22, 23, 0, 1, 2, 3, 4, 5))::int AS is_night,
         (hour IN (15, 16, 17, 18))::int AS is_peak_crash_hour
  FROM hourly),
weekly AS (
  SELECT segment_id, (date_trunc('week', timestamp::date - 1)::date + 7) AS week_start,
         sum(crash_count)::bigint AS total_crashes,
         avg(speed) AS avg_speed, stddev_samp(speed) AS std_speed, min(speed) AS min_speed, max(speed) AS max_speed,
         avg(npmrds) AS avg_npmrds, stddev_samp(npmrds) AS std_npmrds,
         avg(speed_deviation) AS avg_speed_deviation, max(speed_deviation) AS max_speed_deviation,
         avg(speed_ratio) AS avg_speed_ratio, min(speed_ratio) AS min_speed_ratio,
         sum(congestion_indicator)::bigint AS total_congestion_hours,
         sum(is_weekend)::bigint AS total_weekend_hours,
         sum(is_rush_hour)::bigint AS total_rush_hours,
         sum(is_night)::bigint AS total_night_hours,
         sum(is_peak_crash_hour)::bigint AS total_peak_crash_hours
  FROM hf GROUP BY 1, 2),
bounds AS (SELECT segment_id, min(week_start) AS lo, max(week_start) AS hi FROM weekly GROUP BY 1),
spine AS (SELECT segment_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY))::date AS week_start FROM bounds),
dense AS (
  SELECT s.segment_id, s.week_start,
         coalesce(w.total_crashes, 0)::bigint AS total_crashes,
         w.avg_speed, w.std_speed, w.min_speed, w.max_speed, w.avg_npmrds, w.std_npmrds,
         w.avg_speed_deviation, w.max_speed_deviation, w.avg_speed_ratio, w.min_speed_ratio,
         coalesce(w.total_congestion_hours, 0)::bigint AS total_congestion_hours,
         coalesce(w.total_weekend_hours, 0)::bigint AS total_weekend_hours,
         coalesce(w.total_rush_hours, 0)::bigint AS total_rush_hours,
         coalesce(w.total_night_hours, 0)::bigint AS total_night_hours,
         coalesce(w.total_peak_crash_hours, 0)::bigint AS total_peak_crash_hours
  FROM spine s LEFT JOIN weekly w USING (segment_id, week_start)),
cal0 AS (
  SELECT *, std_speed / (CASE WHEN avg_speed = 0 THEN 1 ELSE avg_speed END) AS speed_variability,
         max_speed - min_speed AS speed_range,
         total_congestion_hours / 168 AS pct_congested,
         total_rush_hours / 168 AS pct_rush_hour,
         year(week_start)::int AS year, month(week_start)::int AS month,
         quarter(week_start)::int AS quarter, weekofyear(week_start)::int AS week_of_year
  FROM dense),
cal AS (
  SELECT *, sin(2 * pi() * week_of_year / 52) AS week_sin, cos(2 * pi() * week_of_year / 52) AS week_cos,
         sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos
  FROM cal0),
lagged AS (
  SELECT *,
""" + ",\n".join(
    f"    lag(total_crashes, {k}) OVER w AS crashes_lag_{k}w" for k in fe.LAGS) + ",\n" + ",\n".join(
    f"    avg(total_crashes) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS crashes_rolling_mean_{n}w,\n"
    f"    stddev_samp(total_crashes) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS crashes_rolling_std_{n}w,\n"
    f"    max(total_crashes) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)::double AS crashes_rolling_max_{n}w"
    for n in fe.ROLL_WINDOWS) + """,
    total_crashes - lag(total_crashes, 1) OVER w AS crash_change_1w,
    total_crashes - lag(total_crashes, 4) OVER w AS crash_change_4w
  FROM cal WINDOW w AS (PARTITION BY segment_id ORDER BY week_start)),
panel AS (
  SELECT segment_id, week_start, total_crashes, year, month, quarter, week_of_year,
""" + ",\n".join(
    f"    coalesce({c}, 0) AS {c}" for c in fe.PANEL_COLUMNS
    if c not in ("week_start", "total_crashes", "year", "month", "quarter", "week_of_year")) + """
  FROM lagged)"""


SEGMENT_KEYS = {
    "nation": ("'seg_' || lpad(s_nationkey::varchar, 2, '0')", "lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "supplier": ("'sup_' || lpad(l_suppkey::varchar, 6, '0')", "lineitem"),
}


def with_(*extra: str, segment: str = "nation") -> str:
    """``WITH <fixture CTEs>, <extra CTEs>`` prefix; ``segment`` picks the hourly fixture's key."""
    expr, source = SEGMENT_KEYS[segment]
    base = HOURLY.replace("{segment_expr}", expr).replace("{source}", source)
    parts = [base.strip()] + [e.strip() for e in extra if e.strip()]
    return "WITH " + ",\n".join(parts) + "\n"
