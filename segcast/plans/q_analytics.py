"""Check queries for the dashboard analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from segcast.functions import labels as lb
from segcast.functions.numeric import round_half_even
from segcast.operators import analytics as an
from segcast.operators import evaluate as ev
from segcast.operators import forecast as fc
from segcast.plans.common import register, tidy
from segcast.plans.oracle import r, with_
from segcast.plans.q_eval import PRED_COLS
from segcast.plans.q_features import stored_panel
from segcast.plans.q_forecast import N_LONG, N_RISK, interval_sql, mean_sql, risk_sql, standin_future, standin_risk_forecast
from segcast.sources import fixtures as fx
from segcast.sources.io import event_profile as event_profile_of

EV = """
ev AS (
  SELECT r_name AS route, n_name AS segment_id, year(o_orderdate)::int AS year_of_crash,
         CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date_of_crash,
         CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS hit_and_run,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              WHEN o_orderpriority = '1-URGENT' THEN 'Daylight'
              WHEN o_orderpriority = '2-HIGH' THEN 'Dark-Lighted'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'Dark-Unknown'
              WHEN o_orderpriority = '5-LOW' THEN 'Dusk' ELSE 'Other' END AS light_condition
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
evd AS (SELECT *, try_strptime(date_of_crash, '%m/%d/%Y')::date AS crash_date FROM ev)"""

REG = """
reg AS (SELECT 'seg_' || lpad(n_nationkey::varchar, 2, '0') AS segment_id,
               ['I0040', 'I0055', 'I0240', 'I55', 'I240'][n_regionkey + 1] || '_Seg' || lpad(n_nationkey::varchar, 2, '0')
                 AS route_segment FROM nation)"""

MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
FILTER_YEAR = 1996


def _events(spark, sf_dir):
    return fx.event_records(spark, sf_dir)


@register("filter_events", with_(EV) + f"""
SELECT route, segment_id, year_of_crash, crash_date, hit_and_run FROM evd
WHERE year_of_crash = {FILTER_YEAR} AND hit_and_run = 'Yes' AND crash_date IS NOT NULL""")
def filter_events(spark, sf_dir):
    """Year filter + hit-and-run predicate + lenient date parse (unparseable dropped)."""
    ev_ = an.with_crash_date(an.filter_events(_events(spark, sf_dir), year=FILTER_YEAR, route="All Routes",
                                              hit_and_run=True))
    return ev_.select("route", "segment_id", "year_of_crash", "crash_date", "hit_and_run")


@register("selector_values", with_(EV) + """
SELECT DISTINCT * FROM (
  SELECT 'year' AS kind, year_of_crash::varchar AS value FROM ev
  UNION ALL SELECT 'route', route FROM ev
  UNION ALL SELECT 'segment', segment_id FROM ev) WHERE value IS NOT NULL""")
def selector_values(spark, sf_dir):
    """F12."""
    return an.selector_values(_events(spark, sf_dir))


@register("monthly_counts", with_(EV, """
mc AS (SELECT month(crash_date)::int AS month, count(*)::bigint AS crashes FROM evd WHERE crash_date IS NOT NULL GROUP BY 1)""") + f"""
SELECT m.month, coalesce(mc.crashes, 0)::bigint AS crashes, {MONTHS}[m.month] AS month_name
FROM (SELECT range::int AS month FROM range(1, 13)) m LEFT JOIN mc USING (month)""")
def monthly_counts(spark, sf_dir):
    """All years, routes and segments."""
    return an.monthly_counts(_events(spark, sf_dir), spark)


@register("monthly_intensity", with_(EV, """
mc AS (SELECT month(crash_date)::int AS month, count(*)::bigint AS crashes FROM evd WHERE crash_date IS NOT NULL GROUP BY 1),
m12 AS (SELECT m.month, coalesce(mc.crashes, 0)::bigint AS crashes
        FROM (SELECT range::int AS month FROM range(1, 13)) m LEFT JOIN mc USING (month)),
mx AS (SELECT *, max(crashes) OVER () AS mx FROM m12)""") + f"""
SELECT month, crashes, {r('CASE WHEN mx > 0 THEN 20 + crashes / mx * 60 ELSE 20 END', 'dot_size')},
  CASE WHEN crashes > mx * 0.75 THEN 4 WHEN crashes > mx * 0.5 THEN 3 WHEN crashes > mx * 0.25 THEN 2 ELSE 1 END AS intensity_tier
FROM mx""")
def monthly_intensity(spark, sf_dir):
    """R2."""
    m = an.monthly_counts(_events(spark, sf_dir), spark)
    return tidy(an.monthly_intensity(m).select("month", "crashes", "dot_size", "intensity_tier"))


@register("day_night", with_(EV) + """
SELECT segment_id,
  sum((lower(light_condition) LIKE '%day%' OR lower(light_condition) LIKE '%light%'
       OR lower(light_condition) LIKE '%dawn%' OR lower(light_condition) LIKE '%dusk%')::bigint) AS day_crashes,
  sum((lower(light_condition) LIKE '%dark%' OR lower(light_condition) LIKE '%night%')::bigint) AS night_crashes
FROM ev WHERE light_condition IS NOT NULL AND segment_id IS NOT NULL GROUP BY segment_id""")
def day_night(spark, sf_dir):
    """R3 (parity: values with both a day and a night term count in both)."""
    return an.day_night(_events(spark, sf_dir))


@register("top_segments", with_(EV, """
c_all AS (SELECT segment_id, route, count(*)::bigint AS crashes FROM ev GROUP BY 1, 2),
c_hr AS (SELECT segment_id, route, count(*)::bigint AS crashes FROM ev WHERE hit_and_run = 'Yes' GROUP BY 1, 2)""") + """
SELECT 'all' AS board, segment_id, route, crashes, rank FROM (
  SELECT *, row_number() OVER (ORDER BY crashes DESC, segment_id, route)::int AS rank FROM c_all) WHERE rank <= 10
UNION ALL
SELECT 'hit_and_run', segment_id, route, crashes, rank FROM (
  SELECT *, row_number() OVER (ORDER BY crashes DESC, segment_id, route)::int AS rank FROM c_hr) WHERE rank <= 10""")
def top_segments(spark, sf_dir):
    """Top-10 segments by events and by hit-and-run events."""
    return an.top_boards(_events(spark, sf_dir))


# every selection as its own filter, joined to the events: no grouping sets on this side
SEL = """
ys AS (SELECT NULL::int AS y UNION ALL SELECT DISTINCT year_of_crash FROM ev WHERE year_of_crash IS NOT NULL),
rs AS (SELECT NULL::varchar AS r UNION ALL SELECT DISTINCT route FROM ev WHERE route IS NOT NULL),
ss AS (SELECT NULL::varchar AS s UNION ALL SELECT DISTINCT segment_id FROM ev WHERE segment_id IS NOT NULL),
yr AS (SELECT y, r, coalesce(y::varchar, 'All Years') AS year_of_crash, coalesce(r, 'All Routes') AS route_selection FROM ys, rs)"""


@register("monthly_counts_selections", with_(EV, SEL) + f"""
SELECT x.year_of_crash, x.route_selection AS route, coalesce(s, 'All Segments') AS segment_id, m.month, {MONTHS}[m.month] AS month_name,
  count(*) FILTER (WHERE month(crash_date) = m.month)::bigint AS crashes
FROM yr x, ss, (SELECT range::int AS month FROM range(1, 13)) m
  JOIN evd e ON true
WHERE (y IS NULL OR e.year_of_crash = y) AND (r IS NULL OR e.route = r) AND (s IS NULL OR e.segment_id = s)
GROUP BY ALL""")
def monthly_counts_selections(spark, sf_dir):
    """F7 over R1: all (year, route, segment) selections in one scan."""
    return an.monthly_selections(_events(spark, sf_dir))


@register("day_night_selections", with_(EV, SEL) + """
SELECT x.year_of_crash, x.route_selection AS route, e.segment_id,
  sum((lower(light_condition) LIKE '%day%' OR lower(light_condition) LIKE '%light%'
       OR lower(light_condition) LIKE '%dawn%' OR lower(light_condition) LIKE '%dusk%')::bigint)::bigint AS day_crashes,
  sum((lower(light_condition) LIKE '%dark%' OR lower(light_condition) LIKE '%night%')::bigint)::bigint AS night_crashes
FROM yr x JOIN ev e ON (y IS NULL OR e.year_of_crash = y) AND (r IS NULL OR e.route = r)
WHERE light_condition IS NOT NULL AND segment_id IS NOT NULL GROUP BY ALL""")
def day_night_selections(spark, sf_dir):
    """F7 over R3: all (year, route) selections in one scan."""
    return an.day_night_selections(_events(spark, sf_dir))


@register("top_segments_selections", with_(EV, SEL, """
boards AS (SELECT unnest(['all', 'hit_and_run']) AS board),
cnt AS (SELECT x.year_of_crash, x.route_selection, board, segment_id, e.route, count(*)::bigint AS crashes
        FROM yr x CROSS JOIN boards JOIN ev e ON (y IS NULL OR e.year_of_crash = y) AND (r IS NULL OR e.route = r)
        WHERE board = 'all' OR hit_and_run = 'Yes' GROUP BY ALL)""") + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year_of_crash, route_selection, board
                                            ORDER BY crashes DESC, segment_id, route)::int AS rank FROM cnt) WHERE rank <= 10""")
def top_segments_selections(spark, sf_dir):
    """F7 over R4: all (year, route) selections' boards in one scan."""
    return an.board_selections(_events(spark, sf_dir))


@register("event_profile", with_(EV) + """
SELECT count(*)::bigint AS n_rows, 6 AS n_columns, count(DISTINCT route)::bigint AS n_routes, count(DISTINCT segment_id)::bigint AS n_segments,
  count(DISTINCT year_of_crash)::bigint AS n_years, min(year_of_crash) AS first_year, max(year_of_crash) AS last_year,
  string_agg(DISTINCT coalesce(hit_and_run, ''), ',' ORDER BY coalesce(hit_and_run, '')) AS flag_values
FROM ev""")
def event_profile(spark, sf_dir):
    """Profile of the event records."""
    return event_profile_of(_events(spark, sf_dir))


def _risk12(spark, sf_dir, panel=None):
    return standin_risk_forecast(spark, sf_dir, N_RISK, panel)


@register("current_week", with_(risk_sql(N_RISK)) + """
SELECT segment_id, week_start, lam3 AS "lambda", risk_level FROM riskf WHERE step = 0""")
def current_week(spark, sf_dir):
    """first forecast row per segment."""
    return an.first_row(_risk12(spark, sf_dir)).select("segment_id", "week_start", "lambda", "risk_level")


CHOSEN_DAY = "2001-12-20"


@register("chosen_week", with_(risk_sql(N_RISK)) + f"""
SELECT segment_id, week_start, lam3 AS "lambda", risk_level, step + 1 AS week_no FROM riskf
WHERE DATE '{CHOSEN_DAY}' BETWEEN week_start AND week_start + 6""")
def chosen_week(spark, sf_dir):
    """the forecast row of a chosen week."""
    return an.chosen_week(_risk12(spark, sf_dir), CHOSEN_DAY).select("segment_id", "week_start", "lambda", "risk_level", "week_no")


def _interval_fc(spark, sf_dir):
    f = ev.predict_interval(standin_future(spark, sf_dir, N_LONG), PRED_COLS)
    b = f.withColumns(fc.blend_interval(F.col("step"), N_LONG, F.col("pred_mean"), F.col("pred_lower"),
                                        F.col("pred_upper"), F.col("season_mean"), F.col("season_std")))
    return b.withColumns(fc.interval_columns(F.col("final_mean"), F.col("final_lower"), F.col("final_upper"),
                                             F.col("week_start")))


@register("forecast_table", with_(interval_sql(N_LONG), """
it AS (SELECT segment_id, week_start, week_of_year, (round_even(fm, 2) + 0.0) AS pm,
              trunc(fl)::int::varchar || '-' || ceil(fu)::int::varchar AS crash_range, mode_k,
              CASE WHEN fm <= 0 THEN 100.0 ELSE (round_even(exp(-fm + mode_k * ln(fm) - lgamma(mode_k + 1)) * 100, 1) + 0.0) END AS lp
       FROM bi)""") + """
SELECT segment_id, strftime(week_start, '%b %d, %Y') AS week_starting, week_of_year AS week_no, crash_range AS expected_range,
  pm AS mean, mode_k::varchar || ' (' || lp::varchar || '%)' AS most_likely,
  CASE WHEN pm < 0.5 THEN 'Very Low Risk' WHEN pm < 1.0 THEN 'Low Risk' WHEN pm < 1.5 THEN 'Moderate Risk'
       WHEN pm < 2.0 THEN 'High Risk' ELSE 'Very High Risk' END AS risk_level
FROM it""")
def forecast_table(spark, sf_dir):
    """Week-by-week display table of an interval forecast."""
    t = _interval_fc(spark, sf_dir)
    return t.select(
        "segment_id",
        F.date_format("week_start", "MMM dd, yyyy").alias("week_starting"),
        F.col("week_of_year").alias("week_no"),
        F.col("crash_range").alias("expected_range"),
        F.col("predicted_mean").alias("mean"),
        F.concat(F.col("most_likely_crashes").cast("string"), F.lit(" ("),
                 F.col("likelihood_percent").cast("string"), F.lit("%)")).alias("most_likely"),
        lb.risk_level_5(F.col("predicted_mean")).alias("risk_level"))


@register("forecast_interpretation", with_(mean_sql(N_LONG), """
mt AS (SELECT *, (round_even(greatest(mlc * (1 - w) + season_mean * w, 0), 1) + 0.0) AS pc FROM bm)""") + """
SELECT segment_id, strftime(week_start, '%b %d, %Y') AS week_starting, week_of_year AS week_no, pc AS expected_crashes,
  CASE WHEN pc < 0.5 THEN 'Very Low Risk' WHEN pc < 1.0 THEN 'Low Risk' WHEN pc < 1.5 THEN 'Moderate Risk'
       WHEN pc < 2.0 THEN 'High Risk' ELSE 'Very High Risk' END AS risk_level,
  CASE WHEN pc < 0.5 THEN trunc(pc * 100)::int::varchar || '% chance of a crash'
       WHEN pc < 1.5 THEN 'Likely ' || trunc(pc)::int::varchar || ' crash(es)'
       ELSE 'Likely ' || trunc(pc)::int::varchar || '-' || (trunc(pc)::int + 1)::varchar || ' crashes' END AS interpretation
FROM mt""")
def forecast_interpretation(spark, sf_dir):
    """Mean-forecast table with risk level and plain-language interpretation."""
    f = standin_future(spark, sf_dir, N_LONG)
    b = f.withColumns(fc.blend_mean(F.col("step"), F.col("ml"), F.col("season_mean"), F.col("season_std")))
    pc = round_half_even("final_pred", 1) + 0.0
    b = b.withColumn("pc", pc)
    return b.select("segment_id", F.date_format("week_start", "MMM dd, yyyy").alias("week_starting"),
                    F.col("week_of_year").alias("week_no"), F.col("pc").alias("expected_crashes"),
                    lb.risk_level_5(F.col("pc")).alias("risk_level"), lb.interpretation(F.col("pc")).alias("interpretation"))


KPI_SQL = """
kp AS (SELECT segment_id, count(*)::bigint AS n_weeks, sum(lam3) AS total_expected,
              sum(lam3) FILTER (WHERE step < 12) AS total_first_weeks, avg(lam3) AS weekly_average,
              max(lam3) AS peak_value FROM riskf GROUP BY 1),
pk2 AS (SELECT segment_id, min(week_start) AS peak_week FROM riskf JOIN kp USING (segment_id)
        WHERE lam3 = peak_value GROUP BY 1)"""


@register("forecast_kpis", with_(risk_sql(N_RISK), KPI_SQL) + f"""
SELECT segment_id, n_weeks, {r('total_expected', 'total_expected')}, {r('total_first_weeks', 'total_first_weeks')},
  {r('weekly_average', 'weekly_average')}, {r('peak_value', 'peak_value')}, peak_week
FROM kp JOIN pk2 USING (segment_id)""")
def forecast_kpis(spark, sf_dir):
    """Totals, weekly mean, peak value and first peak week."""
    return tidy(an.forecast_kpis(_risk12(spark, sf_dir)))


@register("kpi_delta", with_(risk_sql(N_RISK), KPI_SQL) + f"""
SELECT segment_id, {r('h.history_mean', 'history_mean')},
  {r('CASE WHEN h.history_mean <> 0 THEN (total_expected / n_weeks - h.history_mean) / h.history_mean * 100 END', 'delta_pct')}
FROM kp JOIN (SELECT segment_id, avg(total_crashes::double) AS history_mean FROM panel GROUP BY 1) h USING (segment_id)""")
def kpi_delta(spark, sf_dir):
    """R10."""
    panel = stored_panel(spark, sf_dir)
    k = an.forecast_kpis(_risk12(spark, sf_dir, panel))
    return tidy(an.kpi_delta(k, panel).select("segment_id", "history_mean", "delta_pct"))


@register("route_groups", with_(REG) + """
SELECT 'All' AS route_group, segment_id FROM reg
UNION ALL
SELECT regexp_replace(split_part(route_segment, '_', 1), '^I0*(\\d+)$', 'I-\\1') AS route_group, segment_id FROM reg""")
def route_groups(spark, sf_dir):
    """R11: "All" plus one group per normalised route (I0055 and I55 merge)."""
    return an.route_groups(fx.registry(spark, sf_dir))


@register("segment_names", with_(REG) + """
SELECT s.segment_id, CASE WHEN reg.route_segment IS NULL THEN s.segment_id ELSE
  regexp_replace(split_part(reg.route_segment, '_', 1), '^I0*(\\d+)$', 'I-\\1') || ' ' || split_part(reg.route_segment, '_', 2) END
  AS display_name
FROM (SELECT DISTINCT segment_id FROM hourly) s LEFT JOIN reg USING (segment_id)""")
def segment_names(spark, sf_dir):
    """R12."""
    return an.segment_names(fx.hourly(spark, sf_dir), fx.registry(spark, sf_dir))


@register("week_labels", with_(risk_sql(N_RISK)) + """
SELECT segment_id, week_start, strftime(week_start, '%b %d') || ' – ' || strftime(week_start + 6, '%b %d, %Y') AS week_label
FROM riskf""")
def week_labels(spark, sf_dir):
    """R13."""
    f = _risk12(spark, sf_dir)
    return f.select("segment_id", "week_start", lb.week_label(F.col("week_start")).alias("week_label"))


@register("timeline_union", with_(risk_sql(N_RISK)) + f"""
SELECT t.*, c.cutover_week FROM (
  SELECT segment_id, week_start, total_crashes::double AS value, NULL::double AS lower, NULL::double AS upper,
         'history' AS series FROM panel
  UNION ALL
  SELECT segment_id, week_start, lam3, predicted_lower::double, predicted_upper::double, 'forecast' FROM riskf) t
JOIN (SELECT segment_id, max(week_start) AS cutover_week FROM panel GROUP BY 1) c USING (segment_id)""")
def timeline_union(spark, sf_dir):
    """History and forecast on one axis with the cut-over week."""
    panel = stored_panel(spark, sf_dir)
    out = an.timeline(panel, _risk12(spark, sf_dir, panel))
    return out.select("segment_id", "week_start", "value", "lower", "upper", "series", "cutover_week")


@register("report_tables", with_(risk_sql(N_RISK)) + """
SELECT segment_id, strftime(week_start, '%b %d') || ' – ' || strftime(week_start + 6, '%b %d, %Y') AS week_label,
  lam3 AS "lambda", predicted_lower::varchar || '–' || predicted_upper::varchar AS expected_range,
  most_likely_crashes, probability_pct,
  CASE WHEN lam3 < 0.5 THEN 'Very Low Risk' WHEN lam3 < 1.0 THEN 'Low Risk' WHEN lam3 < 1.5 THEN 'Moderate Risk'
       WHEN lam3 < 2.0 THEN 'High Risk' ELSE 'Very High Risk' END AS risk_level
FROM riskf""")
def report_tables(spark, sf_dir):
    """Weekly detail table of the report (week label, λ, range, most likely, 5-tier risk)."""
    f = _risk12(spark, sf_dir)
    return f.select("segment_id", lb.week_label(F.col("week_start")).alias("week_label"), "lambda",
                    F.concat_ws("–", F.col("predicted_lower").cast("string"), F.col("predicted_upper").cast("string"))
                     .alias("expected_range"),
                    "most_likely_crashes", "probability_pct", lb.risk_level_5(F.col("lambda")).alias("risk_level"))


@register("day_night_exclusive", with_(EV) + """
SELECT segment_id,
  sum(((lower(light_condition) LIKE '%day%' OR lower(light_condition) LIKE '%light%'
        OR lower(light_condition) LIKE '%dawn%' OR lower(light_condition) LIKE '%dusk%')
       AND NOT (lower(light_condition) LIKE '%dark%' OR lower(light_condition) LIKE '%night%'))::bigint) AS day_crashes,
  sum((lower(light_condition) LIKE '%dark%' OR lower(light_condition) LIKE '%night%')::bigint) AS night_crashes
FROM ev WHERE light_condition IS NOT NULL AND segment_id IS NOT NULL GROUP BY segment_id""")
def day_night_exclusive(spark, sf_dir):
    """R3 with ``exclusive=True`` (Q17 option): a value with both a day and a night term counts as night only."""
    return an.day_night(_events(spark, sf_dir), exclusive=True)


@register("report_summary", with_(risk_sql(N_RISK), KPI_SQL, REG) + f"""
SELECT k.segment_id,
  CASE WHEN reg.route_segment IS NULL THEN k.segment_id ELSE
    regexp_replace(split_part(reg.route_segment, '_', 1), '^I0*(\\d+)$', 'I-\\1') || ' ' || split_part(reg.route_segment, '_', 2)
  END AS display_name,
  k.n_weeks, {r('k.total_expected', 'total_expected')}, {r('k.weekly_average', 'weekly_average')},
  {r('k.peak_value', 'peak_value')},
  strftime(p.peak_week, '%b %d') || ' – ' || strftime(p.peak_week + 6, '%b %d, %Y') AS peak_week_label,
  CASE WHEN c.lam3 < 0.5 THEN 'Very Low Risk' WHEN c.lam3 < 1.0 THEN 'Low Risk' WHEN c.lam3 < 1.5 THEN 'Moderate Risk'
       WHEN c.lam3 < 2.0 THEN 'High Risk' ELSE 'Very High Risk' END AS current_risk_level
FROM kp k JOIN pk2 p USING (segment_id) JOIN (SELECT segment_id, lam3 FROM riskf WHERE step = 0) c USING (segment_id)
LEFT JOIN reg USING (segment_id)""")
def report_summary(spark, sf_dir):
    """R16 summary table: display name, totals, peak week label and the current week's 5-tier risk."""
    f = _risk12(spark, sf_dir)
    k = an.forecast_kpis(f)
    cur = an.first_row(f).select("segment_id", lb.risk_level_5(F.col("lambda")).alias("current_risk_level"))
    names = an.segment_names(k, fx.registry(spark, sf_dir))
    out = k.join(cur, "segment_id").join(names, "segment_id")
    return tidy(out.select("segment_id", "display_name", "n_weeks", "total_expected", "weekly_average", "peak_value",
                           lb.week_label(F.col("peak_week")).alias("peak_week_label"), "current_risk_level"))
