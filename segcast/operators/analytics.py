"""Descriptive analytics over event records and forecasts.

Each chart of the dashboard is one parameterised ``DataFrame -> DataFrame``
function; "All …" selections are simply absent filters, and filters are plain
predicates that Catalyst pushes into the scan.  Counts are grouped
aggregations (map-side partial counts, so a segment holding a third of all
events costs no more than any other); top-k uses ``orderBy().limit()`` which
Spark plans as a per-partition top-k plus a final merge (TakeOrderedAndProject).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segcast.functions import labels as lb
from segcast.sources.io import parse_timestamp

ALL = {None, "All", "All Years", "All Routes", "All Segments"}
# Substrings that classify a light condition as day or night.
DAY_TERMS = ["day", "light", "dawn", "dusk"]
NIGHT_TERMS = ["dark", "night"]


def light_column(df: DataFrame) -> str | None:
    """Q18: the first column whose name contains "light" (case-insensitive)."""
    return next((c for c in df.columns if "light" in c.lower()), None)


def filter_events(df: DataFrame, year=None, route=None, segment=None, hit_and_run: bool = False) -> DataFrame:
    """F7 + F8: optional year/route/segment filters ("All …" = no filter) and the hit-and-run predicate."""
    if year not in ALL:
        df = df.where(F.col("year_of_crash") == int(year))
    if route not in ALL:
        df = df.where(F.col("route") == route)
    if segment not in ALL:
        df = df.where(F.col("segment_id") == segment)
    if hit_and_run:
        df = df.where(F.col("hit_and_run") == "Yes")
    return df


def with_crash_date(df: DataFrame, src: str = "date_of_crash") -> DataFrame:
    """lenient date parse; rows whose date does not parse are dropped."""
    return df.withColumn("crash_date", F.to_date(parse_timestamp(F.col(src)))).where(F.col("crash_date").isNotNull())


def monthly_counts(df: DataFrame, spark: SparkSession, year=None, route=None, segment=None) -> DataFrame:
    """Events per calendar month, all 12 months present (zero-filled), with month names.

    The 12-row month spine is the only broadcast side (fixed size).
    """
    ev = with_crash_date(filter_events(df, year, route, segment))
    counts = ev.groupBy(F.month("crash_date").alias("month")).agg(F.count(F.lit(1)).alias("crashes"))
    spine = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    out = spine.join(F.broadcast(counts), "month", "left").fillna(0, ["crashes"])
    return out.withColumn("month_name", lb.month_abbr(F.col("month")))


def monthly_intensity(monthly: DataFrame) -> DataFrame:
    """R2: marker size 20 + c/max·60 (20 if max is 0) and intensity tier 4..1 by >75/50/25 % of max.

    ``monthly`` has exactly 12 rows, so the global max window is a 12-row task.
    """
    mx = F.max("crashes").over(Window.partitionBy(F.lit(1)))
    c = F.col("crashes")
    return (monthly.withColumn("_mx", mx)
                   .withColumn("dot_size", F.when(F.col("_mx") > 0, 20 + c / F.col("_mx") * 60).otherwise(F.lit(20.0)))
                   .withColumn("intensity_tier", F.when(c > F.col("_mx") * 0.75, 4).when(c > F.col("_mx") * 0.5, 3)
                               .when(c > F.col("_mx") * 0.25, 2).otherwise(1))
                   .drop("_mx"))


def _contains_any(c: Column, terms: list[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t)
    return out


def day_night(df: DataFrame, year=None, route=None, exclusive: bool = False) -> DataFrame:
    """Day and night event counts per segment from the light-condition text.

    Parity (Q17): a value containing both a day and a night term counts in
    both columns; ``exclusive=True`` counts it as night only.  Rows with a
    NULL light value are ignored (Q19); a segment appears when it has at
    least one non-NULL light value.  Conditional sums replace the pivot, so
    this is a single grouped aggregation.
    """
    light = light_column(df)
    if light is None:
        raise ValueError("no light-condition column")
    ev = filter_events(df, year, route).where(F.col(light).isNotNull() & F.col("segment_id").isNotNull())
    is_day = _contains_any(F.col(light), DAY_TERMS)
    is_night = _contains_any(F.col(light), NIGHT_TERMS)
    if exclusive:
        is_day = is_day & ~is_night
    return ev.groupBy("segment_id").agg(
        F.sum(is_day.cast("long")).alias("day_crashes"),
        F.sum(is_night.cast("long")).alias("night_crashes"),
    )


def top_segments(df: DataFrame, n: int = 10, year=None, route=None, hit_and_run: bool = False) -> DataFrame:
    """R4 + W10: the n segments with most events (ties: segment, then route ascending) with rank 1..n."""
    board = "hit_and_run" if hit_and_run else "all"
    return top_boards(df, n, year, route).where(F.col("board") == board).drop("board")


def top_boards(df: DataFrame, n: int = 10, year=None, route=None) -> DataFrame:
    """The top-n boards of all events and of hit-and-run events, from one grouped pass over the events."""
    ev = filter_events(df, year, route).where(F.col("segment_id").isNotNull() & F.col("route").isNotNull())
    counts = ev.groupBy("segment_id", "route").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("hit_and_run") == "Yes").alias("hit_and_run"))
    long = counts.select("segment_id", "route", F.expr("stack(2, 'all', `all`, 'hit_and_run', hit_and_run) AS (board, crashes)"))
    # the rank filter becomes a group limit, so each task passes on n rows of a board at most
    order = Window.partitionBy("board").orderBy(F.col("crashes").desc(), "segment_id", "route")
    ranked = long.where("crashes > 0").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select("segment_id", "route", "crashes", "rank", "board")


def selector_values(df: DataFrame) -> DataFrame:
    """distinct selector values – years (descending), routes and segments (ascending).

    One grouped pass over the events gives the different (year, route, segment);
    those few rows are unpivoted.  The result is globally sorted by (kind, order)
    with Spark's range-partitioned sort.
    """
    seen = df.select("year_of_crash", "route", "segment_id").distinct()
    kinds = F.array(
        F.struct(F.lit("year").alias("kind"), F.col("year_of_crash").cast("string").alias("value"),
                 (-F.col("year_of_crash")).cast("long").alias("_k")),
        F.struct(F.lit("route").alias("kind"), F.col("route").alias("value"), F.lit(0).cast("long").alias("_k")),
        F.struct(F.lit("segment").alias("kind"), F.col("segment_id").alias("value"), F.lit(0).cast("long").alias("_k")))
    out = seen.select(F.inline(kinds)).where(F.col("value").isNotNull()).distinct()
    return out.orderBy("kind", "_k", "value").drop("_k")


# The selector's entries for "no filter".
ALL_LABELS = {"year_of_crash": "All Years", "route": "All Routes", "segment_id": "All Segments"}


def selections(df: DataFrame, selectors: list[str], counts: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """F7 for every selection of the selectors at once, "All …" included: grouping sets over one scan.

    ``counts`` are summed per selection and per ``by``.  The events are counted by their own values first, so
    only those few rows are multiplied by the 2^k sets.  Equal to a filtered query per selection: an event without
    a value belongs to the "All …" selections only, and a selection without events has no rows.
    """
    by = by or []
    own = df.groupBy(*selectors, *by).agg(*[F.sum(c.cast("long")).alias(n) for n, c in counts.items()])
    sets = [[k for i, k in enumerate(selectors) if mask >> i & 1] + by for mask in range(1 << len(selectors))]
    grouped = own.groupingSets(sets, *selectors, *by).agg(
        *[F.sum(n).alias(n) for n in counts], *[F.grouping(k).alias(f"_all_{k}") for k in selectors])
    for k in selectors:
        grouped = grouped.where((F.col(f"_all_{k}") == 1) | F.col(k).isNotNull())
    label = [F.when(F.col(f"_all_{k}") == 1, ALL_LABELS[k]).otherwise(F.col(k).cast("string")).alias(k) for k in selectors]
    return grouped.select(*label, *by, *counts)


def monthly_selections(df: DataFrame) -> DataFrame:
    """R1 for every (year, route, segment) selection: 12 zero-filled months each, as ``monthly_counts`` gives them."""
    month = F.month(F.to_date(parse_timestamp(F.col("date_of_crash"))))
    ev = df.withColumn("_month", month)
    months = {f"m{m}": F.coalesce(F.col("_month") == m, F.lit(False)) for m in range(1, 13)}
    wide = selections(ev, ["year_of_crash", "route", "segment_id"], months)
    rows = wide.select("year_of_crash", "route", "segment_id",
                       F.posexplode(F.array(*months)).alias("_at", "crashes")).withColumn("month", F.col("_at") + 1).drop("_at")
    return rows.withColumn("month_name", lb.month_abbr(F.col("month")))


def day_night_selections(df: DataFrame) -> DataFrame:
    """R3 for every (year, route) selection: day and night counts per segment, as ``day_night`` gives them."""
    light = light_column(df)
    if light is None:
        raise ValueError("no light-condition column")
    ev = df.where(F.col(light).isNotNull() & F.col("segment_id").isNotNull())
    return selections(ev, ["year_of_crash", "route"], {"day_crashes": _contains_any(F.col(light), DAY_TERMS),
                                                       "night_crashes": _contains_any(F.col(light), NIGHT_TERMS)}, ["segment_id"])


def board_selections(df: DataFrame, n: int = 10) -> DataFrame:
    """R4 for every (year, route) selection: the top-n boards, as ``top_boards`` gives them.

    A board row names its route, so the route selections are the row's own route and "All Routes".
    """
    ev = df.where(F.col("segment_id").isNotNull() & F.col("route").isNotNull())
    counts = selections(ev, ["year_of_crash"], {"all": F.lit(1), "hit_and_run": F.coalesce(F.col("hit_and_run") == "Yes", F.lit(False))},
                        ["segment_id", "route"])
    long = counts.select("year_of_crash", "segment_id", "route",
                         F.expr("stack(2, 'all', `all`, 'hit_and_run', hit_and_run) AS (board, crashes)")).where("crashes > 0")
    long = long.withColumn("route_selection", F.explode(F.array(F.lit(ALL_LABELS["route"]), F.col("route"))))
    order = Window.partitionBy("year_of_crash", "route_selection", "board").orderBy(F.col("crashes").desc(), "segment_id", "route")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_row(fcst: DataFrame, k: int = 1, segment: str = "segment_id", order: str = "week_start") -> DataFrame:
    """the k-th forecast row of each segment (k=1: the "current week")."""
    w = Window.partitionBy(segment).orderBy(order)
    return fcst.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == k).drop("_rn")


def chosen_week(fcst: DataFrame, week, segment: str = "segment_id", order: str = "week_start") -> DataFrame:
    """each segment's forecast row of the week that holds the date ``week``, with its place in the horizon.

    A row's week runs from its label to label + 6 days; no row if the date is outside the horizon.
    """
    w = Window.partitionBy(segment).orderBy(order)
    day = F.lit(week).cast("date")
    numbered = fcst.withColumn("week_no", F.row_number().over(w))
    return numbered.where((F.col(order) <= day) & (day <= F.date_add(F.col(order), 6)))


def forecast_kpis(fcst: DataFrame, value: str = "lambda", head: int = 12, segment: str = "segment_id",
                  week: str = "week_start") -> DataFrame:
    """Total (all weeks and first ``head``), mean, max and the first peak week (Q21)."""
    w = Window.partitionBy(segment).orderBy(week)
    v = F.col(value)
    ranked = fcst.withColumn("_rn", F.row_number().over(w))
    return ranked.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        F.sum(v).alias("total_expected"),
        F.sum(F.when(F.col("_rn") <= head, v)).alias("total_first_weeks"),
        F.avg(v).alias("weekly_average"),
        F.max(v).alias("peak_value"),
        F.max_by(F.col(week), F.struct(v, -F.col("_rn"))).alias("peak_week"),
    )


def kpi_delta(kpis: DataFrame, history: DataFrame, target: str = "total_crashes", segment: str = "segment_id") -> DataFrame:
    """(forecast weekly mean − history mean) / history mean · 100."""
    hist = history.groupBy(segment).agg(F.avg(F.col(target).cast("double")).alias("history_mean"))
    j = kpis.join(hist, segment)
    return j.withColumn("delta_pct", F.when(F.col("history_mean") != 0,
                                            (F.col("total_expected") / F.col("n_weeks") - F.col("history_mean"))
                                            / F.col("history_mean") * 100))


def route_groups(registry: DataFrame) -> DataFrame:
    """(route_group, segment_id) pairs: every segment under "All" and under its normalised route.

    Long form instead of one list per route, so no group is collected into a
    single value however many segments a route has.
    """
    route = lb.normalize_route(F.split(F.col("route_segment"), "_").getItem(0))
    per_route = registry.select(route.alias("route_group"), "segment_id")
    return registry.select(F.lit("All").alias("route_group"), "segment_id").unionByName(per_route)


def segment_names(segments: DataFrame, registry: DataFrame) -> DataFrame:
    """Display name per segment id; ids missing from the registry pass through unchanged."""
    j = segments.select("segment_id").distinct().join(registry, "segment_id", "left")
    return j.select("segment_id", lb.segment_display_name(F.col("route_segment"), F.col("segment_id")).alias("display_name"))


def timeline(history: DataFrame, fcst: DataFrame, value: str = "lambda", segment: str = "segment_id") -> DataFrame:
    """History ∪ forecast on one time axis with the cut-over (last history week) per segment."""
    h = history.select(segment, "week_start", F.col("total_crashes").cast("double").alias("value"),
                       F.lit("history").alias("series"))
    f = fcst.select(segment, "week_start", F.col(value).cast("double").alias("value"),
                    F.col("predicted_lower").cast("double").alias("lower"),
                    F.col("predicted_upper").cast("double").alias("upper"), F.lit("forecast").alias("series"))
    cut = history.groupBy(segment).agg(F.max("week_start").alias("cutover_week"))
    return h.unionByName(f, allowMissingColumns=True).join(cut, segment)
