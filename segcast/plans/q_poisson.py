"""Check queries for the count-distribution and risk-label operators.

λ comes from the data: the seasonal mean of each (segment, ISO week) of the
weekly panel (floored at 0.01), σ is its sample std.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segcast.functions.numeric import round_half_even

from segcast.functions import labels as lb
from segcast.functions import poisson as po
from segcast.operators import seasonal as se
from segcast.plans.common import register, tidy
from segcast.plans.oracle import r, with_
from segcast.plans.q_features import hourly_panel


def lambda_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = se.seasonal_profile(hourly_panel(spark, sf_dir))
    return prof.select("segment_id", "week_of_year",
                       F.col("seasonal_mean").alias("raw_lambda"),
                       F.greatest(F.col("seasonal_mean"), F.lit(0.01)).alias("lambda"),
                       F.coalesce(F.col("seasonal_std"), F.lit(0.0)).alias("sigma"))


LAM = """
lam AS (SELECT segment_id, week_of_year, avg(total_crashes::double) AS raw_lambda,
               greatest(avg(total_crashes::double), 0.01) AS lam_v,
               coalesce(stddev_samp(total_crashes::double), 0) AS sigma
        FROM panel GROUP BY 1, 2)"""


def ppf_sql(src: str, keys: str = "segment_id, week_of_year") -> str:
    """Poisson ppf(0.025) / ppf(0.975) of ``src.lam_v`` via a k-grid and a running cdf."""
    return f"""
pk AS (SELECT {keys}, lam_v, unnest(range(0, ceil(lam_v + 12 * sqrt(lam_v) + 20)::bigint + 1)) AS k FROM {src}),
pc AS (SELECT {keys}, k, sum(exp(-lam_v + k * ln(lam_v) - lgamma(k + 1))) OVER (PARTITION BY {keys} ORDER BY k) AS c FROM pk),
pq AS (SELECT {keys}, min(k) FILTER (WHERE c >= 0.025)::int AS lower_p, min(k) FILTER (WHERE c >= 0.975)::int AS upper_p
       FROM pc GROUP BY {keys})"""


def probs_sql(lam: str = "lam_v") -> str:
    facts = [1, 1, 2, 6]
    cols = [f"(round_even(exp(-{lam}) * pow({lam}, {k}) / {facts[k]} * 100, 1) + 0.0) AS prob_{k}_crash" for k in range(4)]
    tail = " + ".join(f"exp(-{lam}) * pow({lam}, {k}) / {facts[k]}" for k in range(4))
    cols.append(f"(round_even((1 - ({tail})) * 100, 1) + 0.0) AS prob_ge4_crash")
    return ",\n  ".join(cols)


def mode_sql(lam: str, kmax: str | None = None) -> str:
    """First k of greatest probability, searched over the grid of all k worth a look (or 0..kmax).

    Equal maxima of the pmf (λ a whole number) may differ in the last bits, so logs are compared to 11 decimals.
    """
    top = kmax or f"ceil({lam} + 12 * sqrt({lam}) + 20)::bigint"
    p = f"list_transform(range(0, ({top}) + 1), lambda k: round(k * ln(greatest({lam}, 1e-300)) - {lam} - lgamma(k + 1), 11))"
    return f"(list_position({p}, list_max({p})) - 1)::int"


def pmf_pct_sql(m: str, lam: str) -> str:
    return f"(round_even(exp(-{lam} + {m} * ln({lam}) - lgamma({m} + 1)) * 100, 1) + 0.0)"


def risk4_sql(lam: str) -> str:
    return (f"CASE WHEN {lam} >= 4.0 THEN 'High' WHEN {lam} >= 2.5 THEN 'Medium' "
            f"WHEN {lam} >= 1.0 THEN 'Low' ELSE 'Very Low' END")


def risk5_sql(v: str) -> str:
    return (f"CASE WHEN {v} < 0.5 THEN 'Very Low Risk' WHEN {v} < 1.0 THEN 'Low Risk' "
            f"WHEN {v} < 1.5 THEN 'Moderate Risk' WHEN {v} < 2.0 THEN 'High Risk' ELSE 'Very High Risk' END")


@register("poisson_probabilities", with_(LAM) + f"""
SELECT segment_id, week_of_year, {r('lam_v', '"lambda"')}, {probs_sql()} FROM lam""")
def poisson_probabilities(spark, sf_dir):
    """P1, P2."""
    lp = lambda_panel(spark, sf_dir)
    return tidy(lp.select("segment_id", "week_of_year", "lambda", *[c.alias(n) for n, c in po.prob_columns(F.col("lambda")).items()]))


@register("poisson_interval", with_(LAM, ppf_sql("lam")) + """
SELECT segment_id, week_of_year, lower_p, upper_p FROM pq""")
def poisson_interval(spark, sf_dir):
    """Poisson 2.5 % / 97.5 % quantiles."""
    lp = lambda_panel(spark, sf_dir)
    lam = F.col("lambda")
    both = po.quantiles(lam, (0.025, 0.975))
    return lp.select("segment_id", "week_of_year", both[0].cast("int").alias("lower_p"), both[1].cast("int").alias("upper_p"))


@register("poisson_mode", with_(LAM, f"m AS (SELECT *, {mode_sql('lam_v')} AS most_likely_crashes FROM lam)") + f"""
SELECT segment_id, week_of_year, most_likely_crashes, {pmf_pct_sql('most_likely_crashes', 'lam_v')} AS probability_pct FROM m""")
def poisson_mode(spark, sf_dir):
    """First most likely count and its probability (%)."""
    lp = lambda_panel(spark, sf_dir)
    m, p = po.mode(F.col("lambda"))
    return lp.select("segment_id", "week_of_year", m.alias("most_likely_crashes"),
                     (round_half_even(p, 1) + 0.0).alias("probability_pct"))


@register("poisson_mode_bounded", with_(LAM, f"""
m AS (SELECT *, trunc(greatest(lam_v + 1.96 * sigma, lam_v))::int + 2 AS k_max FROM lam),
m2 AS (SELECT *, {mode_sql('lam_v', 'k_max')} AS most_likely_crashes FROM m)""") + f"""
SELECT segment_id, week_of_year, k_max, most_likely_crashes,
       {pmf_pct_sql('most_likely_crashes', 'lam_v')} AS likelihood_percent FROM m2""")
def poisson_mode_bounded(spark, sf_dir):
    """P5: mode over 0..int(upper)+2 and ``likelihood_percent``."""
    lp = lambda_panel(spark, sf_dir)
    lam = F.col("lambda")
    kmax = F.greatest(lam + 1.96 * F.col("sigma"), lam).cast("int") + 2
    m, p = po.mode(lam, kmax)
    return lp.select("segment_id", "week_of_year", kmax.alias("k_max"), m.alias("most_likely_crashes"),
                     (round_half_even(p, 1) + 0.0).alias("likelihood_percent"))


@register("select_interval", with_(LAM, ppf_sql("lam")) + """
SELECT segment_id, week_of_year,
  trunc(CASE WHEN lam_v < 5 THEN lower_p ELSE greatest(greatest(lam_v - 1.96 * sigma, 0), lower_p) END)::int AS predicted_lower,
  trunc(CASE WHEN lam_v < 5 THEN upper_p ELSE greatest(greatest(lam_v + 1.96 * sigma, lam_v), upper_p) END)::int AS predicted_upper,
  CASE WHEN lam_v < 5 THEN 'Poisson' ELSE 'Hybrid-Uncertainty' END AS ci_method
FROM lam JOIN pq USING (segment_id, week_of_year)""")
def select_interval(spark, sf_dir):
    """Poisson bounds for λ < 5, else the wider of normal and Poisson bounds."""
    lp = lambda_panel(spark, sf_dir)
    iv = po.select_interval(F.col("lambda"), F.col("sigma"))
    return lp.select("segment_id", "week_of_year", *[c.alias(n) for n, c in iv.items()])


@register("risk_level_4", with_(LAM) + f"""
SELECT segment_id, week_of_year, {risk4_sql('lam_v')} AS risk_level FROM lam""")
def risk_level_4(spark, sf_dir):
    """P7."""
    lp = lambda_panel(spark, sf_dir)
    return lp.select("segment_id", "week_of_year", lb.risk_level_4(F.col("lambda")).alias("risk_level"))


@register("crash_range", with_(LAM) + """
SELECT segment_id, week_of_year,
  trunc(greatest(lam_v - 1.96 * sigma, 0))::int::varchar || '-' || ceil(greatest(lam_v + 1.96 * sigma, lam_v))::int::varchar AS crash_range
FROM lam""")
def crash_range(spark, sf_dir):
    """P8."""
    lp = lambda_panel(spark, sf_dir)
    lam, s = F.col("lambda"), F.col("sigma")
    lo = F.greatest(lam - 1.96 * s, F.lit(0.0))
    hi = F.greatest(lam + 1.96 * s, lam)
    return lp.select("segment_id", "week_of_year", lb.crash_range(lo, hi).alias("crash_range"))


@register("count_band", with_(LAM) + f"""
SELECT segment_id, week_of_year, {r('greatest(lam_v - 1.96 * sqrt(lam_v), 0)', 'band_lower')},
       {r('lam_v + 1.96 * sqrt(lam_v)', 'band_upper')} FROM lam""")
def count_band(spark, sf_dir):
    """P9."""
    lp = lambda_panel(spark, sf_dir)
    return tidy(lp.select("segment_id", "week_of_year", *[c.alias(n) for n, c in po.count_band(F.col("lambda")).items()]))


#: One pass: the five probabilities as a list, and the place of its first maximum.
BUCKETS = with_(LAM, f"""
pr AS (SELECT segment_id, week_of_year, {probs_sql()} FROM lam),
lg AS (SELECT segment_id, week_of_year, [prob_0_crash, prob_1_crash, prob_2_crash, prob_3_crash, prob_ge4_crash] AS l FROM pr)""")


@register("bucket_mode", BUCKETS + """
SELECT segment_id, week_of_year, ['0', '1', '2', '3', '4+'][list_position(l, list_max(l))] AS most_likely_bucket,
       list_max(l) AS most_likely_prob
FROM lg""")
def bucket_mode(spark, sf_dir):
    """P10: dashboard "most likely" = first max of the buckets 0, 1, 2, 3, 4+."""
    lp = lambda_panel(spark, sf_dir).withColumns(po.prob_columns(F.col("lambda")))
    label, prob = lb.bucket_mode()
    return lp.select("segment_id", "week_of_year", label.alias("most_likely_bucket"), prob.alias("most_likely_prob"))


@register("probability_long", BUCKETS + """
SELECT segment_id, week_of_year, unnest(['0', '1', '2', '3', '4+']) AS bucket, unnest(l) AS probability,
       unnest([list_position(l, list_max(l)) = i for i in [1, 2, 3, 4, 5]]) AS is_most_likely
FROM lg""")
def probability_long(spark, sf_dir):
    """Bucket probabilities in long form with the ``is_most_likely`` flag."""
    lp = lambda_panel(spark, sf_dir).withColumns(po.prob_columns(F.col("lambda")))
    arr = F.array(*[F.col(c) for c in lb.BUCKET_COLS])
    mode_pos = F.array_position(arr, F.array_max(arr))
    long = lp.select("segment_id", "week_of_year", mode_pos.alias("_mp"),
                     F.posexplode(F.arrays_zip(F.array(*[F.lit(b) for b in lb.BUCKET_LABELS]).alias("bucket"),
                                               arr.alias("probability"))))
    return long.select("segment_id", "week_of_year", F.col("col.bucket").alias("bucket"),
                       F.col("col.probability").alias("probability"),
                       ((F.col("pos") + 1) == F.col("_mp")).alias("is_most_likely"))


@register("risk_level_5", with_(LAM) + f"""
SELECT segment_id, week_of_year, {risk5_sql('raw_lambda')} AS risk_level FROM lam""")
def risk_level_5(spark, sf_dir):
    """5-tier dashboard scale on the expected count."""
    lp = lambda_panel(spark, sf_dir)
    return lp.select("segment_id", "week_of_year", lb.risk_level_5(F.col("raw_lambda")).alias("risk_level"))


@register("risk_distribution", with_(LAM) + """
SELECT CASE WHEN raw_lambda <= 0.5 THEN 'Very Low' WHEN raw_lambda <= 1.0 THEN 'Low' WHEN raw_lambda <= 1.5 THEN 'Moderate'
            WHEN raw_lambda <= 2.0 THEN 'High' ELSE 'Very High' END AS risk_bin, count(*)::bigint AS n
FROM lam WHERE raw_lambda IS NOT NULL GROUP BY 1""")
def risk_distribution(spark, sf_dir):
    """Counts per right-closed risk bin; every row with a value is counted."""
    lp = lambda_panel(spark, sf_dir).select(lb.risk_bin(F.col("raw_lambda")).alias("risk_bin"))
    return lp.where(F.col("risk_bin").isNotNull()).groupBy("risk_bin").agg(F.count(F.lit(1)).alias("n"))
