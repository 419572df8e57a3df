
from segcast.operators import analytics as an


def _ev(spark):
    rows = [("R1", "S1", 2024, "01/05/2024", "Yes", "Daylight"),
            ("R1", "S1", 2024, "bad", "No", "Dark-Lighted"),
            ("R1", "S2", 2023, "03/10/2023", "No", "Dark-Unknown"),
            ("R2", "S3", 2024, "03/11/2024", "Yes", None),
            ("R2", "S2", 2024, "03/12/2024", "No", "Other")]
    return spark.createDataFrame(rows, "route string, segment_id string, year_of_crash int, date_of_crash string, "
                                       "hit_and_run string, light_condition string")


def test_monthly_zero_fill_and_parse(spark):
    m = an.monthly_counts(_ev(spark), spark).orderBy("month").collect()
    assert len(m) == 12 and m[0]["crashes"] == 1 and m[2]["crashes"] == 3 and m[1]["crashes"] == 0
    assert m[0]["month_name"] == "Jan"
    y = an.monthly_counts(_ev(spark), spark, year="2024", route="R1").where("crashes > 0").collect()
    assert [(r["month"], r["crashes"]) for r in y] == [(1, 1)]


def test_day_night_parity_and_exclusive(spark):
    d = {r["segment_id"]: (r["day_crashes"], r["night_crashes"]) for r in an.day_night(_ev(spark)).collect()}
    assert d == {"S1": (2, 1), "S2": (0, 1)}   # Dark-Lighted counts in both; Other in neither; NULL dropped
    x = {r["segment_id"]: (r["day_crashes"], r["night_crashes"]) for r in an.day_night(_ev(spark), exclusive=True).collect()}
    assert x["S1"] == (1, 1)


def test_top_segments_ties(spark):
    t = an.top_segments(_ev(spark), n=2).collect()
    assert [(r["segment_id"], r["route"], r["crashes"], r["rank"]) for r in t] == [("S1", "R1", 2, 1), ("S2", "R1", 1, 2)]
    h = an.top_segments(_ev(spark), hit_and_run=True).collect()
    assert [r["segment_id"] for r in h] == ["S1", "S3"]


def test_forecast_kpis_first_peak(spark):
    import datetime as dt
    rows = [("a", dt.date(2025, 1, 6) + dt.timedelta(weeks=i), v) for i, v in enumerate([1.0, 3.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "segment_id string, week_start date, lambda double")
    k = an.forecast_kpis(df, head=2).first()
    assert k["peak_week"] == dt.date(2025, 1, 13) and k["peak_value"] == 3.0      # first of the tied maxima
    assert k["total_expected"] == 9.0 and k["total_first_weeks"] == 4.0 and k["n_weeks"] == 4


def test_selections_equal_filtered_queries(spark):
    """Every selection of the one-scan queries is the filtered query's result; rows without a value count under "All" only."""
    rows = [(2023 + i % 3 if i % 11 else None, ["I1", "I2", None][i % 3], f"s{i % 4}" if i % 7 else None,
             f"{1 + i % 12}/5/2023" if i % 5 else "unknown", "Yes" if i % 2 else None, ["Daylight", "Dark-Lighted", None, "Other"][i % 4])
            for i in range(200)]
    df = spark.createDataFrame(rows, "year_of_crash int, route string, segment_id string, date_of_crash string, "
                                     "hit_and_run string, light_condition string").cache()
    month = {}
    for r in an.monthly_selections(df).collect():
        month.setdefault((r["year_of_crash"], r["route"], r["segment_id"]), {})[r["month"]] = r["crashes"]
    for key in [("All Years", "All Routes", "All Segments"), ("2024", "All Routes", "s2"), ("2024", "I2", "All Segments"), ("2025", "All Routes", "s1"), ("All Years", "I1", "s0")]:
        want = {r["month"]: r["crashes"] for r in an.monthly_counts(df, spark, *key).collect()}
        assert month[key] == want
    assert not any(None in key for key in month)
    dn = {(r["year_of_crash"], r["route"], r["segment_id"]): (r["day_crashes"], r["night_crashes"]) for r in an.day_night_selections(df).collect()}
    boards = an.board_selections(df, 3).collect()
    for year, route in [("All Years", "All Routes"), ("2024", "All Routes"), ("All Years", "I2"), ("2023", "I1")]:
        assert {k[2]: v for k, v in dn.items() if k[:2] == (year, route)} == {
            r["segment_id"]: (r["day_crashes"], r["night_crashes"]) for r in an.day_night(df, year, route).collect()}
        got = {(r["board"], r["rank"], r["segment_id"], r["route"], r["crashes"]) for r in boards
               if (r["year_of_crash"], r["route_selection"]) == (year, route)}
        assert got == {(r["board"], r["rank"], r["segment_id"], r["route"], r["crashes"]) for r in an.top_boards(df, 3, year, route).collect()}
    assert an.monthly_selections(df.limit(0)).count() == 0
