"""Kept weekly states against whole recomputation: late rows, gaps, new and untouched segments, NULLs, tiny and huge values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from segcast.operators import features as fe
from segcast.operators import incremental as inc
from segcast.session import store

SCHEMA = ("segment_id string, timestamp timestamp_ntz, crash_count int, speed double, historical_average_speed double, "
          "reference_speed double, npmrds double, hour int, is_weekend int")


def _rows(spark, rows):
    return fe.add_hourly_features(spark.createDataFrame(rows, SCHEMA))


def _row(seg, day, rng, speed=None):
    hour = rng.randrange(24)
    return (seg, dt.datetime(2023, 1, 3, hour) + dt.timedelta(days=day), rng.choice([0, 1, 2, None]),
            speed if speed is not None else rng.choice([None, rng.uniform(1e6, 1e6 + 1)]), 25.0, rng.choice([0.0, 40.0]), rng.random(), hour, 0)


def _close(a, b):
    if a is None or b is None or not isinstance(a, float):
        return a == b
    return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))


def _check(whole, updated, keys):
    rows = [{tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (whole, updated.select(*whole.columns))]
    assert rows[0].keys() == rows[1].keys() and rows[0]
    for k, r in rows[0].items():
        for c, v in r.items():
            assert _close(v, rows[1][k][c]), (k, c, v, rows[1][k][c])


@pytest.mark.parametrize("leaky", [True, False])
def test_update_equals_the_whole(spark, leaky):
    rng = random.Random(5)
    weeks = {"grow": range(0, 30), "late": range(0, 40, 2), "gap": range(0, 15), "still": range(0, 20), None: range(0, 18), "front": range(20, 30)}
    old = [_row(s, 7 * w + d, rng) for s, ws in weeks.items() for w in ws for d in range(3)]
    fresh = {"grow": range(29, 33), "late": [5, 6, 11], "gap": [60, 61], "born": [3, 9], None: [17, 30], "front": [2, 21]}
    new = [_row(s, 7 * w + d, rng) for s, ws in fresh.items() for w in ws for d in range(2)]

    def panel_of(state):
        return fe.add_lag_features(fe.add_week_calendar(fe.densify_weeks(inc.weekly_from_state(state))), leaky=leaky)

    a, b = store(inc.weekly_state(_rows(spark, old)), "a"), store(inc.weekly_state(_rows(spark, new)), "b")
    whole = _rows(spark, old + new)
    merged = inc.merge_states(a, b)
    _check(fe.weekly_rollup(whole), inc.weekly_from_state(merged), inc.KEYS)
    changed = inc.changed_segments(a, b)
    first = {r[0]: r[1] for r in changed.collect()}
    assert "still" not in first and first["gap"] == dt.date(2023, 1, 9) + dt.timedelta(days=7 * 15)  # the gap's first week
    updated = inc.update_panel(store(panel_of(a), "p"), merged, changed, leaky)
    want = fe.add_lag_features(fe.add_week_calendar(fe.densify_weeks(fe.weekly_rollup(whole))), leaky=leaky)
    _check(want, updated, inc.KEYS)


def test_empty_parts(spark):
    rng = random.Random(1)
    rows = _rows(spark, [_row("s", d, rng, 5.0) for d in range(9)])
    state, none = inc.weekly_state(rows), inc.weekly_state(rows.limit(0))
    _check(fe.weekly_rollup(rows), inc.weekly_from_state(inc.merge_states(state, none)), inc.KEYS)
    _check(fe.weekly_rollup(rows), inc.weekly_from_state(inc.merge_states(none, state)), inc.KEYS)
    assert inc.changed_segments(state, none).count() == 0
    profile = inc.profile_from_state(inc.merge_profiles(inc.profile_state(rows), inc.profile_state(rows))).first()
    assert profile["n_rows"] == 18 and profile["n_hours"] == rows.select("hour").distinct().count()
