"""One-pass horizon and flat trees against MLlib and the stepwise engine; noise; isolation of failures; stable metrics."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from segcast.functions import noise
from segcast.functions.numeric import at_least, is_finite
from segcast.operators import evaluate as ev
from segcast.operators import forecast as fc
from segcast.operators import horizon as hz
from segcast.operators import models as md
from segcast.plans import panel as pn
from segcast.plans.q_features import hourly_panel
from segcast.session import ensure_checkpoint_dir, store
from segcast.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
SMALL = {"rf_trees": 7, "rf_depth": 6, "gbt_iter": 6}


@pytest.fixture(scope="module")
def fitted(spark):
    """Panel, training frame, ensemble and the state for 30 weeks."""
    panel = store(hourly_panel(spark, SF), "panel")
    status, frame = pn.training_frame(panel)
    frame = store(frame, "frame")
    ens = md.fit_ensemble(frame.where("is_train"), md.feature_columns(frame), **SMALL)
    scored = ens.score(frame)
    res = ev.residual_stats(scored.where("is_train"), "total_crashes", md.MODEL_COLS).select("segment_id", "residual_std")
    means = frame.groupBy("segment_id").agg(F.max(md.SEGMENT_MEAN).alias(md.SEGMENT_MEAN))
    ok = status.where("status = 'SUCCESS'").select("segment_id")
    state = fc.initial_state(panel.join(ok, "segment_id", "left_semi"), 30).join(res, "segment_id").join(means, "segment_id")
    return panel, frame, ens, store(ens.with_ridge(state).drop("outputs"), "state")


def test_flat_trees_predict_as_mllib_does(spark, fitted):
    _, frame, ens, _ = fitted
    rf, gb = ens.flat(spark)
    pdf = ens.score(frame).select(*ens.feature_cols, "pred_rf", "pred_gb").toPandas()
    x = pdf[ens.feature_cols].to_numpy(float)
    assert np.abs(rf.predict(x) - pdf["pred_rf"]).max() < 1e-9 and np.abs(gb.predict(x) - pdf["pred_gb"]).max() < 1e-9
    assert len(rf.roots) == 7 and len(gb.roots) == 6 and len(rf.feature) <= 7 * 2 ** 7
    assert len(rf.predict(x[:0])) == 0 and np.isfinite(rf.predict(np.full((1, x.shape[1]), np.nan))).all()


@pytest.mark.parametrize("variant,noise_scale", [("mean", 1.0), ("risk", 0.0)])
def test_one_pass_equals_the_stepwise_engine(spark, fitted, variant, noise_scale):
    _, _, ens, state = fitted
    n = 5 if variant == "risk" else 14
    names = hz.OUTPUTS[variant]
    once = hz.horizon_rows(hz.forecast_horizon(state, ens, n, variant, noise_scale), variant)
    steps = pn.stepwise_forecast(state, ens, n, variant, noise_scale)
    key = lambda df: {(r["segment_id"], r["step"]): r for r in df.collect()}
    a, b = key(once), key(steps)
    assert a.keys() == b.keys() and len(a) == n * state.count()
    for k, r in a.items():
        assert (r["week_start"], r["week_of_year"], r["method"]) == (b[k]["week_start"], b[k]["week_of_year"], b[k]["method"])
        for c in names:
            assert abs(r[c] - b[k][c]) <= 1e-9 * max(1.0, abs(r[c])), (k, c)


def test_one_pass_is_one_job_whatever_the_horizon(spark, fitted):
    _, _, ens, state = fitted
    ens.flat(spark)
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for n in (2, 30):
        spark.sparkContext.setJobGroup(f"horizon-{n}", "")
        hz.forecast_horizon(state, ens, n).collect()
        jobs[n] = len(tracker.getJobIdsForGroup(f"horizon-{n}"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs[2] == jobs[30] <= 2


def test_short_histories_use_what_there_is(spark):
    rows = [("a", [1.0, 4.0], 2)]
    df = spark.createDataFrame(rows, "s string, h array<double>, n long")
    f = fc.next_row_features(F.col("h"), F.col("n"), rolling_guard=False, change_policy="recent")
    got = df.select(*[c.alias(k) for k, c in f.items()]).first()
    assert got["crashes_rolling_mean_12w"] == 2.5 and got["crashes_rolling_max_4w"] == 4.0 and got["crash_change_1w"] == 3.0
    assert abs(got["crashes_rolling_std_8w"] - math.sqrt(4.5)) < 1e-12


@pytest.mark.parametrize("bad", [float("inf"), float("nan")])
def test_segment_with_a_forecast_that_is_not_finite_fails_alone(spark, fitted, bad):
    _, _, ens, state = fitted
    name = state.agg(F.min("segment_id")).first()[0]
    broken = state.withColumn("intercept", F.when(F.col("segment_id") == name, F.lit(bad)).otherwise(F.col("intercept")))
    got = {r["segment_id"]: r for r in hz.forecast_horizon(broken, ens, 3).collect()}
    want = {r["segment_id"]: r for r in hz.forecast_horizon(state, ens, 3).collect()}
    assert got[name]["error"] == "forecast of week 1 is not finite" and got[name]["lambda"] is None
    assert {k: r["lambda"] for k, r in got.items() if k != name} == {k: r["lambda"] for k, r in want.items() if k != name}
    assert hz.horizon_rows(hz.forecast_horizon(broken, ens, 3), "risk").where(F.col("segment_id") == name).count() == 0


def test_ridge_that_cannot_be_solved_is_an_error_of_its_segment(spark):
    rows = [("a", float(i), float(i % 3)) for i in range(6)] + [("b", float("inf") if i == 2 else float(i), 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "segment_id string, x double, total_crashes double")
    got = {r["segment_id"]: r for r in md.solve_ridge_per_segment(df, ["x"]).collect()}
    assert got["a"]["error"] is None and got["b"]["error"] and got["b"]["coef"] is None
    assert [r["segment_id"] for r in md.fit_ridge_per_segment(df, ["x"]).collect()] == ["a"]


def test_failed_segment_leaves_the_others_unchanged(spark):
    hourly = fx.hourly(spark, SF)
    names = [r[0] for r in hourly.select("segment_id").distinct().orderBy("segment_id").collect()]
    bad = names[1]
    speed = F.when(F.col("segment_id") == bad, F.lit(float("inf"))).otherwise(F.col("speed"))
    params = {"rf_trees": 3, "rf_depth": 4, "gbt_iter": 3}
    broken = pn.run_panel(hourly.withColumn("speed", speed), n_weeks=3, model_params=params)
    without = pn.run_panel(hourly.where(F.col("segment_id") != bad), n_weeks=3, model_params=params)
    status = {r["segment_id"]: r for r in broken.status.collect()}
    assert status[bad]["status"] == "FAILED" and "not finite" in status[bad]["error"]
    assert sorted(broken.forecast.collect()) == sorted(without.forecast.collect())
    assert sorted(broken.metrics.collect()) == sorted(without.metrics.collect())
    assert bad not in {r["segment_id"] for r in broken.summary.collect()}


def test_errors_of_stages_join_the_status(spark):
    status = spark.createDataFrame([("a", "SUCCESS", None), ("b", "FAILED", "no test weeks"), ("c", "SUCCESS", None)],
                                   "segment_id string, status string, error string")
    errors = spark.createDataFrame([("b", "later"), ("c", "x"), ("c", "y")], "segment_id string, error string")
    got = {r[0]: (r[1], r[2]) for r in pn.with_errors(status, errors).collect()}
    assert got == {"a": ("SUCCESS", None), "b": ("FAILED", "no test weeks"), "c": ("FAILED", "x")}


def test_noise_does_not_depend_on_partitions_and_is_normal(spark):
    df = spark.range(40_000).select(F.concat(F.lit("s"), (F.col("id") % 400).cast("string")).alias("s"), (F.col("id") / 400).cast("int").alias("t"))
    z = df.withColumn("z", noise.normal(7, F.col("s"), F.col("t")))
    rows = {(r["s"], r["t"]): r["z"] for r in z.repartition(1).collect()}
    assert rows == {(r["s"], r["t"]): r["z"] for r in z.repartition(9, "t").collect()}
    for (s, t), v in list(rows.items())[:200]:
        assert abs(v - noise.normal_value(7, s, t)) < 1e-12
    v = np.array(list(rows.values()))
    assert len(set(rows.values())) == len(rows)
    assert abs(v.mean()) < 0.03 and abs(v.std() - 1) < 0.03 and abs((v ** 3).mean()) < 0.08 and abs((v ** 4).mean() - 3) < 0.2
    by_step = np.array([[rows[f"s{i}", t] for t in range(100)] for i in range(400)])
    assert abs(np.corrcoef(by_step[:, 1:].ravel(), by_step[:, :-1].ravel())[0, 1]) < 0.03


def test_r2_does_not_cancel_for_large_values(spark):
    rows = [("a", 1e9 + i, 1e9 + i + 0.1) for i in range(10)] + [("b", 5e8, 5e8) for _ in range(4)] + [("c", 5e8, 5e8 + 1) for _ in range(4)]
    df = spark.createDataFrame(rows, "g string, y double, p double").repartition(5)
    got = {r["g"]: r["r2"] for r in ev.regression_metrics(df, "y", "p", ["g"]).collect()}
    assert abs(got["a"] - (1 - 10 * 0.01 / 82.5)) < 1e-6 and got["b"] == 1.0 and got["c"] == 0.0


def test_clamps_keep_missing_values_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (-1.0, None), (-1.0, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(at_least(F.col("a"), 0.0)).collect()]
    assert got == [None, 0.0, 0.0]
    b = fc.blend_risk(F.lit(2), 12, F.col("a"), F.lit(0.1), F.lit(1.0), F.lit(1.0), F.col("b"))
    assert df.select(b["lambda"].alias("l")).first()["l"] is None
    wide = ev.predict_interval(df.withColumn("residual_std", F.lit(1.0)), ["a", "b"]).collect()
    assert wide[0]["pred_mean"] is None and wide[1]["pred_lower"] is None and wide[2]["pred_mean"] == 0.0
    values = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r[0] for r in values.select(is_finite(F.col("v"))).collect()] == [True, False, False, False, False]


def test_blends_equal_their_columns(spark):
    """Every variant's blend at every step of 36, on random members, against the column operators."""
    rng = np.random.default_rng(5)
    n, rows = 36, []
    for i in range(n):
        rows += [(i, k, *map(float, rng.normal(1, 2, 2)), *map(float, rng.uniform(0, 3, 4)), float(rng.choice([0.0, 1.5]))) for k in range(6)]
    names = ["mean", "season_mean", "std", "season_std", "overall_std", "residual_std", "overall_mean"]
    df = spark.createDataFrame(rows, "step int, k int, " + ", ".join(f"{c} double" for c in names))
    c = {x: F.col(x) for x in [*names, "step"]}
    one = df.withColumn("only", c["mean"])
    wide = F.sqrt(c["residual_std"] ** 2 + c["std"] ** 2)
    lower, upper = (at_least(c["mean"] + z * wide, 0.0) for z in (-fc.Z95, fc.Z95))
    want = {
        "risk": fc.blend_risk(c["step"], n, c["mean"], c["std"], c["season_mean"], c["overall_std"], c["residual_std"]),
        "interval": fc.blend_interval(c["step"], n, at_least(c["mean"], 0.0), lower, upper, c["season_mean"], c["season_std"]),
        "mean": fc.blend_mean(c["step"], c["mean"], c["season_mean"], c["season_std"]),
        "factor": {"final_pred": fc.seasonal_factor(c["step"], c["mean"], c["season_mean"], c["overall_mean"])},
    }
    cols = [want[v][o].alias(f"{v}_{o}") for v in want for o in hz.OUTPUTS[v] if o in want[v]]
    pdf = one.select("step", *names, *cols).toPandas()
    for i, g in pdf.groupby("step"):
        state = type("S", (), {"scalar": {x: g[x].to_numpy() for x in ("overall_std", "residual_std", "overall_mean")}})
        m = {x: g[x].to_numpy() for x in ("mean", "std", "season_mean", "season_std")} | {"noise": np.zeros(len(g))}
        for v in want:
            made = hz._BLENDS[v](int(i), n, state, m)
            for o in hz.OUTPUTS[v]:
                if o in want[v]:
                    assert np.abs(made[o] - g[f"{v}_{o}"].to_numpy()).max() < 1e-9, (v, o, i)


def test_a_lost_run_goes_on_without_refitting(spark, monkeypatch):
    """The run ends in the forecast; started again it reads what was finished and equals a run that never stopped."""
    folder = ensure_checkpoint_dir(spark).rstrip("/") + f"/run-{uuid.uuid4().hex}"
    hourly = fx.hourly(spark, SF)
    kw = {"n_weeks": 3, "model_params": SMALL}

    def lost(*a, **k):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(hz, "forecast_horizon", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            pn.run_panel(hourly, run_dir=folder, **kw)
    with monkeypatch.context() as m:
        m.setattr(md, "fit_ensemble", lost)
        again = pn.run_panel(hourly, run_dir=folder, **kw)
        third = pn.run_panel(hourly.limit(0), run_dir=folder, **kw)  # every stage is there: the input is not read
    fresh = pn.run_panel(hourly, **kw)
    rows = [{(r["segment_id"], r["step"]): r["lambda"] for r in x.forecast.collect()} for x in (again, third, fresh)]
    assert rows[0] and rows[0] == rows[1] == rows[2]
    assert again.status.where("status = 'SUCCESS'").count() == fresh.status.where("status = 'SUCCESS'").count()
    with pytest.raises(ValueError, match="other parameters"):
        pn.run_panel(hourly, run_dir=folder, **{**kw, "n_weeks": 4})
