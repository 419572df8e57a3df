"""Panel model training and scoring (M1–M4, M7) with MLlib.

One random forest and one gradient-boosted tree ensemble are fitted on the
training weeks of *all* segments together, so training scales with rows rather
than looping over segments in the driver.  The segments' levels enter as the
lag and rolling features and as the mean of their own training weeks
(``segment_mean``).  The ridge member is one model per segment, as in the
reference: a closed-form solve inside ``applyInPandas``, whose group is one
segment's weekly history and never grows with the raw data.

The pooled trees are bounded in depth and leaf size whatever the number of
rows, so the fitted model in the driver, and in each scoring task, has a fixed
largest size (trees · 2^(depth+1) nodes).  Training rows are dealt by a hash of
(segment, week) over a fixed number of partitions and sorted, so the forest's
bootstrap, and with it every forecast, is the same for any number of cores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segcast.functions.numeric import at_least
from segcast.operators import features as fe
from segcast.operators import trees as tr
from segcast.session import store

EXCLUDE = ("week_start", "total_crashes", "year")

# The two estimator configurations of the reference (M1, M2): "default" = library defaults
# (100 trees; 100 boosting rounds of depth 3), "tuned" = 200 trees of depth 10 with ≥ 2 rows per leaf,
# boosting depth 5.  The reference's default trees are unlimited, on one segment's weeks; the pooled ones are
# bounded to depth 12 and 4 rows per leaf.  A minimum of 5 rows to split a node has no MLlib equivalent.
PRESETS = {
    "default": {"rf_trees": 100, "rf_depth": 12, "rf_min_instances": 4, "gbt_iter": 100, "gbt_depth": 3},
    "tuned": {"rf_trees": 200, "rf_depth": 10, "rf_min_instances": 2, "gbt_iter": 100, "gbt_depth": 5},
}
#: Partitions of the training rows; part of the model, as the bootstrap follows them.
FIT_PARTITIONS = 8
SEGMENT_MEAN = "segment_mean"
MODEL_COLS = ["pred_rf", "pred_gb", "pred_ridge"]


def feature_columns(panel: DataFrame, exclude=EXCLUDE, segment: str = "segment_id") -> list[str]:
    """Every panel feature except the label, the week label and the calendar year (46 columns), and the segment mean if there."""
    skip = set(exclude) | {segment, "is_train", "row_idx", "n_weeks", "baseline_pred"}
    return [c for c in [*fe.PANEL_COLUMNS, SEGMENT_MEAN] if c in panel.columns and c not in skip]


def with_segment_mean(split: DataFrame, label: str = "total_crashes", segment: str = "segment_id") -> DataFrame:
    """Mean of the segment's training weeks on all its rows; test weeks never enter."""
    mean = F.avg(F.when(F.col("is_train"), F.col(label).cast("double"))).over(Window.partitionBy(segment))
    return split.withColumn(SEGMENT_MEAN, mean)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """``VectorAssembler`` over the feature columns (cast to double)."""
    casted = df.withColumns({c: F.col(c).cast("double") for c in cols})
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(casted)


@dataclass
class Ensemble:
    """Pooled trees and per-segment ridge coefficients (``segment_id, intercept, coef``)."""

    feature_cols: list[str]
    rf: object
    gb: object
    ridge: DataFrame
    label: str = "total_crashes"
    segment: str = "segment_id"
    errors: DataFrame | None = None  # (segment, error) of the segments that could not be fitted
    _flat: tuple | None = None

    @property
    def ridge_cols(self) -> list[str]:
        return [c for c in self.feature_cols if c != SEGMENT_MEAN]

    def flat(self, spark: SparkSession) -> tuple:
        """Forest and boosted trees as flat arrays (see ``trees``), laid down once."""
        if self._flat is None:
            self._flat = tr.flatten(spark, self.rf, True), tr.flatten(spark, self.gb, False)
        return self._flat

    def with_ridge(self, df: DataFrame) -> DataFrame:
        """``df`` with its segments' coefficients, for scoring it more than once."""
        return df.join(self.ridge, self.segment)

    def score(self, df: DataFrame) -> DataFrame:
        """M4: the three model predictions and the clamped ensemble mean, keeping input columns."""
        bare = "coef" not in df.columns
        x = assemble(self.with_ridge(df) if bare else df, self.feature_cols, "_features")
        for name, m in (("pred_rf", self.rf), ("pred_gb", self.gb)):
            x = m.setFeaturesCol("_features").setPredictionCol(name).transform(x)
        x = x.withColumn("pred_ridge", ridge_prediction(self.ridge_cols))
        mean = (F.col("pred_rf") + F.col("pred_gb") + F.col("pred_ridge")) / 3
        x = x.withColumns({"ensemble_raw": mean, "ensemble_pred": at_least(mean, 0.0)})
        return x.drop("_features", *(["intercept", "coef"] if bare else []))

    def feature_importance(self, spark: SparkSession, top_n: int = 15) -> DataFrame:
        """M7: random-forest importances, top ``top_n`` (bounded by the feature count)."""
        imp = self.rf.featureImportances.toArray().tolist()
        rows = [(c, float(v)) for c, v in zip(self.feature_cols, imp)]
        df = spark.createDataFrame(rows, "feature string, importance double")
        return df.orderBy(F.col("importance").desc(), "feature").limit(top_n)


def fit_ensemble(train: DataFrame, feature_cols: list[str] | None = None, label: str = "total_crashes",
                 rf_trees: int = 100, rf_depth: int = 12, rf_min_instances: int = 4, gbt_iter: int = 100,
                 gbt_depth: int = 3, gbt_step: float = 0.1, ridge_alpha: float = 1.0, seed: int = 42,
                 max_bins: int = 32, fit_partitions: int = FIT_PARTITIONS, rf_node_memory_mb: int = 1024,
                 segment: str = "segment_id", week: str = "week_start") -> Ensemble:
    """M1–M3: fit random forest and gradient boosting on the pooled training rows, and a ridge per segment.

    See PRESETS for the reference's configurations.  ``fit_partitions`` is the
    number of training tasks; raise it for a panel of many million weeks.  The
    rows are written once under the checkpoint folder and read by all fits.
    """
    cols = feature_cols or feature_columns(train)
    rows = store(train.select(segment, week, F.col(label).cast("double").alias(label),
                              *[F.col(c).cast("double").alias(c) for c in cols]), "fit-rows")
    solved = store(solve_ridge_per_segment(rows, [c for c in cols if c != SEGMENT_MEAN], label, ridge_alpha, segment), "ridge")
    ridge, errors = solved.where("error is null").drop("error"), solved.where("error is not null").select(segment, "error")
    data = (assemble(rows, cols).withColumnRenamed(label, "_label").select(segment, week, "features", "_label")
            .repartition(fit_partitions, segment, week).sortWithinPartitions(segment, week).select("features", "_label"))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rf = RandomForestRegressor(featuresCol="features", labelCol="_label", numTrees=rf_trees, maxDepth=rf_depth,
                                   minInstancesPerNode=rf_min_instances, featureSubsetStrategy="all", seed=seed,
                                   maxBins=max_bins, bootstrap=True, cacheNodeIds=True,
                                   maxMemoryInMB=rf_node_memory_mb).fit(data)
        gb = GBTRegressor(featuresCol="features", labelCol="_label", maxIter=gbt_iter, maxDepth=gbt_depth,
                          stepSize=gbt_step, seed=seed, maxBins=max_bins).fit(data)
    finally:
        data.unpersist()
    return Ensemble(cols, rf, gb, ridge, label, segment, errors)


# --- per-segment ridge (reference parity: one model per segment) ----------------------------
def fit_ridge_per_segment(train: DataFrame, feature_cols: list[str], label: str = "total_crashes",
                          alpha: float = 1.0, segment: str = "segment_id") -> DataFrame:
    """M3 per segment: closed-form ridge with unpenalised intercept, one row of coefficients per segment.

    Solves (XcᵀXc + αI) w = Xcᵀyc on centred data, b = ȳ − x̄ᵀw – exactly
    sklearn's ``Ridge(alpha)``.  Output: ``segment_id, intercept, coef array``; a segment that
    cannot be solved is left out (``solve_ridge_per_segment`` says why).
    """
    return solve_ridge_per_segment(train, feature_cols, label, alpha, segment).where("error is null").drop("error")


def solve_ridge_per_segment(train: DataFrame, feature_cols: list[str], label: str = "total_crashes",
                            alpha: float = 1.0, segment: str = "segment_id") -> DataFrame:
    """M3 with an error channel: coefficients, or null and the reason, so one bad segment ends no job."""
    cols = list(feature_cols)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[cols].to_numpy(dtype=float)
        y = pdf[label].to_numpy(dtype=float)
        xm, ym = x.mean(axis=0), y.mean()
        xc, yc = x - xm, y - ym
        error, intercept, w = None, None, None
        try:
            w = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(cols)), xc.T @ yc)
            intercept = float(ym - xm @ w)
            if not np.isfinite([intercept, *w]).all():
                error = "ridge coefficients are not finite"
        except np.linalg.LinAlgError as e:
            error = f"ridge: {e}"
        return pd.DataFrame({segment: [pdf[segment].iloc[0]], "intercept": [None if error else intercept],
                             "coef": [None if error else w.tolist()], "error": [error]})

    schema = T.StructType([T.StructField(segment, T.StringType()), T.StructField("intercept", T.DoubleType()),
                           T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    sel = train.select(segment, F.col(label).cast("double").alias(label), *[F.col(c).cast("double") for c in cols])
    return sel.groupBy(segment).applyInPandas(solve, schema)


def ridge_prediction(feature_cols: list[str]) -> Column:
    """Native dot product of the row's features with the segment's ``coef`` and ``intercept``."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_cols])
    return F.aggregate(F.zip_with("coef", x, lambda w, v: w * v), F.col("intercept"), lambda acc, v: acc + v)


def score_ridge_per_segment(df: DataFrame, coefs: DataFrame, feature_cols: list[str], out: str = "pred_ridge",
                            segment: str = "segment_id") -> DataFrame:
    """Apply per-segment ridge coefficients with a native dot product (no Python on the scoring path)."""
    return df.join(coefs, segment).withColumn(out, ridge_prediction(feature_cols)).drop("intercept", "coef")


def ridge_residuals(train: DataFrame, coefs: DataFrame, feature_cols: list[str], label: str = "total_crashes",
                    alpha: float = 1.0, segment: str = "segment_id") -> DataFrame:
    """How far each segment's coefficients are from solving the ridge's normal equations, relative to their terms.

    Per segment: the largest of |Σ e| / Σ|e| and |Σ x_j·e − α·w_j| / (Σ|x_j·e| + α·|w_j|), e the residual.
    """
    e = F.col("_e")
    x = F.array(*[F.col(c).cast("double") for c in feature_cols])
    scored = train.join(coefs, segment).select(
        segment, (F.col(label).cast("double") - ridge_prediction(feature_cols)).alias("_e"), "coef", x.alias("x"))
    # the constant term goes first, its coefficient is not penalised
    terms = F.posexplode(F.concat(F.array(F.lit(1.0)), "x")).alias("j", "v")
    sums = scored.select(segment, "_e", F.concat(F.array(F.lit(0.0)), "coef").alias("w"), terms).groupBy(segment, "j").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * e).alias("s"), F.sum(F.abs(F.col("v") * e)).alias("a"),
        F.first(F.element_at("w", F.col("j") + 1)).alias("w"))
    off = F.abs(F.col("s") - alpha * F.col("w")) / (F.col("a") + alpha * F.abs(F.col("w")) + 1e-12)
    return sums.groupBy(segment).agg(F.max("n").alias("n_train"), F.max(off).alias("residual"))
