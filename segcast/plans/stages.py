"""Named stages of one run under a folder with stable names, so that a run whose driver was lost goes on where it stood.

A stage counts as done once Spark has committed its files (``_SUCCESS``); an unfinished one is written again.
The folder belongs to one input and one set of parameters: the parameters are kept with it and compared, and the
input is the caller's word (a new input takes a new folder).
"""

from __future__ import annotations

import json

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession

from segcast.operators import models as md


class Stages:
    """Keep and find the stages of a run under ``folder``, a path every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str, parameters: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        text = json.dumps(parameters, sort_keys=True, default=str)
        known = self.keep(spark.createDataFrame([(text,)], "parameters string"), "parameters").first()[0]
        if known != text:
            raise ValueError(f"{folder} holds a run with other parameters: {known}")

    def done(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The stage's rows: as written before, or ``df`` written now."""
        if not self.done(name):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def keep_ensemble(self, fit) -> md.Ensemble:
        """The run's fitted ensemble: as saved before, or ``fit()`` saved now, its list of features last."""
        if not self.done("ensemble"):
            ens = fit()
            ens.rf.write().overwrite().save(f"{self.folder}/forest")
            ens.gb.write().overwrite().save(f"{self.folder}/boosted")
            self.keep(ens.ridge, "ridge")
            self.keep(ens.errors, "fit-errors")
            columns = [(ens.feature_cols, ens.label, ens.segment)]
            self.keep(self.spark.createDataFrame(columns, "features array<string>, label string, segment string"), "ensemble")
        row = self.spark.read.parquet(f"{self.folder}/ensemble").first()
        return md.Ensemble(list(row["features"]), RandomForestRegressionModel.load(f"{self.folder}/forest"),
                           GBTRegressionModel.load(f"{self.folder}/boosted"), self.spark.read.parquet(f"{self.folder}/ridge"),
                           row["label"], row["segment"], self.spark.read.parquet(f"{self.folder}/fit-errors"))
