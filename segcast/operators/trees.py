"""Fitted MLlib tree ensembles as flat arrays, scored for many rows at once (H3, M4).

A fitted ensemble is saved once under the checkpoint folder, as MLlib saves it: one row a
node.  The rows are laid down as five arrays: feature, threshold, left child, right child
and value of each node.  Their size is bounded by the presets (trees · 2^(depth+1) nodes,
whatever the number of rows), so they go along with the task that scores.  Scoring moves
all rows down all trees together, one level at a time, with MLlib's own rule (left if the
feature is at most the threshold); a forest's prediction is the mean of its trees, a
boosted one's the weighted sum, added in MLlib's order.

With the trees as arrays a whole forecast horizon runs inside one task per group of
segments: no job, no model call through the JVM and no stored state per step.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from segcast.session import ensure_checkpoint_dir

_ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class FlatTrees:
    """Node arrays of all trees, one tree after the other; ``roots`` is where each starts. A leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    mean: bool  # mean of the trees, or their weighted sum

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of ``x`` (rows by features)."""
        return np.concatenate([np.zeros(0), *(self._some(x[i:i + _ROWS_AT_ONCE]) for i in range(0, len(x), _ROWS_AT_ONCE))])

    def _some(self, x: np.ndarray) -> np.ndarray:
        row = np.arange(len(x))[:, None]
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        while True:
            down = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            if np.array_equal(down, at):
                break
            at = down
        total = np.cumsum(self.value[at] * self.weights, axis=1)[:, -1]  # one tree after the other, as MLlib adds
        return total / len(self.roots) if self.mean else total


def flatten(spark: SparkSession, model, is_mean: bool) -> FlatTrees:
    """The arrays of a fitted MLlib regression forest (``is_mean``) or boosted ensemble with continuous features."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees/{uuid.uuid4().hex}"
    model.save(path)
    node = spark.read.parquet(f"{path}/data")
    nodes = node.selectExpr("treeID AS tree", "nodeData.id AS id", "nodeData.prediction AS value", "nodeData.leftChild AS l",
                            "nodeData.rightChild AS r", "nodeData.split.featureIndex AS feature",
                            "nodeData.split.leftCategoriesOrThreshold AS cut", "nodeData.split.numCategories AS n_categories")
    t = nodes.toPandas().sort_values(["tree", "id"], ignore_index=True)  # at most trees * 2^(depth + 1) rows
    tree, node_id = t["tree"].to_numpy(), t["id"].to_numpy()
    roots = np.flatnonzero(node_id == 0)
    inner = t["l"].to_numpy() >= 0
    if (t["n_categories"].to_numpy()[inner] >= 0).any():
        raise ValueError("categorical splits are not laid down")
    base = roots[tree]  # ids count from 0 within a tree
    place = np.arange(len(t))
    left = np.where(inner, base + t["l"].to_numpy(), place)
    right = np.where(inner, base + t["r"].to_numpy(), place)
    threshold = np.array([c[0] if i else 0.0 for c, i in zip(t["cut"], inner)])
    weights = np.ones(len(roots)) if is_mean else np.array(model.treeWeights, float)
    return FlatTrees(np.where(inner, t["feature"].to_numpy(), 0), threshold, left, right, t["value"].to_numpy(float), roots, weights, is_mean)
