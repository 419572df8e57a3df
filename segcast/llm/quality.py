"""Document quality by a regularised quadratic discriminant over transformed text statistics.

Each class has a Gaussian over the statistics of ``text_statistics``.  Its covariance is
shrunk twice: towards the pooled covariance by ``pooling``, then towards the mean
variance on the diagonal by ``ridge`` (Friedman's regularised discriminant).  The
inverse Cholesky factor of each class is cached in the model, so a score needs one
matrix product: the Mahalanobis distances give the log-density difference, and a
logistic calibration turns that into a probability of quality 1.

Fitting takes every labelled row outside the held-out fold.  Its statistics enter only
through sums of products per class and fold, and through binned log-density
differences, so the driver sees tables of fixed size.  The shrinkage pair is the one with
the least out-of-fold log loss among ``GRID``; the calibration is fitted on the same
out-of-fold differences.

Folds are crc32(doc_id as text) mod 5; fold 0 is never used for fitting.  Neither
labels nor doc_id, lang or source enter a score.

Defined cases: a null text counts as empty and is scored like any text; documents
without a label are only scored; a document whose label rows disagree counts as its
majority, as quality 0 on a tie; null labels are left out; with labels of one class
only, or none, every score is 0.5.  Columns of the input are passed through by
``score_documents``; one with the name of the score column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from segcast.llm.common import free_name, map_texts, materialise

FOLDS = 5
GRID = [(p, r) for p in (0.02, 0.1, 0.3) for r in (0.003, 0.03)]
THRESHOLD = 0.3
#: Log-density differences are binned for calibration: 0.5 wide, the outer bins open.
BIN_WIDTH, BIN_EDGE = 0.5, 200.0
_PUNCTUATION = [ord(c) for c in ".,;:'\"()-"]
_MARKS = [ord(c) for c in "!?"]
_SYMBOLS = [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]
N_STATISTICS = 15


def text_statistics(text: bytes) -> list[float]:
    """Counts enter as logarithms, fractions as square roots, which steadies their variance."""
    n = max(1, len(text))
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, other = int(b[65:91].sum()), int(b[97:123].sum()), int(b[128:].sum())
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    repeats = sum(map(eq, words, words[1:]))
    lines = text.split(b"\n")
    initial = sum(map(bytes.isupper, (w[:1] for w in words)))
    return [
        np.log1p(len(words)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(len(words) / len(lines)),
        np.sqrt(upper / max(1, upper + lower)),
        np.sqrt(other / n),
        np.sqrt(int(b[48:58].sum()) / n),
        np.sqrt(int(b[_PUNCTUATION].sum()) / n),
        np.sqrt(int(b[_MARKS].sum()) / n),
        np.sqrt(int(b[_SYMBOLS].sum()) / n),
        np.sqrt(int(b[124]) / n),
        np.sqrt(repeats / m),
        np.sqrt(len(set(words)) / m),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        np.sqrt(initial / m),
    ]


@dataclass(frozen=True)
class Model:
    """Means and inverse Cholesky factors per class, and the calibration of their log-density difference."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, for rows of statistics."""
        density = [-0.5 * (((x - mu) @ f.T) ** 2).sum(axis=1) - ld
                   for mu, f, ld in zip(self.means, self.factors, self.log_dets)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(_logistic(self.slope * self.difference(x) + self.offset), 6)


class _Unfitted:
    """Stands in where a class has no labelled row."""

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _features(texts: pa.Array) -> np.ndarray:
    rows = [text_statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    return np.array(rows).reshape(-1, N_STATISTICS)


def fold_of(doc_id) -> F.Column:
    """crc32 of doc_id as text, mod 5; a null doc_id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(b.column(1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), values], ["doc_id", "x"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(base, run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_STATISTICS)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, quality, k, value): sums of products of (1, x), a task's rows together."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        x = _matrix(b.column(2))
        group = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
        one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        for f, q in np.unique(group, axis=0).tolist():
            rows = one[(group == (f, q)).all(axis=1)]
            total[f, q] = total.get((f, q), 0) + rows.T @ rows
    for (f, q), m in total.items():
        n = m.size
        yield pa.RecordBatch.from_arrays(
            [pa.array([f] * n, pa.int32()), pa.array([q] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m.ravel())],
            ["fold", "quality", "k", "value"])


def _gaussians(products: dict[int, np.ndarray], pooling: float, ridge: float) -> Model:
    means, spreads, counts = [], [], []
    for q in (0, 1):
        m = products[q]
        mean = m[0, 1:] / m[0, 0]
        means.append(mean)
        spreads.append(m[1:, 1:] - m[0, 0] * np.outer(mean, mean))
        counts.append(m[0, 0])
    pooled = sum(spreads) / sum(counts)
    scale = np.sqrt(np.diag(pooled)) + 1e-9  # statistics are put on one scale before shrinking to the diagonal
    factors, log_dets = [], []
    for s, n in zip(spreads, counts):
        cov = ((1 - pooling) * s + pooling * n * pooled) / n / np.outer(scale, scale)
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
        chol = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(chol) / scale)
        log_dets.append(float(np.log(np.diag(chol)).sum()))
    return Model(np.array(means), np.array(factors), np.array(log_dets), 1.0, 0.0)


def _calibrate(z: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and mean log loss of a logistic fit to binned differences ``z`` with counts n[:, quality]."""
    w = np.zeros(2)
    design = np.stack([z, np.ones_like(z)], axis=1)
    total = n.sum(axis=1)
    for _ in range(50):  # Newton steps with a slight pull to zero, for classes that separate fully
        p = _logistic(design @ w)
        gradient = design.T @ (total * p - n[:, 1]) + 1e-3 * w
        hessian = (design * (total * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    p = np.clip(_logistic(design @ w), 1e-9, 1 - 1e-9)
    loss = -(n[:, 1] * np.log(p) + n[:, 0] * np.log(1 - p)).sum() / total.sum()
    return float(w[0]), float(w[1]), float(loss)


def fit(stats: DataFrame, labels: DataFrame) -> Model | _Unfitted:
    """Model from ``stats`` (see statistics) and ``labels`` (doc_id, quality)."""
    known = (
        labels.filter(F.col("quality").isNotNull() & (fold_of("doc_id") != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
        .withColumn("quality", (F.col("quality") > 0.5).cast("int"))
    )
    train = stats.join(known, "doc_id").select(fold_of("doc_id").alias("fold"), "quality", "x")
    train = materialise(train, "quality-train")

    sums = train.mapInArrow(_products, "fold int, quality int, k int, value double")
    size = N_STATISTICS + 1
    part: dict[tuple[int, int], np.ndarray] = {}
    for r in sums.groupBy("fold", "quality", "k").agg(F.sum("value").alias("value")).collect():  # 8 * 256 rows at most
        part.setdefault((r["fold"], r["quality"]), np.zeros(size * size))[r["k"]] = r["value"]
    part = {k: m.reshape(size, size) for k, m in part.items()}

    def without(fold: int) -> dict[int, np.ndarray]:
        return {q: sum((m for (f, c), m in part.items() if c == q and f != fold), np.zeros((size, size))) for q in (0, 1)}

    if any(without(0)[q][0, 0] < 2 for q in (0, 1)):
        return _Unfitted()
    folds = [f for f in range(1, FOLDS) if all(without(f)[q][0, 0] >= 2 for q in (0, 1))]
    models = {(f, g): _gaussians(without(f), *GRID[g]) for f in folds for g in range(len(GRID))}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, quality, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            for f in set(fold.tolist()) & set(folds):
                mine = fold == f
                for g in range(len(GRID)):
                    z = np.clip(models[f, g].difference(x[mine]), -BIN_EDGE, BIN_EDGE)
                    bins, n = np.unique(np.stack([np.round(z / BIN_WIDTH), quality[mine]], axis=1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * len(n), pa.int32()), pa.array(bins[:, 0].astype(np.int32)),
                         pa.array(bins[:, 1].astype(np.int32)), pa.array(n.astype(np.int64))], ["g", "bin", "quality", "n"])

    counts: dict[int, dict[int, list[int]]] = {}
    found = train.mapInArrow(binned, "g int, bin int, quality int, n long").groupBy("g", "bin", "quality")
    for r in found.agg(F.sum("n").alias("n")).collect():  # bins of fixed number
        counts.setdefault(r["g"], {}).setdefault(r["bin"], [0, 0])[r["quality"]] = r["n"]
    best = None
    for g, bins in sorted(counts.items()):
        order = sorted(bins)
        slope, offset, loss = _calibrate(np.array(order) * BIN_WIDTH, np.array([bins[k] for k in order], float))
        if best is None or loss < best[0]:
            best = (loss, g, slope, offset)
    whole = _gaussians(without(0), *(GRID[best[1]] if best else GRID[-1]))
    return Model(whole.means, whole.factors, whole.log_dets, *(best[2:] if best else (1.0, 0.0)))


def score_statistics(stats: DataFrame, model: Model | _Unfitted) -> DataFrame:
    """(doc_id, score) for every row of ``stats``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, model: Model | _Unfitted, name: str = "quality_score") -> DataFrame:
    """``docs`` with a score column, in one pass over the texts."""
    base = docs.drop(name)
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array(model.score(_features(b.column(at).cast(pa.string()))))
            yield pa.RecordBatch.from_arrays([*b.columns, score], [*b.schema.names, name])

    return map_texts(base, run, StructType([*base.schema.fields, StructField(name, DoubleType())]))


def keep_good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at ``threshold`` or more, with the columns of ``docs``."""
    model = fit(statistics(docs), labels)
    name = free_name(docs, "quality_score")
    scored = score_documents(docs, model, name)
    return scored.filter(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
