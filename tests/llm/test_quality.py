import random
import zlib

import numpy as np
import pytest

from segcast.llm import quality as Q


def corpus(n, seed):
    r = random.Random(seed)
    words = ["the", "lamp", "stood", "near", "a", "river", "été", "grün", "and", "slowly", "turned"]
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        w = [r.choice(words) + r.choice(words) for _ in range(r.randint(20, 300))]
        if good:
            text = ". ".join(" ".join(w[k:k + 9]).capitalize() for k in range(0, len(w), 9)) + "."
        else:
            text = r.choice([lambda: " ".join(x.upper() + "!!" for x in w), lambda: " ".join([w[0]] * len(w)),
                             lambda: " | ".join(w), lambda: "### ".join(w)])()
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int")


def scores(docs, labels):
    stats = Q.statistics(docs)
    return {r.doc_id: r.score for r in Q.score_statistics(stats, Q.fit(stats, labels)).collect()}


def test_held_out_accuracy_and_clean_documents_kept(spark, make_docs):
    docs, labels = corpus(900, 1)
    df = make_docs(docs, ["score", "x", "quality", "fold", "quality_score"]).repartition(4)
    got = scores(df, frame(spark, labels))
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    held = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= Q.THRESHOLD) == q for i, q in held]) > 0.98
    out = Q.keep_good_documents(df, frame(spark, labels))
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept == {i for i, s in got.items() if s >= Q.THRESHOLD}
    assert len({i for i, q in labels if q} - kept) <= 3


def test_held_out_labels_and_other_columns_never_enter(spark, make_docs):
    docs, labels = corpus(300, 2)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a = scores(make_docs(docs), frame(spark, labels))
    b = scores(make_docs([(i, t, f"s{i}") for i, t in docs]).repartition(3), frame(spark, flipped))
    assert a == pytest.approx(b, abs=2e-6)


def test_odd_texts_and_labels(spark, make_docs):
    docs, labels = corpus(200, 3)
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "x" * 200_000), (1004, "é " * 100_000), (None, "a b"), (1005, "same"), (1005, "same")]
    labels += [(1001, None), (1, 0), (1, 1), (9999, 1)]
    stats = Q.statistics(make_docs(docs))
    got = Q.score_statistics(stats, Q.fit(stats, frame(spark, labels))).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001]


def test_without_both_classes_and_empty(spark, make_docs):
    docs, labels = corpus(40, 4)
    for some in ([], [(i, 1) for i, _ in labels]):
        assert set(scores(make_docs(docs), frame(spark, some)).values()) == {0.5}
    assert scores(make_docs([]), frame(spark, labels)) == {}
    assert Q.keep_good_documents(make_docs([]), frame(spark, [])).count() == 0


def test_factors_give_mahalanobis_distances():
    r = np.random.default_rng(5)
    x = {q: r.normal(size=(400, Q.N_STATISTICS)) @ r.normal(size=(Q.N_STATISTICS, Q.N_STATISTICS)) + q for q in (0, 1)}
    one = {q: np.concatenate([np.ones((400, 1)), v], axis=1) for q, v in x.items()}
    model = Q._gaussians({q: v.T @ v for q, v in one.items()}, pooling=0.0, ridge=0.0)
    at = r.normal(size=(5, Q.N_STATISTICS))
    want = []
    for q in (0, 1):
        cov, mean = np.cov(x[q].T, bias=True), x[q].mean(axis=0)
        d = at - mean
        m = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        want.append(-0.5 * m - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.difference(at) == pytest.approx(want[1] - want[0], rel=1e-6, abs=1e-4)
