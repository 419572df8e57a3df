import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from segcast.llm import fingerprint as P


def units(text, n=P.PIECE_WORDS):
    c = Counter()
    for line in text.split("\n"):
        w = line.split()
        for i in range(0, len(w), n):
            c[" ".join(w[i:i + n])] += 1
    return c


def like(a, b):
    a, b = units(a), units(b)
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 1.0


def brute(rows):
    """Rows in descending doc_id order; ids must differ."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[:len(t) - h] + nxt[:h]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), pytest.approx(like(t, e)), pytest.approx(like(t, nxt)))
    return out


def texts(n, seed):
    r = random.Random(seed)
    pool = [None, "", "é", "one two", "a\nb\na", "x " * 30_000, "same text here"]
    for i in range(n):
        yield r.randrange(10**6) * n + i, r.choice(pool) if r.random() < 0.3 else " ".join(r.choice("abcdeé\n") * 3 for _ in range(r.randint(1, 900)))


@pytest.mark.parametrize("per_range", [1024, 7])
def test_matches_brute_force(make_docs, per_range):
    rows = list(texts(150, 1)) + [(-5, "least id"), (None, "null id")]
    docs = make_docs(rows, ["range", "guest", "id", "hash", "at", "before"]).repartition(4)
    got = P.compare_versions(docs, rows_per_range=per_range).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == brute(rows)
    prints = {}
    for r, t in ((r, dict(rows)[r.doc_id]) for r in got):
        assert prints.setdefault(t or "", r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) > 100


def test_repeated_rows_single_row_and_empty_table(make_docs):
    got = P.compare_versions(make_docs([(1, "a b"), (1, "a b"), (1, "c d"), (0, "z")])).collect()
    assert len(got) == 4 and sorted(r.doc_id for r in got) == [0, 1, 1, 1]
    one = P.compare_versions(make_docs([(3, "a b c d")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(3, 1.0)]
    assert P.compare_versions(make_docs([])).count() == 0


def test_peeling_recovers_every_size_of_difference():
    r = np.random.default_rng(3)
    shared = r.integers(0, 2**63, 50, dtype=np.uint64)
    left, right, want = [], [], []
    for n in (0, 1, 2, 3, 10, 100, 3000):
        a, b = r.integers(0, 2**63, n, dtype=np.uint64), r.integers(0, 2**63, n // 2, dtype=np.uint64)
        left.append(np.concatenate([shared, a]))
        right.append(np.concatenate([b, shared]))
        want.append(n + n // 2)
    assert P.differences(left, right).tolist() == want
    assert P.differences(left, right, cells=3).tolist() == want
    assert P.differences([], []).tolist() == []


def test_fingerprint_has_no_order_but_counts_repeats():
    a, b = P.paragraph_digests("x\ny\nx"), P.paragraph_digests("x\nx\ny")
    assert P.fingerprint(a) == P.fingerprint(b) != P.fingerprint(P.paragraph_digests("x\ny"))


@pytest.mark.parametrize("bits", [2, 6, 10])
def test_peeling_ends_with_a_weak_check(monkeypatch, bits):
    """Cells that look pure by chance neither hang the peeling nor spoil what it returns."""
    strong = P._check
    monkeypatch.setattr(P, "_check", lambda keys: (strong(keys) >> np.uint32(32 - bits)).astype(np.uint32))
    r = np.random.default_rng(bits)
    sets = [r.integers(0, 2**63, int(n), dtype=np.uint64) for n in r.integers(0, 60, 400)]
    got = P.differences(sets[:200], sets[200:])
    want = [len(a) + len(b) for a, b in zip(sets[:200], sets[200:])]
    assert len(got) == 200 and sum(int(a) != b for a, b in zip(got, want)) <= (60 if bits == 2 else 6)


def test_recovered_digests_are_the_differing_paragraphs():
    r = np.random.default_rng(1)
    left = [r.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 5, 300)]
    right = [np.concatenate([x[: len(x) // 2], r.integers(0, 2**63, 7, dtype=np.uint64)]) for x in left]
    pair, keys, sides = P.recover(left, right)
    for i, (a, b) in enumerate(zip(left, right)):
        a, b = set(a.tolist()), set(b.tolist())
        assert set(keys[(pair == i) & (sides == 1)].tolist()) == a - b and set(keys[(pair == i) & (sides == -1)].tolist()) == b - a
    one, two = "same line\nold words here\nsame line\nlast", "same line\nnew words\nlast\nlast"
    assert P.differing_paragraphs(one, two) == (["old words here", "same line"], ["new words", "last"])
    assert P.differing_paragraphs("", "") == ([], [])
