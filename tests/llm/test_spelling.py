import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from segcast.llm import spelling
from segcast.llm.spelling import Index, Tree, fit_cells, follow, group_variants, letters, near_words, vectors, word_counts


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, delete_every=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in string.ascii_uppercase else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % delete_every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w] or "", n[form[w]] if form[w] else -1, root(w)) for w in n)


def told(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"] or "", -1 if r["form_n"] is None else r["form_n"], r["root"]) for r in df.collect())


def variants(rng, n_bases, alphabet="abcdeèÿÉ"):
    out = []
    for _ in range(n_bases):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 11)))
        out += [w] * rng.choice([1, 2, 3, 30, 400])
        for _ in range(rng.randrange(5)):
            i, kind = rng.randrange(len(w)), rng.randrange(4)
            v = {0: w[:i] + w[i + 1:], 1: w[:i] + rng.choice(alphabet) + w[i:], 2: w[:i] + rng.choice(alphabet) + w[i + 1:],
                 3: w[:i] + w[i + 1:] + w[i]}[kind]
            out += [v] * rng.choice([1, 2, 3, 40])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(make_docs, seed):
    rng = random.Random(seed)
    words = variants(rng, 60)
    rows = [(rng.choice([i, i, None]), " ".join(words[i::40]).replace("a", "A", 3)) for i in range(40)] + [(90, None), (91, "")]
    assert told(group_variants(make_docs(rows))) == brute(rows)


@pytest.mark.parametrize("cell,sample", [(10, 40), (25, 1000), (7, 8)])
def test_cells_lose_no_pair(make_docs, monkeypatch, cell, sample):
    monkeypatch.setattr(spelling, "LEAF", 3)
    rng = random.Random(cell)
    words = variants(rng, 80, "abcde")
    rows = [(i, " ".join(words[i::10])) for i in range(10)]
    assert told(group_variants(make_docs(rows), cell_words=cell, sample=sample)) == brute(rows)


def test_words_of_the_same_letters_are_dealt(spark):
    """No plane parts anagrams: the cell is dealt by hash, and near words are still found."""
    rng = random.Random(4)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(300)}
    words |= {w[:3] + "z" + w[4:] for w in list(words)[:40]} | {w[:-1] for w in list(words)[:40]}
    df = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    cells = fit_cells(df, 20, 100)
    parts = cells.first[8]
    assert (parts[1:] - parts[:-1]).max() > 3 and cells.count() > 10
    got = {(r["word"], r["near"]) for r in near_words(df, 20, 100).collect()}
    assert got == {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1 and one_edit(a, b)}
    assert near_words(df, 20, 100).count() == len(got)


@pytest.mark.parametrize("leaf", [1, 4, 50])
def test_tree_prunes_by_the_true_box_distance(leaf):
    rng = np.random.default_rng(leaf)
    points = rng.poisson(0.6, (300, spelling.N_LETTERS)).astype(np.int32)
    points[:, 20:] = 0
    queries = np.concatenate([points[:50], rng.poisson(0.6, (50, spelling.N_LETTERS)).astype(np.int32)])
    tree = Tree(points, leaf)
    assert sorted(tree.order.tolist()) == list(range(300))
    home_query, home = tree.within(points, 0)
    assert sorted(home_query.tolist()) == list(range(300))
    for radius in (1, 2, 4):
        query, leaf_no = tree.within(queries, radius)
        reached = set(zip(query.tolist(), leaf_no.tolist()))
        assert len(reached) == len(query)
        of_point = dict(zip(home_query.tolist(), home.tolist()))
        for q in range(len(queries)):
            for p in np.flatnonzero(np.abs(points - queries[q]).sum(1) <= radius).tolist():
                assert (q, of_point[p]) in reached
    if leaf == 1:
        assert len(tree.within(queries, 1)[0]) < 0.5 * len(queries) * len(tree.leaves)


def test_index_finds_long_and_repeated_letters():
    base = "ab" * 5000
    words = [base, base[:-1] + "c", base[:4000] + "ÿ" + base[4001:], "ba" * 5000]
    index = Index(words, np.full(4, 2))
    rows = letters(words)
    pairs = {frozenset((words[q], index.words[w])) for a, b in index.near(rows, vectors(rows)) for q, w in zip(a.tolist(), b.tolist())}
    assert pairs == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_ties_ratio_and_chains(make_docs):
    texts = [" ".join(["aaaaaaa"] * 1000 + ["aaaaaab"] * 100 + ["aaaaabb"] * 10 + ["bbbbbbb"] * 30 + ["bbbbbbc"] * 30 + ["bbbbbbx"] * 3 + ["bbbbbyx"] * 2)]
    rows = list(enumerate(texts))
    got = {r["word"]: r for r in group_variants(make_docs(rows), delete_every=1 << 40).collect()}
    assert got["aaaaabb"]["form"] == "aaaaaab" and got["aaaaabb"]["root"] == "aaaaaaa" and got["aaaaabb"]["form_n"] == 100
    assert got["bbbbbbx"]["form"] == "bbbbbbb"  # of two as common the smaller
    assert got["bbbbbyx"]["form"] is None and got["bbbbbyx"]["root"] == "bbbbbyx"


def test_follow_long_chain(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)], "word string, form string")
    assert {r["word"]: r["root"] for r in follow(links).collect()} == {str(i): "20" for i in range(20)}


def test_counts_and_odd_tables(spark, make_docs):
    assert group_variants(make_docs([])).count() == 0
    assert group_variants(make_docs([(1, None), (2, "short words only")])).count() == 0
    rows = [(5, "Größerer größerer gr×÷sser " + "y" * 100_000), (5, "GRößerer " + "y" * 100_000)] * 2
    docs = make_docs(rows, extra=["word", "n", "h", "part", "id"])
    assert told(group_variants(docs)) == brute(rows)
    got = {r["word"]: r["n"] for r in word_counts(docs).collect()}
    assert got["y" * 100_000] == 4 or got.get("y" * 99_999) == 4
