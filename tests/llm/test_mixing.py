import random
import re
from collections import defaultdict

import pytest

from segcast.llm import mixing as M


def sizes_of(rows):
    return [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]


def reshared(size_of, weights=(3, 1, 2), share=1.5, repeats=2):
    """The contract's own words: share by weight, stop at the limit, share the excess again."""
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(order, 0.0), set(order), share * sum(size_of.values())
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in sorted(open_, key=str):
            if target[s] >= repeats * size_of[s]:
                rest += target[s] - repeats * size_of[s]
                target[s] = repeats * size_of[s]
                open_.discard(s)
    return target


def rows_of(n, seed, sources="abcdefg"):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = "b" if r.random() < 0.4 else r.choice([*sources, None, "É"])
        t = r.choice([None, "", " \t\n", "one", "w w x\x0by\x1cz"]) if r.random() < 0.2 else "w " * r.randint(1, 200)
        rows.append((i, t, s))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_takings(make_docs, seed):
    rows = rows_of(400, seed)
    docs = make_docs(rows, ["size", "part", "key", "p_source", "turn", "offset"]).repartition(5)
    got = M.mix_plan(docs).collect()
    sizes = {i: z for i, z, _ in sizes_of(rows)}
    total = defaultdict(int)
    for i, z, s in sizes_of(rows):
        total[s] += z
    want = reshared(total)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert (r.size, r.source_size) == (sizes[r.doc_id], total[r.source])
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(x["words"] for x in r.rounds) and all(0 <= x["position"] <= 1 for x in r.rounds)
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 1
    again = M.mix_plan(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_positions_invert_the_schedule(spark):
    from pyspark.sql import functions as F
    for slope in M.SLOPES:
        df = spark.range(101).select((F.col("id") / 100).alias("t"))
        demand = 500 * (F.col("t") + slope * (F.col("t") * F.col("t") - F.col("t")))
        for r in df.select("t", M.demand_position(demand, F.lit(500.0), F.lit(slope)).alias("p")).collect():
            assert r.p == pytest.approx(r.t, abs=1e-9)


def test_mixed_documents_repeat_cut_and_stand_in_order(make_docs):
    rows = [(i, f"d{i} " + "w " * (i % 7) + "end", s) for i, s in enumerate("aabbbbbbccddddddddddddddddddddddd" * 3)]
    docs = make_docs(rows, ["mix_id", "mix_size"])
    plan = {r.doc_id: r for r in M.mix_plan(docs).collect()}
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    words = defaultdict(int)
    for r in out:
        assert r.text == rows[r.doc_id][1] or rows[r.doc_id][1].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {i: p.taken for i, p in plan.items() if p.taken}
    spots = []
    seen = defaultdict(int)
    for r in out:
        spots.append(plan[r.doc_id].rounds[seen[r.doc_id]]["position"])
        seen[r.doc_id] += 1
    assert spots == sorted(spots)


def test_empty_texts_and_table(make_docs):
    got = M.mix_plan(make_docs([(1, None, "a"), (2, "", None)])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert M.mix_plan(make_docs([])).count() == 0
    assert M.mixed_documents(make_docs([(1, None, "a")])).count() == 0
    twice = make_docs([(1, "a b c", "a"), (1, "a b c", "a"), (2, "x", "b")])
    assert sum(r.taken for r in M.mix_plan(twice).collect()) <= 10
    assert sum(len(r.text.split()) for r in M.mixed_documents(twice).collect()) == sum(r.taken for r in M.mix_plan(twice).collect())


@pytest.mark.parametrize("ids", ["one", "null", "few"])
def test_words_of_each_source_follow_the_plan_whatever_the_ids(make_docs, ids):
    """Different texts of three sources under one doc_id, none, or a few that cross sources."""
    r = random.Random(7)
    made = {"one": lambda i: 7, "null": lambda i: None, "few": lambda i: i % 5}[ids]
    rows = [(made(i), f"t{i} " + "w " * r.randint(1, 30), r.choice("aabc")) for i in range(300)]
    rows += [(made(0), "same text twice", "c")] * 2
    docs = make_docs(rows, ["mix_row", "mix_size", "tie"]).repartition(6)
    planned, mixed = defaultdict(int), defaultdict(int)
    for p in M.mix_plan(docs).collect():
        planned[p.source] += p.taken
    texts = {(i, t, s) for i, t, s in rows}
    out = M.mixed_documents(docs).collect()
    for x in out:
        mixed[x.source] += len(x.text.split())
        assert any(t == x.text or t.startswith(x.text) for i, t, s in texts if (i, s) == (x.doc_id, x.source))
    assert mixed == planned and min(planned.values()) > 0
    assert sorted(map(str, M.mixed_documents(docs.repartition(3)).collect())) == sorted(map(str, out))
