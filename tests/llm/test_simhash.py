import random
import re

import xxhash

from segcast.llm import simhash as S
from segcast.llm.components import connected_components

_LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fp(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(ids))}


def near_texts(n, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(300)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "É é x y"), (7, "w " * 20_000)]
    for i in range(8, n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return rows


def test_fingerprint_matches_definition():
    for _, t in near_texts(60, 3):
        assert S.simhash((t or "").encode()) == brute_fp(t)


def test_components_match_all_pairs(make_docs):
    rows = near_texts(260, 4)
    docs = make_docs(rows, ["fp", "component_id", "root", "first_id"]).repartition(4)
    got = {r.doc_id: r.component_id for r in S.near_components(docs).collect()}
    want = brute_components([i for i, _ in rows], [brute_fp(t) for _, t in rows], 3)
    assert got == want
    out = S.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))


def test_links_lose_nothing_when_cells_are_cut_in_blocks(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        seed = r.getrandbits(64)
        for _ in range(60):
            seed ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
            fps.add(seed)
    ids = sorted(fps)
    want = brute_components(ids, ids, 3)
    df = spark.createDataFrame([(S._signed(f),) for f in ids], "fp long")
    for block in (4, 4096):
        links = S.near_links(df, 3, block)
        parts = {x.node % 2**64: x.root for x in connected_components(links).collect()}
        mine = {}
        for f in ids:
            mine.setdefault(parts.get(f, f"alone {f}"), set()).add(f)
        theirs = {}
        for f in ids:
            theirs.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_null_ids_repeats_and_empty(make_docs):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "A B c d"), (None, "q r s t")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in S.near_components(make_docs(rows)).collect())
    assert got == [("4", "4"), ("4", "4"), ("9", "4"), ("None", "4"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in S.drop_near_copies(make_docs(rows)).collect()) == ["4", "None"]
    assert S.near_components(make_docs([])).count() == 0


def test_long_chain_settles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(links).collect()} == {(i, 0) for i in range(201)}


def test_drop_keeps_a_document_of_every_component_of_null_and_repeated_ids(make_docs):
    a, b, c, d, e = ("a b c d", "q r s t", "e f g h i", "k l m n o", "u v w x y")
    rows = [(None, a), (None, b), (None, c), (None, c), (3, a), (2, d), (8, d), (8, e)]
    assert len({S.simhash(t.encode()) for t in (a, b, c, d, e)}) == 5
    got = S.drop_near_copies(make_docs(rows, ["digest", "first"]).repartition(5)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("2", d), ("3", a), ("8", e), ("None", c), ("None", b)]
