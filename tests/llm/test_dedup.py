import random
from collections import defaultdict

from pyspark.sql import functions as F

from segcast.llm.dedup import drop_exact_copies, exact_groups, sha256

_LOWER = {c: c + 32 for c in range(65, 91)}
CLASH = ["digest", "norm", "salt", "keep_id", "kept", "top", "__row"]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(_LOWER)].append(i)
    return {(i, max(groups[k]), len(groups[k]), i == max(groups[k]))
            for i, t in rows for k in [(t or "").translate(_LOWER)]}


def texts(n, seed):
    r = random.Random(seed)
    pool = ["", None, "a", "A", "É", "é", "ab c", "AB c", "x" * 50_000, "X" * 50_000, "hot"] + [f"t{i}" for i in range(20)]
    return [(i, "hot" if r.random() < 0.4 else r.choice(pool)) for i in range(n)]


def test_matches_brute_force_with_and_without_digest_clashes(make_docs):
    rows = texts(400, 1)
    docs = make_docs(rows, CLASH).repartition(5)
    for digest in (sha256, lambda t: F.lit(b"same"), lambda t: F.substring(sha256(t), 1, 1)):
        got = exact_groups(docs, n_salts=4, digest=digest).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == brute(rows)


def test_drop_keeps_largest_id_and_all_columns(make_docs):
    rows = texts(200, 2)
    docs = make_docs(rows, CLASH)
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted({k for _, k, _, _ in brute(rows)})
    assert {(r.doc_id, r.text) for r in got} <= set(rows)


def test_null_ids_repeated_rows_and_empty_table(make_docs):
    rows = [(None, "a"), (None, "A"), (1, "b"), (1, "b"), (2, None), (3, "")]
    got = exact_groups(make_docs(rows)).collect()
    assert sorted((str(r.keep_id), r.group_size) for r in got) == [("1", 2)] * 2 + [("3", 2)] * 2 + [("None", 2)] * 2
    assert sum(r.kept for r in got) == 3
    assert sorted(str(r.doc_id) for r in drop_exact_copies(make_docs(rows)).collect()) == ["1", "3", "None"]
    assert exact_groups(make_docs([])).count() == 0
    assert drop_exact_copies(make_docs([])).count() == 0


def test_drop_keeps_every_text_of_null_and_repeated_ids(make_docs):
    rows = [(None, "a"), (None, "A"), (None, "b"), (None, "c"), (5, "x"), (5, "y"), (7, "X"), (7, "z")] + [(None, "hot")] * 300
    got = drop_exact_copies(make_docs(rows, CLASH + ["id_row", "id_digest"]).repartition(7)).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in got) == [
        ("5", "y"), ("7", "x"), ("7", "z"), ("None", "a"), ("None", "b"), ("None", "c"), ("None", "hot")]
    assert all(r.id_row == "clash" for r in got)
