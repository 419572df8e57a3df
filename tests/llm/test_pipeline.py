import os
import subprocess
import sys
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from segcast.llm import quality
from segcast.llm.common import materialise, table
from segcast.llm.queries import ORACLE, QUERIES
from tests.llm.test_dedup import brute as exact_brute
from tests.llm.test_mixing import reshared, sizes_of
from tests.llm.test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_every_stage_against_brute_force(spark, stages):
    raw = table(spark, SF, "documents")
    good, exact, near, mixed, packed = stages
    assert all(s.columns == COLUMNS for s in stages[:-1])

    stats = quality.statistics(raw)
    scores = quality.score_statistics(stats, quality.fit(stats, table(spark, SF, "labels"))).collect()
    kept = {r.doc_id for r in good.collect()}
    assert kept == {r.doc_id for r in scores if r.score >= quality.THRESHOLD}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert sum(labels.get(i) == 1 for i in {r.doc_id for r in raw.collect()} - kept) <= 2

    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in exact.collect()} == {k for _, k, _, _ in exact_brute(rows)}
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    parts = brute_components([i for i, _ in rows], [brute_fp(t) for _, t in rows], 3)
    assert {r.doc_id for r in near.collect()} == set(parts.values())

    rows = [(r.doc_id, r.text, r.source) for r in near.collect()]
    size, taken = defaultdict(int), defaultdict(int)
    for _, z, s in sizes_of(rows):
        size[s] += z
    for _, z, s in sizes_of([(r.doc_id, r.text, r.source) for r in mixed.collect()]):
        taken[s] += z
    want = reshared(size)
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)

    pieces = Counter(r.doc_id for r in packed.filter("piece = 0").collect())
    assert pieces == Counter(r.doc_id for r in mixed.collect())
    fill = Counter()
    for r in packed.collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) == -(-sum(fill.values()) // 4096)


def test_run_gives_the_last_stage(spark, stages):
    a, b = corpus_pipeline.run(spark, SF), stages[-1]
    assert a.columns == b.columns
    assert sorted(a.select("doc_id", "piece", "ids_crc32").collect()) == sorted(b.select("doc_id", "piece", "ids_crc32").collect())


def test_pipeline_survives_odd_documents(spark, make_docs):
    docs = make_docs([(None, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "A b c"), (4, "x " * 50_000)], ["norm", "digest"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        cols = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == cols
    docs.collect()
    assert corpus_pipeline.pack_stage(spark, docs, SF).count() >= 0
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    text = lambda df: sorted(map(tuple, df[cols].astype(str).values))
    assert text(got) == text(want)


def test_entry_module_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = ("import sys; sys.modules['segcast.llm'] = None; import __spark_entry__ as e;"
            "assert not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert len(e.queries()) > 50")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
