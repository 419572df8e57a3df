import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segcast.llm.audit import (_count_digits, _document_layers, _sums_of_shared, _terms, audit, count_digits, divergence,
                               document_layers, smoothed, source_counts)

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs, top):
    """The contract, term by term and pair by pair."""
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(TERM, text or "")])
            for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(t for t in terms if df[t] >= min_docs)
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for source, c in count.items():
            pairs = [(other, sum(f(p(c, t), p(o, t)) for t in kept)) for other, o in count.items() if other != source]
            terms = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, source, part, item, v, i + 1) for i, (item, v) in enumerate(ranked)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "Öl", "straße", "日本", "x1y", "don't", "ZULU", "é", "of"]
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "é", None])
        text = rng.choice([None, "", "123 !"]) if i % 15 == 0 else " ".join(rng.choices(words, [1 + (j * len(source or "")) % 5 for j in range(len(words))], k=rng.randrange(1, 12)))
        rows.append((rng.choice([i, None, 7]), text, rng.choice(["en", "de", None]), source))
    return rows


@pytest.mark.parametrize("seed,min_docs,top", [(1, 5, 3), (2, 10, 10), (3, 1, 2), (4, 30, 10)])
def test_equals_brute_force(spark, seed, min_docs, top):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert told(audit(docs, min_docs, top)) == brute(rows, min_docs, top)


def test_language_without_kept_terms_and_source_without_terms(spark):
    rows = [(i, "same words here", "en", "a") for i in range(10)] + [(20, None, "en", "empty"), (21, "rare", "xx", "p"), (22, "", "xx", "q")]
    got = told(audit(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows, 10, 10)
    assert [r for r in got if r[0] == "xx"] == [("xx", "p", "pair", "q", 0, 1), ("xx", "q", "pair", "p", 0, 1)]


def test_vocabulary_is_per_language(spark):
    rows = [(i, "shared", "en" if i < 9 else "de", "a") for i in range(19)]  # 9 English documents, 10 German ones
    kept, counts = source_counts(spark.createDataFrame(rows, SCHEMA))
    assert [(r["lang"], r["term"]) for r in kept.collect()] == [("de", "shared")]
    assert counts.agg(F.sum("count")).first()[0] == 10


def test_no_term_kept_and_empty_table(spark):
    rows = [(1, "a b", "en", "s"), (2, "c", "en", "t")]
    assert told(audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 10, 10)
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    rows = corpus(9, 80) * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("terms", "vector", "index", "p", "value", "total"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert told(audit(docs, 6)) == brute(rows, 6, 10)


def test_long_text(spark):
    rows = [(i, "tok " * 50_000 if i == 0 else "tok other", "en", "ab"[i % 2]) for i in range(12)]
    assert told(audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 10, 10)


def test_exact_beyond_long_products(spark):
    """10^9 times a count of 10^12 is no long."""
    df = spark.range(1).select(smoothed(F.lit(10**12), F.lit(3 * 10**12), F.lit(7)).alias("p"),
                               divergence(F.lit(10**9 + 1), F.lit(1)).alias("f"))
    assert tuple(df.first()) == (1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 14), (10**9) ** 2 // (10**9 + 2))


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_shared_part_does_not_depend_on_batches(size):
    rng = random.Random(5)
    rows = [(t, "en", s, rng.randrange(1, 10**9), 10 + ord(s)) for t in range(30) for s in "abcdef" if rng.random() < 0.6]
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for t, _, s, p, z in rows:
        for u, _, o, q, y in rows:
            if t == u and s < o:
                want[s, o] += f(p, q) - f(p, y) - f(z, q) + f(z, y)

    def batches():
        for i in range(0, len(rows), size):
            cols = list(zip(*rows[i:i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["index", "lang", "source", "p", "z"])

    got = Counter()
    for b in _sums_of_shared(batches()):
        for r in b.to_pylist():
            got[r["source"], r["item"]] += r["shared"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def lowered_terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(TERM, text)]


def test_terms_equal_the_pattern():
    rng = random.Random(11)
    for _ in range(500):
        texts = ["".join(rng.choices("aBz 1\u00e9\u65e5~[`{@A\x00\x7f\U0001f600", k=rng.randrange(6))) for _ in range(rng.randrange(7))]
        words, code, row = _terms(pa.array(["before", *texts], pa.large_string()).slice(1))
        got = [(i, words[c].as_py()) for i, c in zip(row.tolist(), code.tolist())]
        assert got == [(i, t) for i, text in enumerate(texts) for t in lowered_terms(text)]


def batches_of(rows, names, size):
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[i:i + size])], names)


@pytest.mark.parametrize("piece_bytes,size", [(1, 1), (1, 40), (500, 7), (1 << 20, 40)])
def test_layers_and_digits_add_up_whatever_the_pieces(piece_bytes, size):
    rows = [(lang or "", source or "", text or "") for _, text, lang, source in corpus(6, 200)]
    rows += [("d\x00e", "s\x00", "One one ONE two")] * 3
    docs, counts = Counter(), Counter()
    for lang, source, text in rows:
        docs.update({(t, lang) for t in lowered_terms(text)})
        counts.update((source, t, lang) for t in lowered_terms(text))

    layers = Counter()
    for b in _document_layers(batches_of([(r[0], r[2]) for r in rows], ["lang", "text"], size), 5, piece_bytes):
        for terms in b.column(0).to_pylist():
            assert terms and len(set(terms)) == len(terms)
            layers.update(tuple(t.split("\x00", 1)) for t in terms)
    assert layers.keys() == docs.keys()
    assert all(n == docs[k] if docs[k] <= 5 else 5 <= n <= docs[k] for k, n in layers.items())

    digits = Counter()
    for b in _count_digits(batches_of(rows, ["lang", "source", "text"], size), piece_bytes):
        for r in b.to_pylist():
            assert r["terms"] and len(set(r["terms"])) == len(r["terms"])
            for t in r["terms"]:
                digits[(r["source"], *t.split("\x00", 1))] += r["weight"]
    assert digits == counts


def test_vectorizer_gets_each_term_a_few_times(spark):
    """A term of every document goes through the vectorizer once a layer and once a digit, not once an occurrence."""
    docs = spark.createDataFrame([(i, "same words again and again", "en", "ab"[i % 2]) for i in range(600)], SCHEMA).coalesce(1)
    passed = lambda df: df.agg(F.sum(F.size("terms"))).first()[0]
    assert passed(document_layers(docs, 10)) == 4 * 10
    assert passed(count_digits(docs)) == 2 * (3 * bin(300).count("1") + bin(600).count("1"))


def test_equal_values_at_the_last_rank(spark):
    words = [a + b for a in "zyxw\u00e9" for b in "abcdefg"]
    rows = [(i, " ".join(words[:20] if i % 2 else words[15:]), "en", "ab"[i % 2]) for i in range(24)]
    got = told(audit(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows, 10, 10) and len([r for r in got if r[2] == "term"]) == 20


def test_shares_about_the_largest_long_product(spark):
    counts = [9 * 10**9 + d for d in range(-4, 3)] + [2**62]
    df = spark.createDataFrame([(c,) for c in counts], "c long").select(smoothed(F.col("c"), F.col("c") + 5, F.lit(3)))
    assert [int(r[0]) for r in df.collect()] == [1 + 10**9 * (c + 2) // (c + 5 + 6) for c in counts]
