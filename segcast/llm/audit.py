"""Source divergence audit: how far the sources of a language differ in the words they use.

1. CountVectorizer with minDF as a number of documents and the largest vocabSize there is
   finds the kept terms.  Every language has its own vocabulary: a term carries its
   document's language, so one fit over all documents counts, for each term, the documents
   of that language, and no job is started per language.  A task lays some megabytes of
   documents together before: the k-th row of such a piece has the terms that k or more of
   a language's documents there have, up to ``min_docs`` rows.  A term stands in as many
   rows as documents have it, or in ``min_docs`` or more if those are as many, so the same
   terms are kept.
2. The fitted model makes exact sparse vectors, again of pieces: for each source, language
   and binary digit of a count, one vector of the terms whose count in the piece has it.
   The vectors' entries times the digit's weight are summed by source and term, as
   Summarizer sums vectors but without a dense one: each map task adds up its own first.
3. With p = 1 + floor(10^9 (count + 2) / (N + 2 V)) for every kept term, the divergence of
   two sources is the sum of f(p, q) = floor((p - q)^2 / (p + q)) over all V kept terms of
   their language.  Most terms are missing in one source or both, where p depends on the
   source alone (z).  So the sum is taken as
       V f(z, z') + sum over a's terms of f(p, z') - f(z, z') + the same for b's terms
       + sum over shared terms of f(p, q) - f(p, z') - f(z, q) + f(z, z'),
   exactly, in integers.  The second and third follow from how many terms of a source have
   each p; the last is added up where the terms lie, and a task returns one sum for each
   pair of sources it met.

What grows at the driver is the vocabulary, which CountVectorizer gathers and sends to
every executor: the distinct terms found in ``min_docs`` documents or more of a language.
A term meets at most as many rows as its language has sources.

Defined cases: null text, lang and source count as ''; a source without kept terms has
counts 0; a language with no kept term has divergences 0; equal values rank by item;
repeated rows count each; an empty table gives no rows; only text, lang and source are read.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segcast.llm.common import map_texts, materialise, text_or_empty
from segcast.session import ensure_checkpoint_dir

MIN_DOCS = 10
MAX_VOCABULARY = (1 << 31) - 1
SCALE = 1_000_000_000
TOP = 10
#: Bytes of text whose terms a task merges at a time.
PIECE_BYTES = 8 << 20
_MARK = "\x00"  # no term holds it
_FLUSH = 1_000_000
#: Bytes of terms: ASCII letters and all of longer UTF-8 sequences.
_IN_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    """The columns of the batches, which are let go."""
    columns = [pa.concat_arrays([b.column(i).cast(pa.large_string()) for b in batches]) for i in range(batches[0].num_columns)]
    batches.clear()
    return columns


def _pieces(batches: Iterator[pa.RecordBatch], piece_bytes: int) -> Iterator[list[pa.Array]]:
    """The columns of about ``piece_bytes`` of batches at a time."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        waiting.append(b)
        if sum(w.nbytes for w in waiting) >= piece_bytes:
            yield _joined(waiting)
    if waiting:
        yield _joined(waiting)


def _terms(text: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of the texts, and for each place of a term its number among them and its text's number."""
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _IN_TERM[data]
    fenced = np.concatenate([[False], inside, [False]])
    edges = np.flatnonzero(fenced[1:] != fenced[:-1])  # a term starts or ends before these bytes
    between = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    between = np.unique(between[inside[between - 1] & inside[between]])  # one text ends in a term, the next begins with one
    edges = np.insert(edges, np.repeat(np.searchsorted(edges, between), 2), np.repeat(between, 2))
    row = np.repeat(np.arange(len(text)), np.diff(np.searchsorted(edges[::2], bounds)))
    offsets = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])])
    letters = _LOWER[data[inside]]
    del fenced, inside, edges
    found = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), row


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
    return key[at], np.diff(np.append(at, len(key)))


def _lists(term: pa.Array, group: np.ndarray, layers: list[np.ndarray], n_groups: int) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    """A list for each layer (places of terms, in order of their groups) and group that has terms in it; the lists' groups and layers."""
    sizes = np.concatenate([np.bincount(group[x], minlength=n_groups) for x in layers] or [np.zeros(0, np.int64)])
    there = np.flatnonzero(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes[there])])
    places = np.concatenate(layers or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), term.take(pa.array(places))), there % n_groups, there // n_groups


def _tagged(words: pa.Array, code: np.ndarray, lang: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(words.take(pa.array(code)), lang, pa.scalar(_MARK, pa.large_string())).cast(pa.string())


def _document_layers(batches: Iterator[pa.RecordBatch], min_docs: int, piece_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Reads (lang, text); for k up to ``min_docs``, the tagged terms that k or more of a piece's documents of a language have."""
    for lang, text in _pieces(batches, piece_bytes):
        words, code, row = _terms(text)
        names = lang.dictionary_encode()
        row, code = np.divmod(_runs(row * len(words) + code)[0], max(len(words), 1))  # each term of a document once
        key, n_docs = _runs(names.indices.to_numpy().astype(np.int64)[row] * len(words) + code)
        group, code = np.divmod(key, max(len(words), 1))
        layers = [np.flatnonzero(n_docs >= k) for k in range(1, min(min_docs, int(n_docs.max(initial=0))) + 1)]
        lists, _, _ = _lists(_tagged(words, code, names.dictionary.take(pa.array(group))), group, layers, len(names.dictionary))
        yield pa.RecordBatch.from_arrays([lists], ["terms"])


def _count_digits(batches: Iterator[pa.RecordBatch], piece_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Reads (lang, source, text); for each binary digit, the tagged terms whose count in a piece and group has it."""
    for lang, source, text in _pieces(batches, piece_bytes):
        words, code, row = _terms(text)
        langs, sources = lang.dictionary_encode(), source.dictionary_encode()
        pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        pairs, of = np.unique(pair, return_inverse=True)
        key, n = _runs(of[row] * len(words) + code)
        group, code = np.divmod(key, max(len(words), 1))
        layers = [np.flatnonzero((n >> k) & 1) for k in range(int(n.max(initial=0)).bit_length())]
        lang_of, source_of = np.divmod(pairs, len(sources.dictionary))
        lists, at, digit = _lists(_tagged(words, code, langs.dictionary.take(pa.array(lang_of[group]))), group, layers, len(pairs))
        yield pa.RecordBatch.from_arrays([sources.dictionary.take(pa.array(source_of[at])).cast(pa.string()),
                                          pa.array(np.left_shift(np.int64(1), digit.astype(np.int64))), lists], ["source", "weight", "terms"])


def document_layers(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(terms): rows among which each tagged term stands as often as documents of its language have it, or ``min_docs`` times or more if they are as many."""
    base = docs.select(*[text_or_empty(c).cast("string").alias(c) for c in ("lang", "text")])
    return map_texts(base, functools.partial(_document_layers, min_docs=min_docs), "terms array<string>")


def count_digits(docs: DataFrame) -> DataFrame:
    """(source, weight, terms): rows whose weights add up, for each source and tagged term, to its occurrences there."""
    base = docs.select(*[text_or_empty(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return map_texts(base, _count_digits, "source string, weight long, terms array<string>")


def source_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms (index, lang, term), and their counts (source, index, count) where they are not 0."""
    spark = docs.sparkSession
    vectorizer = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=MAX_VOCABULARY, binary=True)
    model = vectorizer.fit(document_layers(docs, min_docs))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/audit-vocabulary-{uuid.uuid4().hex}"
    model.save(path)  # its terms become a table without passing through Python
    word = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "word"))
    at = F.instr("word", _MARK)
    kept = materialise(word.select("index", F.substr("word", at + 1).alias("lang"),
                                   F.substr("word", F.lit(1), at - 1).alias("term")), "audit-terms")
    vectors = model.transform(count_digits(docs))
    entries = vectors.select("source", "weight", F.explode(F.unwrap_udt("vector")["indices"]).alias("index"))
    counts = entries.groupBy("source", "index").agg(F.sum("weight").alias("count"))
    return kept, counts


def smoothed(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * vocabulary)), exactly; null without a vocabulary."""
    whole = total + 2 * vocabulary
    short = F.call_function("div", SCALE * (count + 2).cast("long"), whole.cast("long"))  # products up to 9 * 10^18 are longs
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), whole.cast("decimal(20,0)"))
    return F.when((whole > 0) & (count < 9 * SCALE - 2), short + 1).when(whole > 0, share + 1)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs up to SCALE + 1."""
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), p + q)


def _sums_of_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (index, lang, source, p, z) sorted by index, source; adds up the shared terms' part of each pair."""
    names: dict[tuple[str, str], int] = {}
    groups: list[tuple[str, str]] = []
    sums: dict[tuple[int, int], int] = {}

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def add(index: np.ndarray, group: np.ndarray, p: np.ndarray, z: np.ndarray) -> None:
        for step in range(1, len(index)):  # each row with the one ``step`` rows on, while some share their term
            a = np.flatnonzero(index[:-step] == index[step:])
            if not len(a):
                break
            b = a + step
            part = f(p[a], p[b]) - f(p[a], z[b]) - f(z[a], p[b]) + f(z[a], z[b])
            pairs, at = np.unique(group[a] * len(groups) + group[b], return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, part)
            for k, v in zip(pairs.tolist(), total.tolist()):
                pair = divmod(k, len(groups))
                sums[pair] = sums.get(pair, 0) + v

    def told() -> pa.RecordBatch:
        rows = [(*groups[a], groups[b][1], v) for (a, b), v in sums.items()]
        sums.clear()
        cols = zip(*rows) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string()] * 3 + [pa.int64()])],
                                          ["lang", "source", "item", "shared"])

    waiting = [np.zeros(0, np.int64)] * 4  # rows of the last term, of which more may come
    for b in batches:
        langs, sources = b.column(1).dictionary_encode(), b.column(2).dictionary_encode()
        pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        pairs, of = np.unique(pair, return_inverse=True)
        keys = [(langs.dictionary[x // len(sources.dictionary)].as_py(), sources.dictionary[x % len(sources.dictionary)].as_py())
                for x in pairs.tolist()]
        for k in keys:
            if k not in names:
                names[k] = len(groups)
                groups.append(k)
        new = [b.column(0).to_numpy().astype(np.int64), np.array([names[k] for k in keys], np.int64)[of],
               b.column(3).to_numpy(), b.column(4).to_numpy()]
        rows = [np.concatenate(x) for x in zip(waiting, new)]
        if not len(rows[0]):
            continue
        other = np.flatnonzero(rows[0] != rows[0][-1])
        last = int(other[-1]) + 1 if len(other) else 0
        add(*(x[:last] for x in rows))
        waiting = [x[last:] for x in rows]
        if len(sums) >= _FLUSH:
            yield told()
    add(*waiting)
    yield told()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's divergence from every other one, and its ``top`` telling terms."""
    kept, counts = source_counts(docs, min_docs)
    groups = docs.select(text_or_empty("lang").cast("string").alias("lang"),
                         text_or_empty("source").cast("string").alias("source")).distinct()
    found = counts.join(kept.select("index", "lang"), "index")
    found = materialise(found.withColumn("lang_count", F.sum("count").over(Window.partitionBy("index"))), "audit-counts")
    totals = found.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    groups = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "n_terms"])
    groups = groups.withColumn("z", smoothed(F.lit(0), F.col("total"), F.col("n_terms")))
    groups = groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    groups = materialise(groups, "audit-groups")

    found = found.join(groups, ["lang", "source"]).select("index", "lang", "source", "z",
                         smoothed(F.col("count"), F.col("total"), F.col("n_terms")).alias("p"),
                         smoothed(F.col("lang_count"), F.col("lang_total"), F.col("n_terms")).alias("q"))
    found = materialise(found, "audit-shares")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    ranked = by_value.orderBy(F.desc("value"), F.asc("item"))
    told = found.filter("p > q").select("index", "lang", "source", divergence(F.col("p"), F.col("q")).alias("value"))
    told = told.withColumn("rank", F.rank().over(by_value)).filter(F.col("rank") <= top)  # with all that equal the last of them
    told = told.join(kept.select("index", F.col("term").alias("item")), "index").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    told = told.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    of_p = found.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("n"))
    alone = of_p.join(other, "lang").filter("source != item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("n") * (divergence(F.col("p"), F.col("other_z")) - divergence(F.col("z"), F.col("other_z")))).alias("alone"))
    rows = found.select("index", "lang", "source", "p", "z").repartition("index").sortWithinPartitions("index", "source")
    shared = rows.mapInArrow(_sums_of_shared, "lang string, source string, item string, shared long")
    shared = shared.groupBy("lang", "source", "item").agg(F.sum("shared").alias("shared"))
    turned = lambda df, value: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), value)
    key = ["lang", "source", "item"]
    base = F.coalesce(F.col("n_terms") * divergence(F.col("z"), F.col("other_z")), F.lit(0))
    parts = groups.join(other, "lang").filter("source != item").select(*key, base.alias("value"))
    for part, name in ((alone, "alone"), (turned(alone, "alone"), "alone"), (shared, "shared"), (turned(shared, "shared"), "shared")):
        parts = parts.unionByName(part.select(*key, F.col(name).alias("value")))
    pairs = parts.groupBy(*key).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(told)
