"""Spelling variants: words one edit apart, grouped under their common form.

Words are counted over all documents.  A word's letters are counted into a vector; one
inserted or deleted letter moves it by 1 in L1 distance, one replaced letter by 2.  So the
near words of one of length L are found by range searches in two k-d trees: radius 2 among
length L, radius 1 among length L + 1.  Boxes further away than the radius are pruned, and
what is left is verified letter by letter.

A length with many words is first cut into cells by the top of its k-d tree, fitted on a
sample of at most about ``sample`` words of that length (the planes only steer the work: every
word is indexed, in the one cell that holds its vector).  A word also goes, as a query, to
the cells whose box lies within the radius; of two cells of one length only the later one
compares them.  No plane can part words of the same letters, so a cell that stays too large
is dealt by hash into several, each of which gets the queries.  A task walks its sorted
cells: it builds the k-d tree of one cell's words and streams the queries by.

The form of a word is its commonest near word, if that is ``ratio`` times as common; forms are
followed to the last by pointer doubling.  Along a chain the counts rise by ``ratio``, so there
is no cycle and few rounds.

Defined cases: a null text has no words; a null doc_id counts as an empty string in the
checksum; repeated rows count each; ties go to the smallest word; an empty table gives no
rows; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segcast.llm.common import materialise, text_or_empty
from segcast.llm.dedup import ascii_lower

MIN_LENGTH, MIN_COUNT, RATIO, DELETE_EVERY = 7, 2, 10, 31
CELL_WORDS = 16_384
SAMPLE_WORDS = 8_192
LEAF = 48
N_LETTERS = 90
MAX_ROUNDS = 64
_CANDIDATES, _QUERIES = 1 << 20, 1024
_FAR = 1 << 30
_PLACE = np.zeros(256, np.int64)
_PLACE[97:123], _PLACE[0xC0:0x100] = np.arange(26), np.arange(26, N_LETTERS)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """(word, n) of the words of ``docs``; some occurrences, by checksum, lack one letter."""
    runs = F.split(ascii_lower(text_or_empty().cast("string")), "[^A-Za-z" + chr(0xC0) + "-" + chr(0xFF) + "]+")
    base = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    base = base.filter(F.length("run") >= min_length)
    base = base.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = base.select(F.when(F.col("h") % delete_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letters; all are within Latin-1."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(rows: np.ndarray) -> np.ndarray:
    """Letter counts of rows of letters."""
    n = len(rows)
    cells = np.arange(n)[:, None] * N_LETTERS + _PLACE[rows]
    return np.bincount(cells.ravel(), minlength=n * N_LETTERS).reshape(n, N_LETTERS).astype(np.int32)


class Tree:
    """A k-d tree over letter counts: each node cuts one letter's count, as evenly as it can.

    A node knows the bounds that its box already has along the letter it cuts, so the L1
    distance to a child's box follows from the distance to its own.  ``order`` has the points
    leaf by leaf.
    """

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.order, nodes = np.arange(len(points)), []
        todo = [(0, len(points), {}, None)]  # rows from, to, bounds by letter, the parent's node and side
        while todo:
            start, end, box, parent = todo.pop()
            if parent is not None:
                nodes[parent[0]][4 + parent[1]] = len(nodes)
            rows = self.order[start:end]
            cut = self._cut(points[rows]) if end - start > leaf else None
            if cut is None:
                nodes.append([-1, 0, 0, 0, -1, -1, start, end])
                continue
            letter, count = cut
            low, high = box.get(letter, (0, _FAR))
            under = points[rows, letter] < count
            self.order[start:end] = np.concatenate([rows[under], rows[~under]])
            middle = start + int(under.sum())
            me = len(nodes)
            nodes.append([letter, count, low, high, 0, 0, start, end])
            todo.append((middle, end, {**box, letter: (count, high)}, (me, 1)))
            todo.append((start, middle, {**box, letter: (low, count - 1)}, (me, 0)))
        table = np.array(nodes, np.int64).reshape(-1, 8)
        self.letter, self.count, self.low, self.high = (table[:, i].copy() for i in range(4))
        self.child, self.start, self.end = table[:, 4:6].copy(), table[:, 6].copy(), table[:, 7].copy()
        self.leaves = np.flatnonzero(self.letter < 0)
        self.leaf_no = np.full(len(table), -1)
        self.leaf_no[self.leaves] = np.arange(len(self.leaves))

    @staticmethod
    def _cut(points: np.ndarray) -> tuple[int, int] | None:
        """The letter and count whose cut is the most even; null if all points are equal."""
        best, found = 0, None
        for count in range(1, int(points.max()) + 1):
            under = (points < count).sum(0)
            even = np.minimum(under, len(points) - under)
            letter = int(even.argmax())
            if even[letter] > best:
                best, found = int(even[letter]), (letter, count)
            if 2 * best >= len(points) - 1:
                break
        return found

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf number) for every leaf whose box is at most ``radius`` away, level by level."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        room = np.full(len(queries), radius, np.int64)
        out_query, out_leaf = [], []
        while len(query):
            ends = self.letter[node] < 0
            out_query.append(query[ends])
            out_leaf.append(self.leaf_no[node[ends]])
            query, node, room = query[~ends], node[~ends], room[~ends]
            v, low, high, count = queries[query, self.letter[node]], self.low[node], self.high[node], self.count[node]
            was = np.maximum(np.maximum(low - v, v - high), 0)
            left = room + was - np.maximum(np.maximum(low - v, v - count + 1), 0)
            right = room + was - np.maximum(np.maximum(count - v, v - high), 0)
            to_left, to_right = left >= 0, right >= 0
            child = self.child[node]
            query = np.concatenate([query[to_left], query[to_right]])
            node = np.concatenate([child[to_left, 0], child[to_right, 1]])
            room = np.concatenate([left[to_left], right[to_right]])
        return np.concatenate(out_query), np.concatenate(out_leaf)


class Index:
    """The words of one cell, all of one length, in the order of their k-d tree's leaves."""

    def __init__(self, words: list[str], counts: np.ndarray, leaf: int = LEAF) -> None:
        rows = letters(words)
        points = vectors(rows)
        self.tree = Tree(points, leaf)
        order = self.tree.order
        self.rows, self.points, self.counts = rows[order], points[order], counts[order]
        self.words = np.array(words, object)[order]
        self.letters = np.argsort(-self.points.sum(0), kind="stable")[:64]  # the commonest; the others don't prune
        self.marks = self.unary(self.points)

    def unary(self, points: np.ndarray) -> list[np.ndarray]:
        """Counts of the 64 letters, 0 to 2 in two bits each: bits that differ are at most the L1 distance."""
        out = []
        for at in (0, 32):
            marks = np.zeros(len(points), np.uint64)
            for i, letter in enumerate(self.letters[at:at + 32].tolist()):
                for bit, least in ((0, 1), (1, 2)):
                    marks |= (points[:, letter] >= least).astype(np.uint64) << np.uint64(2 * i + bit)
            out.append(marks)
        return out

    def near(self, rows: np.ndarray, points: np.ndarray, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs one edit apart; the queries are as long as the words or one letter shorter.

        With ``own`` the queries are the index's words, and each pair comes once.
        """
        radius = 2 if rows.shape[1] == self.rows.shape[1] else 1
        for first in range(0, len(rows), _QUERIES):
            some = slice(first, first + _QUERIES)
            marks = self.unary(points[some])
            query, leaf = self.tree.within(points[some], radius)
            leaf = self.tree.leaves[leaf]
            start, sizes = self.tree.start[leaf], self.tree.end[leaf] - self.tree.start[leaf]
            block = np.cumsum(sizes) // _CANDIDATES
            for k in range(int(block[-1]) + 1 if len(block) else 0):
                of = block == k
                n, ends = sizes[of], np.cumsum(sizes[of])
                if not len(n):
                    continue
                q = np.repeat(query[of], n)
                w = np.arange(ends[-1]) + np.repeat(start[of] - ends + n, n)
                bits = np.bitwise_count(marks[0][q] ^ self.marks[0][w]) + np.bitwise_count(marks[1][q] ^ self.marks[1][w])
                ok = bits <= radius
                if own:
                    ok &= w > q + first
                q, w = q[ok] + first, w[ok]
                ok = self.one_edit(rows[q], self.rows[w])
                yield q[ok], w[ok]

    @staticmethod
    def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows of ``a`` and ``b``, which are as long or one letter longer, are one edit apart."""
        if a.shape[1] == b.shape[1]:
            return (a != b).sum(1) == 1
        head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
        tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
        return head + tail >= a.shape[1]


class Cells:
    """How the words of each length are dealt: top trees of the lengths with many words, and hash parts of large cells."""

    def __init__(self, trees: dict[int, Tree], parts: dict[tuple[int, int], int] | None = None) -> None:
        self.trees, self.first = trees, {}
        for length, tree in trees.items():
            n = [(parts or {}).get((length, c), 1) for c in range(len(tree.leaves))]
            self.first[length] = np.cumsum([0, *n])  # number of the first part of each cell

    def count(self) -> int:
        return sum(int(x[-1]) for x in self.first.values())

    def home(self, length: int, points: np.ndarray) -> np.ndarray:
        """The cell of each word."""
        if length not in self.trees:
            return np.zeros(len(points), np.int64)
        query, leaf = self.trees[length].within(points, 0)
        cell = np.empty(len(points), np.int64)
        cell[query] = leaf
        return cell

    def part(self, length: int, cell: np.ndarray, words: list[str]) -> np.ndarray:
        """The numbered part of its cell in which each word is indexed."""
        if length not in self.trees:
            return cell
        first = self.first[length]
        n = first[cell + 1] - first[cell]
        h = np.array([zlib.crc32(w.encode("latin-1")) for w in words], np.int64) if n.max(initial=1) > 1 else np.zeros(len(words), np.int64)
        return first[cell] + h % n

    def around(self, length: int, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, part) for every part whose cell is within ``radius``."""
        if length not in self.trees:
            return np.arange(len(points)), np.zeros(len(points), np.int64)
        query, leaf = self.trees[length].within(points, radius)
        first = self.first[length]
        n = first[leaf + 1] - first[leaf]
        ends = np.cumsum(n)
        parts = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[leaf] - ends + n, n)
        return np.repeat(query, n), parts


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(length, words, counts) of a batch (word, n), in slices whose letters take little memory."""
    words, counts = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
    sizes = np.array([len(w) for w in words], np.int64)
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        step = max(1, min(4096, (1 << 23) // length))
        for i in range(0, len(at), step):
            some = at[i:i + step]
            yield length, words[some].tolist(), counts[some]


def fit_cells(words: DataFrame, cell_words: int = CELL_WORDS, sample: int = SAMPLE_WORDS) -> Cells:
    """Top trees of the lengths with more than ``cell_words`` words, and parts of cells that hold over twice that.

    To the driver come one row per such length, the sample, and one row per such cell: fewer
    rows than ``words`` has over ``cell_words``, besides the sample.
    """
    by_length = words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    many = {r["length"]: r["n"] for r in by_length.filter(F.col("n") > cell_words).collect()}
    if not many:
        return Cells({})
    share = F.lit(0)
    for length, n in many.items():
        share = F.when(F.length("word") == length, F.lit(min(1.0, sample / n))).otherwise(share)
    lot = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn: dict[int, list[str]] = {}
    for r in words.filter(lot < share).select("word").orderBy("word").collect():
        drawn.setdefault(len(r["word"]), []).append(r["word"])
    trees = {k: Tree(vectors(letters(drawn[k])), max(1, cell_words * len(drawn[k]) // n)) for k, n in many.items() if k in drawn}
    cells = Cells(trees)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, some, _ in _by_length(b):
                home = cells.home(length, vectors(letters(some)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(home), length)), pa.array(home)], ["length", "cell"])

    large = words.filter(F.length("word").isin(list(trees))).mapInArrow(homes, "length long, cell long")
    large = large.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * cell_words)
    return Cells(trees, {(r["length"], r["cell"]): -(-r["n"] // cell_words) for r in large.collect()})


_DEALT = "length long, part long, role int, own_length long, word string, n long"
_PAIRS = "word string, n long, near string, near_n long"


def _batch(cols: list, kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in schema.split(", ")])


def deal(words: DataFrame, cells: Cells) -> DataFrame:
    """Every word in its cell (role 0), and as a query (role 1) in the other cells that may hold near words."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, some, counts in _by_length(b):
                points = vectors(letters(some))
                own = cells.part(length, cells.home(length, points), some)
                word, part = cells.around(length, points, 2)
                later = part > own[word]
                longer, next_part = cells.around(length + 1, points, 1)
                rows = [(length, np.arange(len(some)), own, 0), (length, word[later], part[later], 1), (length + 1, longer, next_part, 1)]
                for at_length, at, to, role in rows:
                    yield _batch([np.full(len(at), at_length), to, np.full(len(at), role), np.full(len(at), length),
                                  [some[i] for i in at.tolist()], counts[at]], kinds, _DEALT)

    return words.mapInArrow(run, _DEALT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows of ``deal`` sorted by length, part, role and own length; returns the near pairs, each both ways."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    cell, words, counts, index = None, [], [], None

    def told(of: Index, names: np.ndarray, ns: np.ndarray, pairs) -> Iterator[pa.RecordBatch]:
        for q, w in pairs:
            if len(q):
                a, b, n, m = names[q], of.words[w], ns[q], of.counts[w]
                yield _batch([np.concatenate(x) for x in ((a, b), (n, m), (b, a), (m, n))], kinds, _PAIRS)

    def built() -> Iterator[pa.RecordBatch]:
        nonlocal index, words, counts
        if words:
            index = Index(words, np.concatenate(counts))
            words, counts = [], []
            yield from told(index, index.words, index.counts, index.near(index.rows, index.points, own=True))

    for b in batches:
        keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
        names, ns = np.array(b.column(4).to_pylist(), object), b.column(5).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            length, part, role, _ = keys[start].tolist()
            if (length, part) != cell:
                yield from built()
                cell, index = (length, part), None
            if role == 0:
                words += names[start:end].tolist()
                counts.append(ns[start:end])
                continue
            yield from built()
            if index is not None:  # else there are no words of this length
                rows = letters(names[start:end].tolist())
                yield from told(index, names[start:end], ns[start:end], index.near(rows, vectors(rows)))
    yield from built()


def near_words(words: DataFrame, cell_words: int = CELL_WORDS, sample: int = SAMPLE_WORDS) -> DataFrame:
    """(word, n, near, near_n) for all words of ``words`` (word, n; stored) that are one edit apart, both ways."""
    cells = fit_cells(words, cell_words, sample)
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells.count())
    dealt = deal(words, cells).repartition(tasks, "length", "part").sortWithinPartitions("length", "part", "role", "own_length")
    return dealt.mapInArrow(_walk, _PAIRS)


def follow(links: DataFrame) -> DataFrame:
    """(word, root) for ``links`` (word, form) without cycles: the last form that is reached."""
    links = materialise(links.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MAX_ROUNDS):
        on = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        links = materialise(links.join(on, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if links.filter("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")
    raise RuntimeError(f"forms did not settle in {MAX_ROUNDS} rounds")


def group_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                   delete_every: int = DELETE_EVERY, cell_words: int = CELL_WORDS, sample: int = SAMPLE_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs``."""
    words = materialise(word_counts(docs, min_length, min_count, delete_every), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(words, cell_words, sample).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"),
        F.when(common, -F.col("best.less")).alias("form_n"))
    formed = materialise(formed, "spelling-forms")
    roots = follow(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
