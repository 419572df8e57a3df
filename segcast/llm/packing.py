"""Packing tokenised documents into sequences of at most ``capacity`` tokens.

Documents are tokenised and cut into pieces once; only the pieces' lengths are
packed.  The plan works on the counts per length, at most ``capacity`` numbers
whatever the corpus, so it is made in one place:

1. exact-complement hashing, longest length first: the gap left by a length is
   looked up among single lengths, sums of two and sums of three lengths; a
   combination that fills the gap exactly is used as often as the counts allow;
2. best-fit decreasing for what remains: each length goes to the open sequences
   with the smallest gap that holds it, a whole group of equal sequences at a time.

The plan lists runs: copies n of one length go to sequences s .. s+n-1 at one
offset.  Each step uses up a length or a group of open sequences, so the plan's
size depends on ``capacity`` alone; a task looks up a piece by its length and its
rank among the pieces of that length.  Ranks are counted by (length, hash part),
so a length held by a third of all pieces is still spread over many tasks.

Defined cases: a null text is an empty document of one token, the end token; longer
documents are cut into full pieces and a rest; repeated rows are packed as
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segcast.llm.common import map_texts, materialise

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 1_400_000
RANK_PARTS = 256
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Words(dict):
    """Ids by word; a word that ends in a comma or full stop is put together from its two parts."""

    def __missing__(self, word: str) -> bytes:
        return self[word[:-1]] + self[word[-1]]


def _latin(text: str) -> bool:
    """Only characters up to \\xff, whose lower case is the same everywhere."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class Encoder:
    """Token ids of texts as arrays of unsigned 32-bit numbers.

    The vocabulary's tokens never reach over a blank or a newline, so texts are
    encoded word by word, and words seen before come from a bounded cache.  Its
    tokenizer lower-cases, so a Latin text may be lower-cased before it is cut into
    words, unless it may hold a special token; and it parts letters and digits from
    what follows, so "word," is the ids of "word" and of ",".
    """

    def __init__(self, vocabulary: str, cached_words: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.limit, self.known = cached_words, _Words()
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn(self, words: list[str], at_once: int = 256) -> None:
        """Words of letters alone are one run of tokens each, so many are encoded as one line and cut at word ends."""
        runs = [w for w in words if w.isalpha()]
        single = [w for w in words if not w.isalpha()]
        lines = [runs[i:i + at_once] for i in range(0, len(runs), at_once)]
        for k in range(0, len(lines), 16):
            some = lines[k:k + 16]
            for line, e in zip(some, self.tokenizer.encode_batch([" ".join(x) for x in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
                if len(ends) != len(line):  # a letter the tokenizer does not count as one
                    single += line
                    continue
                data = ids.tobytes()
                self.known.update(zip(line, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        for i in range(0, len(single), 4096):
            some = single[i:i + 4096]
            for word, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                self.known[word] = struct.pack(f"<{len(e)}I", *e.ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        plain = [t.lower() if "<|" not in t and _latin(t) else t for t in texts]
        split = pc.split_pattern(pa.array([t.replace("\n", " ") for t in plain], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > self.limit:
            self.known.clear()
        new = set(words).difference(self.known)
        ended = [w for w in new if w[-1:] in (",", ".") and w[-2:-1].isalnum() and w[-2] <= "\xff"]
        new.difference_update(ended)
        new.update(w[:-1] for w in ended)
        new.update(",.")
        self._learn(list(new.difference(self.known)))

        of_word = list(map(self.known.__getitem__, words))
        lengths = np.fromiter(map(len, of_word), np.int64, len(of_word)) // 4
        starts = np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        n = lengths[at]
        ends = np.cumsum(n)
        tokens = np.frombuffer(b"".join(of_word), "<u4")[np.arange(ends[-1]) + np.repeat(starts[at] - ends + n, n)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return [tokens[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    return Encoder(vocabulary)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut at ``capacity`` tokens."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or vocabulary_path()).encode
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(pc.fill_null(b.column(1), "").to_pylist())):
                ids = np.concatenate([ids, end])
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(base, run, PIECE_SCHEMA, batch_bytes=8 << 20)


class _Plan:
    """Counts left per length, and the runs (length, rank, copies, first sequence, offset) made so far.

    ``single[x]`` says whether length x is left; ``pairs[s]`` counts the ordered pairs
    of lengths left that sum to s.  Triples are found through a length and a pair sum.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = {k: n for k, n in counts.items() if n}
        self.next_rank = dict.fromkeys(self.left, 0)
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self.single = np.zeros(capacity + 1, bool)
        self.single[list(self.left)] = True
        self.pairs = np.rint(np.convolve(self.single, self.single.astype(float)))[: capacity + 1].astype(np.int64)

    def put(self, length: int, copies: int, first: int, offset: int) -> None:
        self.runs.append((length, self.next_rank[length], copies, first, offset))
        self.next_rank[length] += copies
        self.left[length] -= copies
        if not self.left[length]:
            del self.left[length]
            reach = self.single[: self.capacity + 1 - length]
            self.pairs[length:] -= 2 * reach.astype(np.int64)
            if 2 * length <= self.capacity:
                self.pairs[2 * length] += 1  # the pair (length, length) was counted once
            self.single[length] = False

    def open(self, lengths: list[int]) -> None:
        """As many sequences of these lengths as the counts allow."""
        copies = min(self.left[x] // lengths.count(x) for x in set(lengths))
        offset = 0
        for x in lengths:
            self.put(x, copies, self.sequences, offset)
            offset += x
        self.sequences += copies

    def has(self, lengths: list[int]) -> bool:
        return all(self.left.get(x, 0) >= lengths.count(x) for x in lengths)

    def two(self, total: int) -> Iterator[list[int]]:
        """Pairs of lengths left that sum to ``total``, the longest length first."""
        half = self.single[: total // 2 + 1] & self.single[total: total - total // 2 - 1: -1] if total > 1 else []
        return ([total - y, y] for y in np.flatnonzero(half).tolist())

    def complement(self, length: int) -> list[int] | None:
        """One, two or three lengths that fill the gap beside ``length`` exactly, and are left beside it."""
        gap = self.capacity - length
        found = [[]] if gap == 0 else [[gap]] if self.single[gap] else []
        if found and self.has([length, *found[0]]):
            return found[0]
        if gap and self.pairs[gap]:
            for combo in self.two(gap):
                if self.has([length, *combo]):
                    return combo
        for x in np.flatnonzero(self.single[:gap] & (self.pairs[gap:0:-1] > 0))[::-1].tolist():
            for combo in self.two(gap - x):
                if self.has([length, x, *combo]):
                    return [x, *combo]
        return None


def _exact(plan: _Plan) -> None:
    """Fill gaps exactly, from the longest length down."""
    for length in sorted(plan.left, reverse=True):
        while plan.left.get(length) and (combo := plan.complement(length)) is not None:
            plan.open([length, *combo])


def _best_fit(plan: _Plan) -> None:
    """Place what is left, longest first, each into the smallest gap that holds it."""
    groups: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, copies) of equal open sequences
    gaps: list[int] = []

    def add(gap: int, first: int, copies: int) -> None:
        if gap and copies:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((first, copies))

    for length in sorted(plan.left, reverse=True):
        while plan.left.get(length):
            at = bisect_left(gaps, length)
            if at == len(gaps):  # none holds it: new sequences of this length alone, then one of the rest
                lengths = [length] * min(plan.capacity // length, plan.left[length])
                first = plan.sequences
                plan.open(lengths)
                add(plan.capacity - sum(lengths), first, plan.sequences - first)
                continue
            gap = gaps[at]
            first, copies = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            used = min(copies, plan.left[length])
            plan.put(length, used, first, plan.capacity - gap)
            add(gap - length, first, used)
            add(gap, first + used, copies - used)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, copies, first sequence, offset) placing all pieces, and the number of sequences."""
    plan = _Plan(counts, capacity)
    _exact(plan)
    _best_fit(plan)
    return plan.runs, plan.sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_parts: int = RANK_PARTS) -> DataFrame:
    """``pieces`` (see token_pieces) with sequence_id and offset."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(rank_parts)).cast("int")
    pieces = materialise(pieces.withColumn("part", part), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-ranks")
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows

    runs, _ = plan_sequences(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    in_part = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(in_part) - 1).join(offsets.drop("n"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    wide = max(counts.values(), default=1)
    keys = table[:, 0] * wide + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            run = table[np.searchsorted(keys, length * wide + rank, side="right") - 1] if b.num_rows else table[:0]
            out = [*b.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place in a sequence."""
    return pack(token_pieces(docs, capacity, vocabulary, end_id), capacity)
