"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, long lines cut after every ``piece_words`` words.  Each paragraph's
digest (repeats are numbered) is added to one cell in each of three parts of a sketch;
a cell keeps a count, the XOR of its digests and the XOR of their checks.  Subtracting the
sketches of two versions cancels what they share.  Peeling then recovers the rest: a cell
with count +1 or -1 and a matching check holds one digest, which is taken out of its other
cells, and so on.  If cells remain, the difference was too large for the sketch; both
sketches are made anew with twice the cells, until peeling succeeds.  The likeness of two
versions is twice their shared paragraphs over all paragraphs of both.

Sketches of many documents are peeled together, as arrays with a block of cells each.

A document is compared with its edited text and with the next document by descending
doc_id.  Documents are dealt into id ranges with bounds found once, the first row of each
range is also sent to the range before it, and each task walks its sorted range, so the
texts are shuffled once and no window spans the table.

Defined cases: a null text counts as empty; two empty texts are alike (1.0); null doc_ids
come last; rows repeating a doc_id follow one another by text; in a table of one row the
next document is the row itself; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segcast.llm.common import map_texts, text_or_empty

PIECE_WORDS = 8
CELLS = 24
ROWS_PER_RANGE = 1024
MAX_RANGES = 100_000
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_U = np.uint64


def paragraphs(text: str, piece_words: int = PIECE_WORDS) -> list[str]:
    """Lines, cut after every ``piece_words`` words."""
    lines = [line.split() for line in text.split("\n")]
    return [" ".join(words[i:i + piece_words]) for words in lines for i in range(0, len(words), piece_words)]


def paragraph_digests(text: str, piece_words: int = PIECE_WORDS) -> np.ndarray:
    """Digest of each paragraph; equal ones differ by their number, so the digests are a set."""
    seen: dict[str, int] = {}
    out = []
    for piece in paragraphs(text, piece_words):
        n = seen[piece] = seen.get(piece, -1) + 1
        out.append(xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), n))
    return np.array(out, _U)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 9) >> _U(32)).astype(np.uint32)


def _places(keys: np.ndarray, base: np.ndarray, cells: np.ndarray, attempt: int) -> np.ndarray:
    """The three cells of each key in the block that starts at ``base`` and has ``cells`` cells."""
    third = (cells // 3).astype(_U)
    return np.stack([base + (p * third + _mix(keys, 3 * attempt + p + 1) % third).astype(np.int64) for p in range(3)])


def _fill(total: int, places: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count, key, check = np.zeros(total, np.int64), np.zeros(total, _U), np.zeros(total, np.uint32)
    checks = _check(keys)
    for at in places:
        np.add.at(count, at, sign)
        np.bitwise_xor.at(key, at, keys)
        np.bitwise_xor.at(check, at, checks)
    return count, key, check


def sketches(digests: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """A row of cells (count, digest XOR, check XOR) for each set of digests."""
    n, keys = len(digests), np.concatenate([np.zeros(0, _U), *digests])
    doc = np.repeat(np.arange(n), [len(d) for d in digests])
    places = _places(keys, doc * cells, np.full(len(keys), cells), 0)
    table = np.zeros(n * cells, [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
    table["count"], table["key"], table["check"] = _fill(n * cells, places, keys, np.ones(len(keys), np.int64))
    return table.reshape(n, cells)


def fingerprint(digests: np.ndarray, cells: int = CELLS) -> str:
    """The sketch of one document in hexadecimal."""
    return sketches([digests], cells)[0].tobytes().hex()


def _peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, block: np.ndarray, base: np.ndarray,
          cells: np.ndarray, attempt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recovered digests with their block and side (1 left, -1 right), and which blocks were peeled to the end.

    ``block`` has the block of each cell.  A cell is pure only if it is one of its digest's own places;
    should one pass by chance, the rounds are bounded and its block is taken for not peeled.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))]
    for _ in range(int(cells.max(initial=0)) + 1):
        pure = np.flatnonzero((np.abs(count) == 1) & (_check(key) == check))
        own = _places(key[pure], base[block[pure]], cells[block[pure]], attempt)
        pure = pure[(own == pure).any(axis=0)]
        if not len(pure):
            break
        pure = pure[np.lexsort((key[pure], block[pure]))]  # a digest may stand alone in several of its cells
        again = (key[pure][1:] == key[pure][:-1]) & (block[pure][1:] == block[pure][:-1])
        pure = pure[np.concatenate([[True], ~again])]
        keys, sign, blocks = key[pure], count[pure], block[pure]
        for at in _places(keys, base[blocks], cells[blocks], attempt):
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(key, at, keys)
            np.bitwise_xor.at(check, at, _check(keys))
        found.append((blocks, keys, sign))
    left = np.zeros(len(base), bool)
    left[block[(count != 0) | (key != 0) | (check != 0)]] = True
    return *(np.concatenate(x) for x in zip(*found)), ~left


def recover(left: list[np.ndarray], right: list[np.ndarray], sketched: tuple[np.ndarray, np.ndarray] | None = None,
            cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, side) of every digest in which a left set differs from its right one; side 1 is the left.

    Their sketches are subtracted and peeled first; where that fails, larger ones are made.
    """
    first, second = sketched if sketched is not None else (sketches(left, cells), sketches(right, cells))
    cells = first.shape[1]
    out = [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))]
    todo, size, attempt = np.arange(len(left)), cells, 0
    count = (first["count"] - second["count"]).astype(np.int64).ravel()
    key, check = (first["key"] ^ second["key"]).ravel(), (first["check"] ^ second["check"]).ravel()
    while len(todo):
        base = np.arange(len(todo)) * size
        blocks, keys, sides, done = _peel(count, key, check, np.repeat(np.arange(len(todo)), size), base,
                            np.full(len(todo), size), attempt)
        whole = done[blocks]
        out.append((todo[blocks[whole]], keys[whole], sides[whole]))
        todo, size, attempt = todo[~done], size * 2, attempt + 1
        count = np.zeros(len(todo) * size, np.int64)
        key, check = np.zeros(len(count), _U), np.zeros(len(count), np.uint32)
        for side, sign in ((left, 1), (right, -1)):
            keys = np.concatenate([np.zeros(0, _U), *(side[i] for i in todo)])
            doc = np.repeat(np.arange(len(todo)), [len(side[i]) for i in todo])
            places = _places(keys, doc * size, np.full(len(keys), size), attempt)
            c, k, h = _fill(len(count), places, keys, np.full(len(keys), sign))
            count, key, check = count + c, key ^ k, check ^ h
    return tuple(np.concatenate(x) for x in zip(*out))


def differences(left: list[np.ndarray], right: list[np.ndarray], sketched: tuple[np.ndarray, np.ndarray] | None = None,
                cells: int = CELLS) -> np.ndarray:
    """Number of recovered digests of each pair."""
    return np.bincount(recover(left, right, sketched, cells)[0], minlength=len(left))


def differing_paragraphs(text: str, other: str, piece_words: int = PIECE_WORDS, cells: int = CELLS) -> tuple[list[str], list[str]]:
    """The paragraphs that only ``text`` has and those that only ``other`` has, as their digests are recovered, in order."""
    own = [(paragraph_digests(t, piece_words), paragraphs(t, piece_words)) for t in (text, other)]
    _, keys, sides = recover([own[0][0]], [own[1][0]], cells=cells)
    of = [set(keys[sides == side].tolist()) for side in (1, -1)]
    return tuple([p for d, p in zip(digests.tolist(), pieces) if d in some] for (digests, pieces), some in zip(own, of))


def likeness(left: list[np.ndarray], right: list[np.ndarray], sketched: tuple[np.ndarray, np.ndarray] | None = None,
             cells: int = CELLS) -> np.ndarray:
    """Shared paragraphs, counted on both sides, over all paragraphs of both versions."""
    total = np.array([len(a) + len(b) for a, b in zip(left, right)], float)
    return np.where(total > 0, 1 - differences(left, right, sketched, cells) / np.maximum(total, 1), 1.0)


def edit(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much, or all, of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compared(rows: list[tuple], following: str, cells: int, piece_words: int) -> pa.RecordBatch:
    """Result rows of consecutive (doc_id, text); ``following`` is the text after the last."""
    texts = [r[1] for r in rows] + [following]
    edits = [edit(a, b) for a, b in zip(texts, texts[1:])]
    own, changed = ([paragraph_digests(t, piece_words) for t in x] for x in (texts, edits))
    mine, theirs = sketches(own, cells), sketches(changed, cells)
    near_edited = likeness(own[:-1], changed, (mine[:-1], theirs))
    near_next = likeness(own[:-1], own[1:], (mine[:-1], mine[1:]))
    hashes = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]
    cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array(hashes, pa.string()), pa.array([x.tobytes().hex() for x in mine[:-1]], pa.string()),
            pa.array([x.tobytes().hex() for x in theirs], pa.string()), pa.array(near_edited), pa.array(near_next)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])


def _walk(cells: int, piece_words: int, at_once: int = 256, chars_at_once: int = 2 << 20):
    """Reads (range, guest, doc_id, text) sorted by range, the guest last in its range.

    Rows wait for the text after them, some hundred at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, chars, current, closed = [], 0, None, False
        for b in batches:
            for place, guest, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if place != current:
                    current, closed = place, False
                if closed:
                    continue  # a copy of the guest row
                if waiting and (guest or len(waiting) >= at_once or chars >= chars_at_once):
                    yield _compared(waiting, text, cells, piece_words)
                    waiting, chars = [], 0
                if guest:
                    closed = True
                else:
                    waiting.append((doc_id, text))
                    chars += len(text)
    return run


def compare_versions(docs: DataFrame, cells: int = CELLS, piece_words: int = PIECE_WORDS,
                     rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per row of ``docs`` with its fingerprints and likenesses, see SCHEMA."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("at", F.col("id").cast("double"))
    n_ranges = max(1, min(MAX_RANGES, base.count() // rows_per_range))
    edges = base.select("at").stat.approxQuantile("at", [i / n_ranges for i in range(1, n_ranges)], 0.2 / n_ranges) if n_ranges > 1 else []
    splits = [float("-inf"), *(sorted(set(edges)) or [0.0]), float("inf")]  # any inner bound will do
    dealt = Bucketizer(splits=splits, inputCol="at", outputCol="range").transform(base).withColumn("hash", F.xxhash64("text"))

    # the first row of each range, by descending id and then by hash, also ends the range before it
    head = F.struct(F.col("id"), F.bitwise_not("hash").alias("turned"))
    heads = dealt.groupBy("range").agg(F.max(head).alias("head")).select("range", "head.*").collect()  # <= MAX_RANGES rows
    heads.sort(reverse=True)
    rows = [(h[0], heads[i - 1][0], h[1], ~h[2]) for i, h in enumerate(heads)]
    guests = F.broadcast(spark.createDataFrame(rows, "range double, before double, id long, hash long"))
    guest = dealt.join(guests, ["range", "id", "hash"]).select(F.col("before").alias("range"), F.lit(1).alias("guest"), "doc_id", "id", "hash", "text")
    both = dealt.select("range", F.lit(0).alias("guest"), "doc_id", "id", "hash", "text").unionByName(guest)
    both = both.repartitionByRange("range").sortWithinPartitions("range", "guest", F.desc("id"), "hash")
    return map_texts(both.select("range", "guest", "doc_id", "text"), _walk(cells, piece_words), SCHEMA)
