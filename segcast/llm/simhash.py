"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their
popcounts is its embedding.  Flipping one bit moves one coordinate by one, so the
Manhattan distance of two embeddings is a lower bound of the Hamming distance.

Range join on a grid: the coordinates are dealt into ``max_bits + 3`` groups.  Two
vectors within Manhattan distance ``max_bits`` agree on at least three groups, so
they share the cell of some three groups.  Every fingerprint goes to its cell in
each of these sub-grids, pairs inside a cell are filtered by the Manhattan bound,
and the survivors are verified by the exact bit distance.  The popcounts are kept
in unary code (0, 1, 2 as 00, 01, 11), which makes the Manhattan distance the bit
count of an XOR.

Skew: copies share a fingerprint and are folded first.  A cell with more than
``block_rows`` fingerprints is cut into hash blocks, and each pair of blocks is a
task of its own, so all pairs are compared yet no task holds more than two
blocks.  Only links that join two parts inside a task (at most rows - 1) are
emitted; components lose nothing by that.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; fewer words than ``shingle_words`` make one shingle of the whole sequence;
repeated rows share their component; a null doc_id never names a component
unless all its members are null; ``drop_near_copies`` keeps one row of each component,
found again by doc_id and text digest, whatever other rows share its doc_id or have none;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segcast.llm.common import keep_rows, map_texts, materialise, text_or_empty
from segcast.llm.components import connected_components
from segcast.llm.dedup import sha256

SHINGLE_WORDS = 3
MAX_BITS = 3
BLOCK_ROWS = 4096
SEED = 42
_LOW = 0x5555555555555555
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of one UTF-8 text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1:] - 1).tolist())
    counts, block = np.zeros(64, np.int64), 1 << 16
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)
    for i in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[i:i + block].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, digest: Column | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; with ``digest`` (of the text) also that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([simhash(t or b"", shingle_words) for t in texts], np.uint64).view(np.int64)
            rest = [(b.column(i), b.schema.names[i]) for i in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *[c for c, _ in rest]], ["doc_id", "fp", *[n for _, n in rest]])

    more = [] if digest is None else [digest.alias("digest")]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return map_texts(base, run, "doc_id long, fp long" + ", digest binary" * len(more))


def unary_popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding: popcount of each two-bit segment in unary code."""
    low, high = fp & np.uint64(_LOW), (fp >> np.uint64(1)) & np.uint64(_LOW)
    return (low | high) | ((low & high) << np.uint64(1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grids(max_bits: int) -> list[int]:
    """Bit masks of the sub-grids: every choice of three of the max_bits + 3 coordinate groups."""
    n = max_bits + 3
    groups = [sum(3 << (2 * s) for s in range(32) if s * n // 32 == g) for g in range(n)]
    return [_signed(sum(c)) for c in combinations(groups, 3)]


def _cells(fps: DataFrame, max_bits: int) -> DataFrame:
    low, high = F.col("fp").bitwiseAND(F.lit(_LOW)), F.shiftright("fp", 1).bitwiseAND(F.lit(_LOW))
    unary = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    cells = F.array(*[F.col("unary").bitwiseAND(F.lit(m)) for m in _grids(max_bits)])
    return fps.select("fp", unary.alias("unary")).select("fp", F.posexplode(cells).alias("grid", "cell"))


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Join the parts of each pair (a, b) in ``root``; the positions of the pairs that joined two parts."""
    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    used = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            used.append(n)
    while not np.array_equal(root, up := root[root]):
        root[:] = up
    return used


def _links_in(fp: np.ndarray, group_end: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of the same group (rows sorted by group); each joins two parts, none is lost to components.

    All pairs of a group are visited by rising distance of their rows.
    """
    unary, root = unary_popcounts(fp), np.arange(len(fp))
    left, right = [], []
    rows = np.arange(len(fp))
    step = 0
    while len(rows):
        step += 1
        rows = rows[rows + step < group_end[rows]]
        a, b = rows, rows + step
        near = root[a] != root[b]
        near &= np.bitwise_count(unary[a] ^ unary[b]) <= max_bits  # Manhattan bound
        a, b = a[near], b[near]
        same = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits  # exact
        if same.any():
            a, b = a[same], b[same]
            used = _roots(root, a, b)
            left.append(fp[a[used]])
            right.append(fp[b[used]])
    none = np.zeros(0, np.uint64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _find_links(max_bits: int):
    """Reads rows sorted by group (grid, cell, p, q); a group may go over several batches."""
    def emit(fp: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        a, b = _links_in(fp, np.repeat(ends, np.diff(np.concatenate([[0], ends]))), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            keys = np.concatenate([keys, new])
            fp = np.concatenate([fp, batch.column(4).to_numpy().view(np.uint64)])
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(ends):  # the last group may go on in the next batch
                yield emit(fp[: ends[-1]], ends)
                keys, fp = keys[ends[-1]:], fp[ends[-1]:]
        if len(fp):
            yield emit(fp, np.array([len(fp)]))
    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at ``max_bits`` or fewer differing bits, enough for components."""
    cells = _cells(fps, max_bits)
    sizes = materialise(cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "cell-sizes")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    members = cells.join(sizes, ["grid", "cell"]).withColumn("blocks", blocks)
    members = members.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.withColumn("other", other).select(
        "grid", "cell", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "fp")
    key = ["grid", "cell", "p", "q"]
    return paired.repartition(*key).sortWithinPartitions(*key).mapInArrow(_find_links(max_bits), "a long, b long").distinct()


def _placed(marked: DataFrame, first: Column, max_bits: int) -> DataFrame:
    """(fp, root, first): each distinct fingerprint, its component, and ``first`` aggregated over its rows of ``marked``."""
    fps = materialise(marked.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    links = materialise(near_links(fps.select("fp"), max_bits), "simhash-links")
    parts = connected_components(links).withColumnRenamed("node", "fp")
    return fps.join(parts, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def near_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id (smallest doc_id reachable over links)."""
    marked = materialise(fingerprints(docs, shingle_words), "simhash")
    placed = _placed(marked, F.min("doc_id"), max_bits)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = materialise(placed.join(smallest, "root").select("fp", "component_id"), "simhash-parts")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, its smallest doc_id and of that the smallest digest, with the columns of ``docs``."""
    digest = sha256(text_or_empty().cast("string"))
    marked = materialise(fingerprints(docs, shingle_words, digest), "simhash")
    first = F.min(F.struct(F.isnull("doc_id").alias("missing"), "doc_id", "digest"))
    winners = _placed(marked, first, max_bits).groupBy("root").agg(F.min("first").alias("first"))
    return keep_rows(docs, materialise(winners.select("first.doc_id", "first.digest"), "near-winners"), digest)
