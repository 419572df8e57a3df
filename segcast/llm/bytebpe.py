"""Byte-level BPE with the tiktoken library and a local rank file: texts to ids, ids to bytes.

The split pattern of such vocabularies never lets a match run from a visible character
into white space, so any place between the two is a border between matches, whatever
stands around it.  Long texts are cut there and their parts encoded one by one, which
bounds the memory a text needs and gives the ids of the whole text.  A very long run of
white space overflows the library's matcher (it looks ahead from it), so it is cut out:
such a run is one match, without its last character if a visible one follows, and is
encoded as one match.

Decoding joins the tokens' raw bytes; ids need not end at a character's end.

Defined cases: a null text is an empty one, with no ids and no bytes; null ids decode to
no bytes; an id that the rank file lacks is an error; repeated rows give repeated results;
an empty table gives no rows; ``encode_documents`` reads doc_id and text only, and
``decode_documents`` the ids and the columns it is told to keep.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segcast.llm.common import map_texts

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS = 1 << 16
CHUNK_IDS = 1 << 16
LONG_RUN = 4096
#: Code points that the pattern's \s matches, as a character class (fixed values: Unicode White_Space).
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
_BORDER = re.compile(f"[^{WHITE}][{WHITE}]")


def rank_path(name: str = RANKS) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def cut_at_borders(text: str, chunk_chars: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` in parts of at least ``chunk_chars`` that end at a border between matches (the last may be shorter)."""
    at = 0
    while len(text) - at > chunk_chars:
        border = _BORDER.search(text, at + chunk_chars - 1)
        if border is None:
            break
        yield text[at:border.start() + 1]
        at = border.start() + 1
    yield text[at:]


def safe_parts(text: str, chunk_chars: int = CHUNK_CHARS, long_run: int = LONG_RUN) -> Iterator[tuple[str, bool]]:
    """Parts of ``text`` whose ids, one after the other, are the text's; true marks white space that is one match."""
    if len(text) <= long_run:
        yield text, False
        return
    at = 0
    for run in re.finditer(f"[{WHITE}]{{{long_run},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1  # the last one goes with the visible character
        for part in cut_at_borders(text[at:run.start()], chunk_chars):
            yield part, False
        yield text[run.start():end], True
        at = end
    for part in cut_at_borders(text[at:], chunk_chars):
        yield part, False


class Coder:
    """tiktoken's encoder of a rank file, and one that takes a whole string as one match."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.by_match = tiktoken.Encoding("by-match", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.as_one = tiktoken.Encoding("as-one", pat_str=r"[\s\S]+", mergeable_ranks=known, special_tokens={})

    def encode(self, text: str, chunk_chars: int = CHUNK_CHARS, long_run: int = LONG_RUN) -> np.ndarray:
        parts = [np.array((self.as_one if one else self.by_match).encode_ordinary(part), np.int32)
                 for part, one in safe_parts(text, chunk_chars, long_run) if part]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.by_match.decode_bytes(ids[i:i + CHUNK_IDS].tolist()) for i in range(0, len(ids), CHUNK_IDS))


@lru_cache(maxsize=1)
def coder(ranks: str, pattern: str) -> Coder:
    """The coder of this worker process, kept from task to task."""
    return Coder(ranks, pattern)


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None,
                     chunk_chars: int = CHUNK_CHARS, long_run: int = LONG_RUN) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``, without special tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks or rank_path(), pattern or split_pattern())
        for b in batches:
            ids = [c.encode(text.as_py() or "", chunk_chars, long_run) for text in b.column(1)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(base, run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, keep: Sequence[str] = ("doc_id",), ranks: str | None = None,
                     pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``encoded`` and ``decoded``, the bytes of its column ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks or rank_path(), pattern or split_pattern())
        for b in batches:
            lists = b.column(b.num_columns - 1)
            out = [c.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*keep, "decoded"])

    base = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col("ids").cast("array<int>").alias("ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return map_texts(base, run, f"{kinds}, decoded binary")
