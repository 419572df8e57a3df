import hashlib
import random

import pytest

from segcast.llm import bytebpe
from segcast.llm.bytebpe import WHITE, Coder, cut_at_borders, decode_documents, encode_documents, rank_path, safe_parts, split_pattern
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def own():
    return Coder(rank_path(), split_pattern())


def plain(coder, text):
    """The library on the whole text."""
    return coder.by_match.encode_ordinary(text)


ALPHABET = ["a", "Ab", "é", "'s", "'", "12", "½", "!", "?!", "中文", "\U0001f600", " ", "  ", "\n", "\t", "\xa0", "　", " ", "\x1c", "\r\n"]


@pytest.mark.parametrize("seed", range(40))
def test_parts_give_the_ids_of_the_whole_text(own, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 400)))
    for chunk, run in ((1, 1), (3, 2), (17, 4), (64, 3)):
        parts = list(safe_parts(text, chunk, run))
        assert "".join(p for p, _ in parts) == text
        assert own.encode(text, chunk, run).tolist() == plain(own, text)
    assert own.decode(own.encode(text)) == text.encode()


def test_parts_end_between_visible_and_white():
    text = "one  two\n\nthree four " * 50
    parts = list(cut_at_borders(text, 10))
    assert "".join(parts) == text and len(parts) > 20
    assert all(not p[-1].isspace() and q[0].isspace() for p, q in zip(parts, parts[1:]))


@pytest.mark.parametrize("text", ["x" * 200_000, " " * 50_000 + "end", "a" + "\n" * 60_000, "中" * 80_000, "^" * 100_000, "'s" * 40_000,
                                  "word " * 60_000, " \t" * 30_000 + "x" + " " * 9_000])
def test_long_texts_equal_the_library(own, text):
    assert own.encode(text).tolist() == plain(own, text)


@pytest.mark.parametrize("text", [" " * 2_000_000 + "x", "y" + "\n" * 1_500_000])
def test_runs_on_which_the_library_gives_up(own, text):
    ids = own.encode(text)
    assert own.decode(ids) == text.encode()
    white = text.strip("xy")[: len(text) - 1 - (text[-1] == "x")]  # the run's own match
    one = own.as_one.encode_ordinary(white)
    assert ids.tolist() == (plain(own, "y") if text[0] == "y" else []) + one + (plain(own, " x") if text[-1] == "x" else [])


def test_white_is_what_the_pattern_takes_for_white(own):
    """A border by our class is a border of the library's: "x" and what follows never share a token match."""
    import re
    white = re.compile(f"[{WHITE}]")
    for code in [*range(1, 0x3100), 0xFEFF]:
        if 0xD800 <= code < 0xE000 or not white.match(chr(code)):
            continue
        assert own.encode(f"x{chr(code)}y", 1, 1).tolist() == plain(own, f"x{chr(code)}y")


def test_documents_round_trip(spark, make_docs, own):
    texts = [None, "", "Hello  world's\n", "Grüße 中文 \U0001f600", "x" * 70_000, "a b " * 40_000, "Hello  world's\n", "<|endoftext|>"]
    docs = make_docs(list(enumerate(texts)), extra=["ids", "decoded"])
    rows = {r["doc_id"]: r for r in decode_documents(encode_documents(docs, chunk_chars=1000).select("doc_id", "ids"), ("doc_id",)).collect()}
    ids = {r["doc_id"]: r["ids"] for r in encode_documents(docs, chunk_chars=1000).collect()}
    for i, t in enumerate(texts):
        assert ids[i] == plain(own, t or "")
        assert bytes(rows[i]["decoded"]) == (t or "").encode()


def test_raw_bytes_and_odd_ids(spark, own):
    half = own.by_match.encode_ordinary("\U0001f600")[:1]  # part of a character
    df = spark.createDataFrame([(1, half), (2, None), (None, [])], "k long, ids array<int>")
    got = {r["k"]: bytes(r["decoded"]) for r in decode_documents(df, ("k",)).collect()}
    assert got == {1: own.by_match.decode_bytes(half), 2: b"", None: b""}


def test_empty_table(make_docs):
    empty = make_docs([])
    assert encode_documents(empty).count() == 0
    assert decode_documents(encode_documents(empty)).count() == 0


def test_query_equals_the_library_on_every_document(spark, own):
    from segcast.llm.queries import op13_bytebpe
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = op13_bytebpe(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in got:
        ids = plain(own, texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == sha((texts[r["doc_id"]] or "").encode())


def test_ranks_are_a_parameter(make_docs):
    import public_tokenizers
    other = Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), split_pattern())
    got = encode_documents(make_docs([(1, "Straße und Wörter")]), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken")).first()["ids"]
    assert got == other.by_match.encode_ordinary("Straße und Wörter")
    assert bytebpe.rank_path().endswith(bytebpe.RANKS)
