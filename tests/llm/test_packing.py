import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from segcast.llm import packing as K


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(K.vocabulary_path())


def check_plan(counts, capacity):
    runs, n = K.plan_sequences(counts, capacity)
    placed, ranks = defaultdict(list), defaultdict(list)
    for length, rank, copies, first, offset in runs:
        ranks[length] += range(rank, rank + copies)
        for c in range(copies):
            placed[first + c].append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == {k: v for k, v in counts.items() if v}
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    assert sorted(placed) == list(range(n))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return n


def best_fit_decreasing(counts, capacity):
    gaps = []
    for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps.remove(fit)
            gaps.append(fit - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_gapless_whole_and_not_worse_than_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 12, 50, 400])
    counts = dict(Counter(r.randint(1, capacity) for _ in range(r.randint(0, 300))))
    total = sum(k * n for k, n in counts.items())
    n = check_plan(counts, capacity)
    assert n >= -(-total // capacity)
    assert n <= best_fit_decreasing(counts, capacity) * 1.05 + 1


def test_exact_combinations_are_consumed():
    assert check_plan({10: 5}, 10) == 5
    assert check_plan({6: 3, 4: 3}, 10) == 3  # one beside
    assert check_plan({5: 2, 3: 2, 2: 2}, 10) == 2  # two beside
    assert check_plan({4: 2, 3: 2, 2: 2, 1: 2}, 10) == 2  # three beside
    assert check_plan({5: 4}, 10) == 2
    assert check_plan({}, 10) == 0
    assert check_plan({4096: 1000, 1: 10**6, 2048: 3}, 4096) == 1000 + -(-(10**6 + 3 * 2048) // 4096)


def test_encoder_agrees_with_the_tokenizer_on_whole_texts(tokenizer):
    r = random.Random(1)
    odd = ["it's, don't. 'S X'RE, a.b,c. <|endoftext|> <|ENDOFTEXT|>, ΣΑΣ. İ, ǅ. é. ́, a\x1cb,. 1,2. ٣, Ⅷ. a​, .,., ... x.,",
           "", " ", "\n", ",", ".", "A.", "a\tb, c\r\n", "12,", "_,", "'s,", "'ll. 'd,", "<|startoftext|>,", "<| X,", "²,", "ª."]
    odd += ["".join(r.choice("aAsSİΣσé'.,<|> \n\t1٣́ _-!²") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    encoder = K.Encoder(K.vocabulary_path(), cached_words=500)
    for i in range(0, len(odd), 200):
        for text, ids in zip(odd[i:i + 200], encoder.encode(odd[i:i + 200])):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packed_documents(make_docs, tokenizer):
    r = random.Random(2)
    rows = [(None, "null id"), (0, None), (1, ""), (2, "same words"), (2, "same words"), (3, "long " * 300)]
    rows += [(i, " ".join(r.choice(["word", "Other", "és", "x,"]) for _ in range(r.randint(0, 60)))) for i in range(4, 200)]
    got = K.pack_documents(make_docs(rows, ["length", "part", "rank", "n"]).repartition(4), capacity=64).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [K.END_ID], "<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    places = defaultdict(list)
    for x in got:
        places[x.sequence_id].append((x.offset, x.length))
    for pieces in places.values():
        ends = [0] + [o + n for o, n in sorted(pieces)]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 64
    assert K.pack_documents(make_docs([])).count() == 0
