import random
import re
import time

import pytest

from segcast.llm import license as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    hits = [(i, label) for phrase, label in L.BASE_PHRASES.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))


def texts():
    r = random.Random(1)
    parts = ["GNU", "general", "Public", "LICENSE", "apache", "license", "CC", "by", "BY-NC", "MIT", "mit license", "é", "ß1", "...", "\n",
             "gnu general public license", "The", "x"]
    out = [None, "", " ", "MIT LICENSE", "mit-license/MIT_License", "apache license cc by cc-by", "MİT License", "É" * 1000, "mit license " * 5000]
    return out + ["".join(r.choice(parts) + r.choice([" ", "-", ". ", "\n", ""]) for _ in range(r.randint(1, 40))) for _ in range(300)]


def test_places_match_brute_force(make_docs):
    rows = list(enumerate(texts()))
    got = sorted(L.scan_documents(make_docs(rows, ["labels", "score"]).repartition(3)).collect())
    for (_, t), r in zip(rows, got):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize("expression, postfix, labels, value", [
    ("MIT", ["MIT"], {"mit"}, 1.0),
    ("MIT OR Apache-2.0 AND GPL-3.0-only", ["MIT", "Apache-2.0", "GPL-3.0-only", "and", "or"], {"mit", "apache", "gpl"}, 1.0),
    ("(MIT OR Apache-2.0) AND GPL-3.0-only", ["MIT", "Apache-2.0", "or", "GPL-3.0-only", "and"], {"mit", "apache", "gpl"}, 0.4),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later", "Classpath-exception-2.0", "with"], {"gpl"}, 0.6),
    ("GPL-2.0 with X and MIT or CC-BY-4.0", ["GPL-2.0", "X", "with", "MIT", "and", "CC-BY-4.0", "or"], {"gpl", "mit", "cc-by"}, 0.9),
    ("MIT and (", ["MIT"], {"mit"}, 1.0),
    ("MIT and", ["MIT"], {"mit"}, 1.0),
    ("(MIT or Zlib", ["MIT", "Zlib", "or"], {"mit", "zlib"}, 1.0),
    ("or MIT", [], set(), 0.1),
    (") MIT", [], set(), 0.1),
    ("", [], set(), 0.1),
    ("LicenseRef-Own */", ["LicenseRef-Own"], {"licenseref-own"}, 0.1),
])
def test_expressions(expression, postfix, labels, value):
    assert L.postfix(expression) == postfix
    assert L.evaluate(expression) == (labels, pytest.approx(value))


def test_tags_and_more_labels():
    text = "// SPDX-License-Identifier: (LGPL-2.1+ OR BSD-3-Clause)\nLicensed under CC BY-NC 4.0.\nAll rights reserved"
    got = L.scan(text.encode())
    assert got[4] == "cc-by" and got[5] == "all-rights-reserved,bsd,cc-by,cc-by-nc,lgpl" and got[7] == 1
    assert got[6] == 0.05
    assert L.scan(b"SPDX-License-Identifier: MIT")[5:7] == ("mit", 1.0)


@pytest.mark.parametrize("text, labels, n_tags", [
    ("The license expression is unclear", "", 0),
    ("a license expression of the people, SPDX license identifier and more", "", 0),
    ("License-Expression: MIT\nis a licence", "mit", 1),
    ("// SPDX-License-Identifier: (GPL-2.0 OR\n// MIT)\n// more words", "gpl,mit", 1),
    ("# SPDX-License-Identifier: GPL-2.0 OR\r\n#   Apache-2.0\n# AND nothing", "apache,gpl", 1),
    ("/* SPDX-License-Identifier: (MIT\n * AND BSD-3-Clause)\n * OR GPL-2.0 */", "bsd,mit", 1),
    ("SPDX-License-Identifier: MIT\nOR GPL-2.0", "mit", 1),
    ("SPDX-License-Identifier: (MIT OR\nSPDX-License-Identifier: GPLv3", "gpl,mit", 2),
    ("License-Expression:\nMIT", "", 1),
    ("License-Expression = LGPLv2.1+", "lgpl", 1),
])
def test_tags_in_prose_and_across_lines(text, labels, n_tags):
    got = L.scan(text.encode())
    assert (got[5], got[7]) == (labels, n_tags)


def test_long_open_expressions_take_linear_time():
    start = time.time()
    assert L.scan(("License-Expression: (" + "\n(" * 200_000).encode())[7] == 1
    assert L.scan(("License-Expression: (\n" * 50_000).encode())[7] == 50_000
    assert L.scan(("License-Expression: " + "MIT OR\n" * 200_000 + "MIT").encode())[5] == "mit"
    assert time.time() - start < 20


def test_empty_table(make_docs):
    assert L.scan_documents(make_docs([])).count() == 0
