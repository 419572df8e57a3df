"""Licence scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by shunting-yard.

A text is lower-cased (A-Z only) and cut into words, runs of digits, letters a-z and
anything outside ASCII.  One automaton over the words joined by blanks finds every
place where a phrase's words stand consecutively, whatever stands between them in the
text.  Where it meets an identifier tag, the expression behind the tag is read from the
text itself, turned into postfix by the shunting-yard algorithm (with > and > or) and
evaluated: ``or`` takes the freer side, ``and`` the stricter one, ``with`` eases the licence
by a step.  A tag needs a colon (or =) behind its words, so prose about licence expressions is none.
An expression goes on in the next line, behind its comment marks, while a bracket is open or an
operator waits for its right side; it ends where the next tag begins.

``score`` says how freely the text may be used: 0 without any licence, else the least
value over its notices and expressions (1 permissive, less for copyleft, least for
unknown terms).

Defined cases: a null text counts as empty; without a place, first and last word are
null and the labels are empty strings; a malformed expression is read up to where it
stops making sense; repeated rows give repeated results; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segcast.llm.common import map_texts

BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "isc license": "isc",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "unlicense": "unlicense",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
#: How freely a label's texts may be used.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "eupl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.2, "all-rights-reserved": 0.05,
}
UNKNOWN, EASED = 0.1, 0.2
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, n_tags long")

_WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_TAGGED = re.compile(r"(?:spdx[^0-9a-z\n]+license[^0-9a-z\n]+identifier|license[^0-9a-z\n]+expression)[^\S\n]*[:=]", re.I)
_TOKEN = re.compile(r"[^\S\n]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_NEXT_LINE = re.compile(r"[^\S\n]*(?:\*/|-->)?[^\S\n]*\n[^\S\n]*(?:/{2,}|/?\*+|#+|;+|%+|--+|<!--|\bdnl\b|\bREM\b)?")
_VERSION = re.compile(r"v?[0-9.]*\+?\Z")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase, label in (BASE_PHRASES | MORE_PHRASES | dict.fromkeys(TAGS)).items():
        machine.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE_PHRASES))
    machine.make_automaton()
    return machine


def label_of(identifier: str) -> str:
    """Label of a licence identifier such as Apache-2.0; unknown ones are their own label."""
    name = identifier.lower()
    known = [k for k in FREEDOM if name == k or name.startswith((f"{k}-", f"{k}+")) or _VERSION.sub("", name, count=1) == k]
    return max(known, key=len, default=name)


def postfix(expression: str) -> list[str]:
    """The longest well-formed start of a licence expression in postfix order, by shunting-yard."""
    output, operators, depth, at, operand = [], [], 0, 0, True
    whole, moved, waiting = 0, [], 0  # output where an expression last could end; operators taken and put since
    while True:
        if at and (operand or depth) and (line := _NEXT_LINE.match(expression, at)):
            at = line.end()
        if not (m := _TOKEN.match(expression, at)):
            break
        token, at = m[1], m.end()
        word = token.lower()
        if token == "(" and operand:
            operators.append(token)
            waiting += 1
            depth += 1
        elif token == ")" and not operand and depth:
            while operators[-1] != "(":
                output.append(operators.pop())
            operators.pop()
            depth -= 1
        elif word in _PRECEDENCE and not operand:
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[word]:
                moved.append(operators.pop())
            output += moved
            operators.append(word)
            waiting += 1
            operand = True
        elif operand and word not in _PRECEDENCE and token not in "()":
            output.append(token)
            operand = False
        else:
            break
        if not operand:  # an expression could end here, its open brackets closed
            whole, moved, waiting = len(output), [], 0
    left = operators[:len(operators) - waiting] + moved[::-1]
    return output[:whole] + [x for x in reversed(left) if x != "("] if whole else []


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels named by an expression, exceptions left out, and its freedom; (empty, UNKNOWN) if it names none."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix(expression):
        if token not in _PRECEDENCE:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, min(1.0, a + EASED)))
        else:
            stack.append((left | right, (max if token == "or" else min)(a, b)))
    return stack[0] if stack else (set(), UNKNOWN)


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_tags of one UTF-8 text."""
    words = text.translate(_WORD_BYTES).split()
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    n_base, tagged, tags, first, last, seen, blanks = 0, False, [], None, None, 0, 0
    base, labels, values = set(), set(), []
    for end, (length, label, is_base) in _automaton().iter(joined):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        values.append(FREEDOM[label])
        if is_base:
            start = end - length  # the blank before the phrase
            blanks += joined.count(" ", seen, start) if start >= seen else -joined.count(" ", start, seen)
            seen = start
            n_base += 1
            first = blanks if first is None else min(first, blanks)
            last = blanks if last is None else max(last, blanks)
            base.add(label)
    if tagged:
        whole = text.decode("utf-8", "replace")
        tags = list(_TAGGED.finditer(whole))
        for m, end in zip(tags, [t.start() for t in tags[1:]] + [len(whole)]):
            named, value = evaluate(whole[m.end():end])
            labels |= named
            values.append(value)
    return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(values, default=0.0), len(tags))


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, see SCHEMA."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            rows = [scan(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(base, run, SCHEMA)
