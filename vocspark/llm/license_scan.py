"""License scan: one Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates
licence expressions.

Texts are reduced to words: A-Z lower-cased, and runs of anything but ASCII letters and digits part words (bytes from 80 on
are word characters).  The automaton runs over the words joined by blanks, so a phrase is found where its words stand
consecutively, overlaps included.

Labels come from phrases, and from ``SPDX-License-Identifier:`` tags whose expression is read from the raw text: names,
``with`` exceptions, ``and``, ``or`` and brackets.  Names of the expression become labels; the score is the expression's
permissiveness: a name's own value, the least of both for ``and``, the most for ``or``, and ``with``, which takes one name and one
exception, lifts a name half-way to 1.  Phrases count as names joined by ``and``.  A text without labels has score 0; unknown names count 0.5.

Null texts are empty.  Repeated rows give equal results, extra columns are carried (added names are replaced), empty
tables give empty results, and texts are read whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from vocspark.llm.common import add_columns, table, text_bytes
from vocspark.llm.registry import query

# The base phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Notice phrases of the method, with labels of its own.
NOTICES = {
    "permission is hereby granted free of charge": "mit-notice",
    "redistribution and use in source and binary forms": "bsd-notice",
    "licensed under the apache license": "apache-notice",
    "this program is free software": "gpl-notice",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "boost software license": "bsl",
    "isc license": "isc",
    "creative commons attribution": "cc-by-notice",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
# How freely text under a name may be used, from 0 (not at all) to 1.
VALUES = {
    "mit": 1.0, "apache": 1.0, "apache-2.0": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "bsl": 1.0,
    "bsl-1.0": 1.0, "cc0": 1.0, "cc0-1.0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "0bsd": 1.0, "zlib": 1.0,
    "mit-notice": 1.0, "bsd-notice": 1.0, "apache-notice": 1.0, "cc-by": 0.9, "cc-by-4.0": 0.9, "cc-by-3.0": 0.9,
    "cc-by-notice": 0.9, "mpl": 0.6, "mpl-2.0": 0.6, "epl": 0.6, "epl-2.0": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5,
    "cc-by-sa-4.0": 0.5, "gpl": 0.3, "gpl-notice": 0.3, "gpl-2.0": 0.3, "gpl-3.0": 0.3, "agpl": 0.2, "cc-by-nc": 0.1,
    "all-rights-reserved": 0.0,
}
UNKNOWN = 0.5
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+:_-]+)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def value_of(name: str) -> float:
    base = re.sub(r"(-only|-or-later|\+)$", "", name)
    for n in (name, base, re.sub(r"-[0-9.]+$", "", base)):
        if n in VALUES:
            return VALUES[n]
    return UNKNOWN


def _complete_tokens(text: str) -> list[str]:
    """Tokens of the longest complete expression at the start of ``text``; reading stops before the first token that cannot follow."""
    tokens, complete, depth, want_name, at = [], 0, 0, True, 0
    while m := _TOKEN.match(text, at):
        word = m[1].lower()
        after_with = bool(tokens) and tokens[-1] == "with"
        if (word in _BINDS or word == ")") == want_name or (word == "(" and after_with) or (word == ")" and not depth):
            break
        if word == "with" and (tokens[-1] == ")" or tokens[-2:-1] == ["with"]):  # only a plain name takes an exception, and only one
            break
        depth += (word == "(") - (word == ")")
        want_name = word in _BINDS or word == "("
        tokens.append(word)
        at = m.end()
        if not want_name and not depth:
            complete = len(tokens)
    return tokens[:complete]


def expression(text: str) -> tuple[list[str], float] | None:
    """Names and value of the longest expression at the start of ``text``; None if there is none.

    Shunting-yard over values: operands and waiting operators on two stacks.  Every token is pushed and taken off once, so the work grows with
    the text alone.  An exception belongs to one plain name; the names of an expression are those of all its parts.
    """
    names: set[str] = set()
    values: list[float] = []
    waiting: list[str] = []

    def apply_while(binds: int):
        while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= binds:
            op, right, left = waiting.pop(), values.pop(), values.pop()
            values.append(left + (1 - left) / 2 if op == "with" else (min if op == "and" else max)(left, right))

    before = ""
    for token in _complete_tokens(text):
        if token == "(":
            waiting.append(token)
        elif token == ")":
            apply_while(0)
            waiting.pop()
        elif token in _BINDS:
            apply_while(_BINDS[token])
            waiting.append(token)
        elif waiting and waiting[-1] == "with":
            names.add(f"{before}-with-{token}")
            values.append(UNKNOWN)
        else:
            names.add(token)
            values.append(value_of(token))
            before = token
    apply_while(0)
    return (sorted(names), values[0]) if values else None


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick
    out = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        out.add_word(f" {phrase} ", (phrase, label, False))
    for phrase, label in BASE_PHRASES.items():
        out.add_word(f" {phrase} ", (phrase, label, True))
    out.add_word(f" {TAG} ", (TAG, "", False))
    out.make_automaton()
    return out


def scan(raw: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, all labels, score) of one text."""
    words = raw.translate(_TO_WORDS).split()
    joined = " " + " ".join(w.decode("latin-1") for w in words) + " " if words else ""
    found = [(end - len(item[0]) - 1, *item) for end, item in automaton().iter(joined)]
    starts = [at for at, _, _, base in found if base]
    base = sorted({label for _, _, label, is_base in found if is_base})
    labels, score = {label for _, _, label, _ in found if label}, None
    for name in labels:
        score = value_of(name) if score is None else min(score, value_of(name))
    if any(phrase == TAG for _, phrase, _, _ in found):
        for line in _TAG_LINE.finditer(raw.decode("utf-8")):
            read = expression(line[1])
            if read is not None:
                labels.update(read[0])
                score = read[1] if score is None else min(score, read[1])
    first = last = None
    if starts:
        low, high = min(starts), max(starts)
        first, last = joined.count(" ", 0, low), joined.count(" ", 0, high)
    return len(words), len(starts), first, last, ",".join(base), ",".join(sorted(labels)), score or 0.0


def license_scan_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    def work(column):
        rows = [scan(t) for t in text_bytes(column)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, kinds)]

    return add_columns(docs, [text], "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
                       "labels string, score double", work)


@query("op7_license_scan")
def license_scan(spark, folder):
    return license_scan_columns(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
