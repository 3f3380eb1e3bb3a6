"""Spelling variants against a plain version that compares every two words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vocspark.llm import spelling

DOCS = "doc_id bigint, text string, word string, n string, h string, id string, run string, form string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 6) for i, t in rows], DOCS)


def plain_words(rows, least_length, least_count):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words, factor=10):
    forms, near_counts = {}, {}
    for w, n in words.items():
        others = [(-words[v], v) for v in words if near(w, v)]
        near_counts[w] = len(others)
        if others and -min(others)[0] >= factor * n:
            forms[w] = min(others)[1]
    out = set()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, near_counts[w], words[forms[w]] if w in forms else None))
    return out


def invented(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeéÉß÷xyz") for _ in range(rnd.choice([7, 7, 8, 9, 12, 63, 64, 65, 130]))) for _ in range(40)]
    rows = [(None, None), (0, ""), (1, "short 12 ..."), (None, base[0] + " " + base[1])]
    for i in range(250):
        words = []
        for _ in range(30):
            w = base[int(rnd.random() ** 3 * len(base))]
            for _ in range(rnd.choice([0, 0, 0, 1, 2])):
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice("abcé") + w[at + 1:], w[:at] + rnd.choice("aÉ") + w[at:]])
            words.append(w.upper() if rnd.random() < 0.1 and w.isascii() else w)
        rows.append((i, rnd.choice([" ", "-", "\n", "漢"]).join(words)))
    return rows + rows[5:9]


@pytest.mark.parametrize("blocks", [spelling.FILTER_BLOCKS, 1])
def test_variants_equal_a_plain_version(spark, monkeypatch, blocks):
    monkeypatch.setattr(spelling, "FILTER_BLOCKS", blocks)  # one block passes nearly everything: only time is lost
    monkeypatch.setattr(spelling, "TASK_WORDS", 100)
    monkeypatch.setattr(spelling, "AT_ONCE", 700)
    rows = invented(blocks)
    words = plain_words(rows, 7, 2)
    assert len(words) > 300 and max(map(len, words)) > 100
    got = spelling.variants(docs(spark, rows).repartition(5)).collect()
    assert len(got) == len(words) and {tuple(r) for r in got} == plain_variants(words)


def test_chains_ties_and_empty_tables(spark):
    # aaaaaaaa (1000) <- aaaaaaab (100) <- aaaaaabb (10) <- aaaaabbb (1 is too rare, 2 stays without a form)
    text = " ".join(["aaaaaaaa"] * 1000 + ["aaaaaaab"] * 100 + ["aaaaaabb"] * 10 + ["tiesaaax", "tiesaaax", "tiesaaay", "tiesaaay"] + ["tiesaaa"] * 1)
    got = {r.word: r for r in spelling.variants(docs(spark, [(7, text)]), factor=5).collect()}
    words = plain_words([(7, text)], 7, 2)
    assert {tuple(r) for r in got.values()} == plain_variants(words, 5)
    assert got["aaaaaabb"].root == "aaaaaaaa" and got["aaaaaabb"].form == "aaaaaaab"
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, "one two"), (2, None)])).count() == 0


def test_edits_are_found_by_hash():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdz") for _ in range(8)) for _ in range(50)]
    codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(-1, 8)
    everything = np.full(4, (1 << 64) - 1, dtype="<u8")
    letters = np.array(sorted(map(ord, "abcdz")), dtype=np.uint8)
    made = set()
    for row, at, letter, h in spelling.edits(codes, letters, {7: "7", 8: "8"}, lambda s: everything):
        for r, a, c, x in zip(row.tolist(), at.tolist(), letter.tolist(), h.tolist()):
            new = words[r][:a] + (chr(c) if c else "") + words[r][a + 1:]
            points = np.frombuffer(new.encode("latin-1"), dtype=np.uint8)
            assert spelling.hashes(points, np.array([0, len(points)]))[0] == x
            made.add((words[r], new))
    later = {(w, w[:i] + c + w[i + 1:]) for w in words for i in range(8) for c in "abcdz" if c > w[i]}
    assert made == later | {(w, w[:i] + w[i + 1:]) for w in words for i in range(8)}


def test_filters_know_their_words(spark):
    from vocspark.llm.common import fresh_folder
    words = spelling.vocabulary(docs(spark, invented(3)))
    blocks, folder = spelling.block_counts(words), fresh_folder(spark, "filters")
    filters = spelling.write_filters(words, blocks, folder)
    for r in words.collect():
        held = spelling.load_filter(filters[spelling.shard_of(r.length)])
        assert len(held) == blocks[min(r.length, spelling.LONG_FROM)]
        assert len(spelling.passes(held, np.array([r.h], dtype=np.int64).view(np.uint64))) == 1
