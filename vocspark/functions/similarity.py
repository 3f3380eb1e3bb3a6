"""Similarity score of two texts in compare form, and cheap exact bounds on it.

score(a, b) = min(ratio(a, b) + 0.2 * shared words / larger word set, 1), where ratio is the
Ratcliff-Obershelp measure of the standard library.  It is not symmetric, so order matters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

# Weight of shared words, thresholds of the two uses, slack for floating point.
WORD_WEIGHT = 0.2
SIMILAR_AT, REPEAT_AT = 0.7, 0.4
SLACK = 1e-9
# Texts up to this length are compared many at a time; run lengths then fit a byte.
SHORT_TEXT = 255
# Cells of the run tables of one block, texts whose candidates are gathered together, and sides of the windows cut from a table.
BLOCK_CELLS, TEXTS_AT_ONCE, WINDOWS = 2_000_000, 1_024, (16, 32)
# Characters counted apart in the bound of a rectangle; the rarer ones of a larger alphabet count as one, which only loosens it.
COUNTED = 64
AUTOJUNK_FROM = 200


def score(a: str, b: str, autojunk: bool = False) -> float:
    """Exact score of ``b`` as seen from ``a``; both in compare form."""
    if not a or not b:
        return 0.0
    wa, wb = set(a.split()), set(b.split())
    boost = WORD_WEIGHT * len(wa & wb) / max(len(wa), len(wb), 1)
    return min(SequenceMatcher(None, a, b, autojunk).ratio() + boost, 1.0)


def _run_table(a: np.ndarray, others: np.ndarray) -> np.ndarray:
    """[k, i, j]: how many characters up to ``a[i]`` and ``others[k, j]`` are equal; the last column of ``others`` is padding."""
    rows, width = others.shape
    table = np.zeros((len(a), rows * width), dtype=np.uint8)
    for i, code in enumerate(a):
        if i:
            np.add(table[i - 1, :-1], 1, out=table[i, 1:])
            table[i, 0] = 1
        else:
            table[i] = 1
        table[i] *= (others == code).ravel().view(np.uint8)
    return np.ascontiguousarray(table.reshape(len(a), rows, width).transpose(1, 0, 2))


def _longest_in(table: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, last row and last column of the first longest run in each rectangle (table, top, bottom, left, right)."""
    _, height, width = table.shape
    size = np.empty(len(open_), dtype=np.int64)
    row, column = np.empty_like(size), np.empty_like(size)
    extent = np.maximum(open_[:, 2] - open_[:, 1], open_[:, 4] - open_[:, 3])
    sides, low = [(s, s) for s in WINDOWS if s <= min(height, width)] + [(height, width)], 0
    for high, wide in sides:
        last = (high, wide) == (height, width)
        picked = np.flatnonzero((extent > low) if last else (extent > low) & (extent <= high))
        low = high
        per_step = max(BLOCK_CELLS // (high * wide), 1)
        windows = sliding_window_view(table, (high, wide), axis=(1, 2))
        for start in range(0, len(picked), per_step):
            part = picked[start:start + per_step]
            k, top, bottom, left, right = open_[part].T
            r0, c0 = np.minimum(top, height - high), np.minimum(left, width - wide)
            runs = windows[k, r0, c0]
            # A run that begins outside the rectangle counts from its edge on; what ends outside counts nothing.
            i, j = r0[:, None] + np.arange(high), c0[:, None] + np.arange(wide)
            down = np.where((i < top[:, None]) | (i >= bottom[:, None]), 0, i - top[:, None] + 1).astype(np.uint8)
            across = np.where((j < left[:, None]) | (j >= right[:, None]), 0, j - left[:, None] + 1).astype(np.uint8)
            np.minimum(runs, down[:, :, None], out=runs)
            np.minimum(runs, across[:, None, :], out=runs)
            flat = runs.reshape(len(part), -1)
            best = flat.argmax(axis=1)
            size[part] = flat[np.arange(len(part)), best]
            row[part], column[part] = r0 + best // wide, c0 + best % wide
    return size, row, column


def _prefix_counts(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """[k, n, c]: how often the characters counted as ``c`` stand among the first ``n`` of a text; code 0 is not counted."""
    rows, width = codes.shape
    counts = np.zeros((rows, width + 1, int(place.max(initial=0)) + 1), dtype=np.uint8)
    row, column = np.nonzero(codes)
    counts[row, column + 1, place[codes[row, column]]] = 1
    return np.cumsum(counts, axis=1, dtype=np.uint8, out=counts)


def matched_characters(a: np.ndarray, others: np.ndarray, lengths: np.ndarray, need: np.ndarray,
                       counts_a: np.ndarray, counts: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Characters of ``a`` in matching blocks with each of ``others``, as the standard library finds them without junk; −1 if below ``need``.

    All pairs take the same step at once: in every open rectangle the first longest run is found, and what lies before and behind it
    is opened next.  A rectangle cannot give more than the characters common to its sides (``counts_a`` and ``counts[row_of]``, prefix
    counts), so a pair is left as soon as it cannot reach ``need``.
    """
    matched = np.zeros(len(others), dtype=np.int64)
    if not len(others) or not len(a):
        return np.where(matched < need, -1, matched)
    table = _run_table(a, others)
    flat, zero = table.reshape(len(others), -1), np.zeros_like(matched)
    best = flat.argmax(axis=1)
    size = flat[np.arange(len(others)), best].astype(np.int64)
    row, column = best // others.shape[1], best % others.shape[1]
    open_ = np.stack([np.arange(len(others)), zero, zero + len(a), zero, lengths], axis=1)
    while True:
        found = size > 0
        open_, size, row, column = open_[found], size[found], row[found], column[found]
        matched += np.bincount(open_[:, 0], weights=size, minlength=len(matched)).astype(np.int64)
        k, top, bottom, left, right = open_.T
        open_ = np.concatenate([np.stack([k, top, row - size + 1, left, column - size + 1], axis=1),
                                np.stack([k, row + 1, bottom, column + 1, right], axis=1)])
        open_ = open_[(open_[:, 2] > open_[:, 1]) & (open_[:, 4] > open_[:, 3])]
        k, top, bottom, left, right = open_.T
        common = np.minimum(counts_a[bottom] - counts_a[top], counts[row_of[k], right] - counts[row_of[k], left])
        most = common.sum(axis=1, dtype=np.int64)
        reach = matched + np.bincount(k, weights=most, minlength=len(matched))
        matched[reach < need] = -len(a) - 1
        open_ = open_[(most > 0) & (reach[k] >= need[k])]
        if not len(open_):
            return np.maximum(matched, -1)
        size, row, column = _longest_in(table, open_)


class ProbeSet:
    """A bounded set of probe texts to compare each text of a partition with.

    Before the exact score, three upper bounds are taken for all probes at once: shared words are
    exact, and the ratio cannot exceed what the lengths or the common character counts allow.  A
    pair is dropped only if the bounds prove that it stays under the threshold.  The pairs left are
    scored probe by probe, each against all its texts of similar length at once.
    """

    def __init__(self, texts: list[str], threshold: float, autojunk: bool = False):
        self.texts, self.threshold, self.autojunk = texts, threshold, autojunk
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.word_counts = np.array([len(set(t.split())) for t in texts], dtype=np.int64)
        self.by_word: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            for w in set(t.split()):
                self.by_word.setdefault(w, []).append(i)
        self.chars = {c: k for k, c in enumerate(sorted(set("".join(texts))))}
        self.points = np.array([ord(c) for c in self.chars], dtype=np.uint32)
        self.histogram = np.zeros((len(texts), len(self.chars)), dtype=np.int32)
        for i, t in enumerate(texts):
            for c, n in Counter(t).items():
                self.histogram[i, self.chars[c]] = n
        by_frequency = np.argsort(-self.histogram.sum(axis=0), kind="stable")
        self.counted_as = np.zeros(len(self.chars) + 1, dtype=np.int64)
        self.counted_as[by_frequency + 1] = np.minimum(np.arange(len(self.chars)), COUNTED - 1)

    def matches(self, text: str, before: int | None = None) -> list[tuple[int, float]]:
        """(probe index, score) for every probe from which ``text`` reaches the threshold.

        ``before`` restricts the probes to those of a smaller index.
        """
        return self.matches_of([text], [before])[0]

    def matches_of(self, texts: Sequence[str], before: Sequence[int | None] | None = None) -> list[list[tuple[int, float]]]:
        """:meth:`matches` of many texts."""
        out: list[list[tuple[int, float]]] = []
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[start:start + TEXTS_AT_ONCE]
            limits = [None] * len(part) if before is None else before[start:start + TEXTS_AT_ONCE]
            near = [self._near(t, b) for t, b in zip(part, limits, strict=True)]
            rows = np.repeat(np.arange(len(part)), [len(i) for i, _ in near])
            found = self._scored(part, rows, np.concatenate([i for i, _ in near]), np.concatenate([b for _, b in near]))
            lists: list[list[tuple[int, float]]] = [[] for _ in part]
            for row, probe, value in found:
                lists[row].append((probe, value))
            out += [sorted(one) for one in lists]
        return out

    def _near(self, text: str, before: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Probes that the bounds do not rule out, and what the words they share add to their scores."""
        word_set = set(text.split())
        shared = np.zeros(len(self.texts), dtype=np.int64)
        for w in word_set:
            hit = self.by_word.get(w)
            if hit:
                shared[hit] += 1
        boost = WORD_WEIGHT * shared / np.maximum(np.maximum(self.word_counts, len(word_set)), 1)
        need = self._need(boost, self.lengths + len(text))
        near = np.flatnonzero(np.minimum(self.lengths, len(text))[:before] >= need[:before])
        if near.size:
            own = np.zeros(len(self.chars), dtype=np.int32)
            for c, n in Counter(text).items():
                k = self.chars.get(c)
                if k is not None:
                    own[k] = n
            near = near[np.minimum(self.histogram[near], own).sum(axis=1) >= need[near]]
        return near, boost[near]

    def _need(self, boost: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Matched characters without which a pair stays under the threshold."""
        return (self.threshold - boost - SLACK) * total / 2

    def _scored(self, texts: Sequence[str], rows: np.ndarray, probes: np.ndarray, boosts: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, probe, score) of the pairs that reach the threshold."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        # The heuristic of the library starts at a length of the text; shorter texts have no popular characters.
        many = (sizes[rows] <= SHORT_TEXT) & (self.lengths[probes] <= SHORT_TEXT)
        if self.autojunk:
            many &= sizes[rows] < AUTOJUNK_FROM
        matched = np.full(len(rows), -1, dtype=np.int64)
        codes = self._codes([t if len(t) <= SHORT_TEXT else "" for t in texts])
        counts = _prefix_counts(codes, self.counted_as)
        order = np.lexsort((sizes[rows], probes))
        order = order[many[order]]
        for pairs in np.split(order, np.flatnonzero(np.diff(probes[order])) + 1):
            if not pairs.size:
                continue
            probe = self._codes([self.texts[probes[pairs[0]]]])[0, :-1]
            counts_probe, start = _prefix_counts(probe[None], self.counted_as)[0], 0
            while start < len(pairs):
                # Texts are in order of length: a block is as wide as its last one.
                step = max(BLOCK_CELLS // (len(probe) * (int(sizes[rows[pairs[start]]]) + 1)), 1)
                block = pairs[start:start + step]
                length = sizes[rows[block]]
                need = self._need(boosts[block], length + len(probe))
                matched[block] = matched_characters(
                    probe, codes[rows[block], :length.max() + 1], length, need, counts_probe, counts, rows[block])
                start += step
        ratio = 2.0 * np.maximum(matched, 0) / np.maximum(sizes[rows] + self.lengths[probes], 1)
        values = np.where(matched < 0, -1.0, np.minimum(ratio + boosts, 1.0))
        for pair in np.flatnonzero(~many):
            values[pair] = self._by_library(texts[rows[pair]], self.texts[probes[pair]], boosts[pair])
        hit = np.flatnonzero(values >= self.threshold)
        return list(zip(rows[hit].tolist(), probes[hit].tolist(), values[hit].tolist(), strict=True))

    def _by_library(self, text: str, probe: str, boost: float) -> float:
        if probe == text and not self.autojunk:
            return 1.0
        return min(SequenceMatcher(None, probe, text, self.autojunk).ratio() + float(boost), 1.0)

    def _codes(self, texts: Sequence[str]) -> np.ndarray:
        """One row a text: places of its characters among those of the probes, from 1; 0 for others and behind the end."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        place = np.searchsorted(self.points, points)
        known = self.points[np.minimum(place, len(self.points) - 1)] == points if len(self.points) else np.zeros(len(points), dtype=bool)
        out = np.zeros((len(texts), int(sizes.max()) + 1), dtype=np.uint16 if len(self.points) < 65_535 else np.uint32)
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.where(known, place + 1, 0)
        return out
