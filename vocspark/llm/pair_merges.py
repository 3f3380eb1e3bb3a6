"""Merging neighbouring symbols of many words at once, in rank order, with NumPy.

A round merges in every word its first pair of least rank; words without a pair that merges are done.  That is the
order in which byte-pair encoders apply their merges (ties: the left pair first), so results are exact.  Words of over
LONG symbols are merged one at a time with a heap, in n log n.  Empty words stay empty.
"""

from __future__ import annotations

import heapq

import numpy as np

LONG = 96
# Symbols that are merged at a time, so that temporaries stay in the processor's cache.
AT_ONCE = 1 << 18
NONE = np.int64((1 << 31) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


class PairTable:
    """(left, right) → (rank, made), as an open-addressed hash table over arrays."""

    def __init__(self, left, right, rank, made):
        keys = np.asarray(left, dtype=np.uint64) << np.uint64(32) | np.asarray(right, dtype=np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _FREE), np.full(1 << bits, -1, dtype=np.int32)
        self.ranks = np.append(np.asarray(rank, dtype=np.int64), NONE)
        self.made = np.append(np.asarray(made, dtype=np.int64), -1)
        slots = (keys * _ODD >> self.shift).astype(np.int64)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[slots[waiting]] == _FREE]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], placed
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slots[waiting] = (slots[waiting] + 1) & self.mask
        self._dict: dict | None = None

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of every pair, -1 where there is none; so ``ranks`` and ``made`` end with the entry for none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = (keys * _ODD >> self.shift).astype(np.int64)
        got = self.keys[slots]
        out = np.where(got == keys, self.values[slots], np.int32(-1))
        open_ = np.flatnonzero((got != keys) & (got != _FREE))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            got = self.keys[slots[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (got != _FREE)]
        return out

    def lookup(self) -> dict[tuple[int, int], tuple[int, int]]:
        """The same table for single look-ups, made on first use."""
        if self._dict is None:
            used = self.keys != _FREE
            keys, numbers = self.keys[used], self.values[used]
            self._dict = dict(zip(
                zip((keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist()),
                zip(self.ranks[numbers].tolist(), self.made[numbers].tolist())))
        return self._dict


def merge_one(symbols: list[int], table: PairTable) -> list[int]:
    """One word, with a heap of (rank, place) over linked neighbours."""
    n, known = len(symbols), table.lookup()
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    found = table.find(np.array(symbols[:-1], dtype=np.int64), np.array(symbols[1:], dtype=np.int64))
    heap = [(int(table.ranks[k]), i, symbols[i], symbols[i + 1]) for i, k in enumerate(found.tolist()) if k >= 0]
    heapq.heapify(heap)
    while heap:
        _, at, left, right = heapq.heappop(heap)
        nxt = after[at]
        if symbols[at] != left or nxt < 0 or symbols[nxt] != right:
            continue
        symbols[at], symbols[nxt] = known[left, right][1], -1
        after[at] = after[nxt]
        if after[nxt] >= 0:
            before[after[nxt]] = at
        for a, b in ((before[at], at), (at, after[at])):
            if a >= 0 and b >= 0 and (symbols[a], symbols[b]) in known:
                heapq.heappush(heap, (known[symbols[a], symbols[b]][0], a, symbols[a], symbols[b]))
    return [s for s in symbols if s >= 0]


def _merge_short(symbols: np.ndarray, counts: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of at least two symbols; gives symbols and counts in the words' order."""
    sym, word = symbols.copy(), np.arange(len(counts))
    count, done, final = counts.copy(), [], np.zeros(len(counts), dtype=np.int64)
    starts = np.cumsum(count) - count
    pair = np.full(len(sym), -1, dtype=np.int32)
    inner = np.ones(len(sym), dtype=bool)
    inner[starts + count - 1] = False
    at = np.flatnonzero(inner)
    pair[at] = table.find(sym[at], sym[at + 1])
    while len(count):
        best = np.minimum.reduceat(table.ranks[pair] << 32 | np.arange(len(sym)), starts)
        alive = best >> 32 < NONE
        keep = np.repeat(alive, count)
        if not alive.all():
            done.append((word[~alive], sym[~keep]))
            final[word[~alive]] = count[~alive]
        spot = best[alive] & 0xFFFFFFFF
        sym[spot] = table.made[pair[spot]]
        last = spot + 1 == (starts + count - 1)[alive]
        keep[spot + 1] = False
        place = np.cumsum(keep) - 1
        sym, pair, spot = sym[keep], pair[keep], place[spot]
        word, count = word[alive], count[alive] - 1
        starts = np.cumsum(count) - count
        right = spot[~last]
        pair[spot[last]] = -1
        pair[right] = table.find(sym[right], sym[right + 1])
        left = spot[spot > starts]
        pair[left - 1] = table.find(sym[left - 1], sym[left])
    out = np.empty(int(final.sum()), dtype=np.int64)
    places = np.cumsum(final) - final
    for words, part in done:
        size = final[words]
        out[np.repeat(places[words] - (np.cumsum(size) - size), size) + np.arange(len(part))] = part
    return out, final


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places start … start + size - 1, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def merge_words(symbols: np.ndarray, bounds: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge the words symbols[bounds[k]:bounds[k + 1]]; gives the merged symbols and their bounds."""
    counts, symbols = np.diff(bounds), symbols.astype(np.int64, copy=False)
    final, parts = counts.copy(), []
    short = np.flatnonzero((counts > 1) & (counts <= LONG))
    cuts = np.searchsorted(np.cumsum(counts[short]), np.arange(AT_ONCE, int(counts[short].sum()) + AT_ONCE, AT_ONCE), side="right")
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(short)]):
        if b > a:
            some = short[a:b]
            merged, sizes = _merge_short(symbols[spread(bounds[some], counts[some])], counts[some], table)
            final[some] = sizes
            parts.append((some, merged))
    for k in np.flatnonzero(counts > LONG):
        merged = np.array(merge_one(symbols[bounds[k]:bounds[k + 1]].tolist(), table), dtype=np.int64)
        final[k] = len(merged)
        parts.append((np.array([k]), merged))
    single = np.flatnonzero(counts == 1)
    parts.append((single, symbols[bounds[single]]))
    ends = np.cumsum(final)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    for words, part in parts:
        out[spread((ends - final)[words], final[words])] = part
    return out, np.concatenate(([0], ends))
