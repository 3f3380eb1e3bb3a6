"""Language-model scores by logistic context mixing over bits, and add-half unigram scores.

A text is a sequence of words (A-Z lower-cased) and one end.  A word is spelled by its bytes and a blank, the end by a line
feed, so that spellings are prefix-free and the bit probabilities multiply to a distribution over texts.

* Counting: the words of all training texts are counted by a distributed aggregation.  Every bit of a word is
  predicted from five contexts (place, one, two and three bytes before, and the whole word so far), each with exact
  counts of zeros and ones; no two contexts share a count, and the counts grow with the input.  For the first four the
  bytes after each context are a table (gram, n), written in sorted pieces.  For the fifth the distinct words are dealt
  into alphabetic parts, in which the words with a common beginning stand together; beginnings that more than one part
  can hold are those of the cuts between parts, and are grams of the same table.
* Mixing: a gate, chosen by how much the two longest contexts have seen, has a weight for each stretched
  prediction.  Weights are learned online over all training words with all their copies, with the word at hand taken
  out of the counts once.  A word with more copies than a step's share of its part has them spread over the part's steps.
  Parts are learned from in groups fixed by their number, and the groups' weights are averaged by the words they saw, so that
  nothing depends on the number of tasks.
* Refining: an adaptive table by gate and mixed prediction, counted in the same pass, is averaged with the mix.
* Borders: contexts run on over the blank.  The first byte of a word is predicted from its place and from the last one and two
  bytes of the word before, the second from its place, the first, and the first with the last byte of the word before: the
  contexts of up to three bytes of a running text.  Their exact counts are two tables of at most 2**24 grams; weights by gate are fitted
  to all of them, each gram taken out of its counts once.
* Text so far: a word's probability is mixed with its share among the tokens before it in the same text.  The odds of that share depend on
  how many tokens stand before, and are fitted to all training tokens (by a histogram of both predictions' ratio).

From its third byte on a word's spelling depends on the word alone, so each distinct word is spelled once.  One scan of the documents finds the
``frequent`` most frequent training words (a bounded dictionary), the rest meet their scores by a join on the word's hash.  ``bits_per_byte`` counts a
blank for each word and one byte for the end.

Training texts are those with crc32(doc_id as text) mod 5 other than 1; rows without an id are held out of training and count as not held out.
Null texts are empty and have the end alone.  Repeated rows count and score as often as they stand there.  Without training texts
N and V are 0 and the model is uniform.  Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.llm.common import (
    LOWER, crc_mod_5, fresh_folder, make_folder, materialise, mix64, span_hashes, store, table, text_bytes, with_column_batches,
    word_spans, pieces)
from vocspark.llm.registry import query

# Slots of a small model given as arrays (``Tables``).
SLOT_BITS = 20
CONTEXTS = 5
FREQUENT = 1 << 18
# Bytes of the distinct words of one alphabetic part, and words sampled for a part to place the cuts.
PART_BYTES = 1 << 18
CUT_SAMPLE = 32
CUT_BYTES = 256
# Grams of one file, and grams that a worker keeps; beyond it reads the files again for every part.
PIECE_GRAMS = 1 << 20
HELD_GRAMS = 1 << 23
# The kind of a gram stands above its 24 bits of context and 8 bits of byte.
KIND_SHIFT = 32
LEVELS = 5
GATES = LEVELS * LEVELS
BUCKETS = 33
DELTA = 0.4
RATE = 0.1
BATCH_WORDS = 20_000
STEP_WORDS = 2000
# Parts that one group of the learning takes.
GROUP_PARTS = 16
# Bytes of a word that are predicted over the border; contexts of each.
BORDER_BYTES = 2
BORDER_CONTEXTS = 3
BORDER_ROUNDS = 12
# Partial border counts that a task holds before it adds them up.
HELD_BORDERS = 1 << 21
# Text so far: gates by the tokens before, and cells of the logarithm of the two predictions' ratio.
TEXT_GATES = 16
CELLS, CELLS_A_UNIT, CELL_ZERO = 256, 8, 64
TEXT_ROUNDS = 200
SEEN = np.dtype([("gate", "u1"), ("ratio", "<f4")])
# Curvature for each unit of load that a gate starts from, and that is added to it.
CURVE_START = 5e-3
CURVE_FLOOR = 5e-6
END = b"\n"
END_HASH = int(mix64(np.array([0x0E0D], dtype=np.uint64)).view(np.int64)[0])
# First bytes of the end, and last bytes of what stands before a text.
END_BYTES = 10 << 8 | 10
_SALT = mix64(np.arange(1001, 1001 + CONTEXTS, dtype=np.uint64))
_NODE = mix64(np.arange(2001, 2001 + 256, dtype=np.uint64))


def spellings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words with their terminators, and the start of each; the end's word is empty."""
    data = b"".join(w + b" " if w else END for w in words)
    starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    return np.frombuffer(data, dtype=np.uint8), starts.astype(np.int64)


def kinds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The context of each kind and byte: place, one, two and three bytes before; hash of the word so far."""
    sizes = np.diff(starts)
    first = np.repeat(starts[:-1], sizes)
    place = np.arange(len(data), dtype=np.int64) - first
    wide = data.astype(np.uint64)
    one = np.zeros(len(data), dtype=np.uint64)
    one[1:] = wide[:-1]
    one[place < 1] = 32  # no byte of a word
    two, three = np.zeros_like(one), np.zeros_like(one)
    two[1:] = one[:-1]
    two[place < 2] = 32  # no byte of a word
    three[1:] = two[:-1]
    three[place < 3] = 32  # no byte of a word
    before = np.arange(len(data), dtype=np.int64)
    whole = span_hashes(data, first, before)
    two = (one << np.uint64(8)) | two
    three = (two << np.uint64(8)) | three
    return np.minimum(place, 20).astype(np.uint64), one, two, three, whole


def contexts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit context hash for each kind and byte."""
    return np.stack([mix64(k + s) for k, s in zip(kinds(data, starts), _SALT)])


def slots(ctx: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot numbers (kinds x bytes) of one bit position; ``node`` holds the bits of the byte so far behind a 1."""
    mixed = (ctx + _NODE[node]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def bits(data: np.ndarray):
    """For each of the 8 bit positions: node and bit of every byte."""
    for k in range(8):
        yield (np.int64(1) << k) | (data.astype(np.int64) >> (8 - k)), (data >> (7 - k)) & 1


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1.0 - p))


def _stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + DELTA) / (zeros + DELTA)), -12, 12)


def _levels(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(total + 1).astype(np.int64) >> 1, LEVELS - 1)


def _predictions(counts, place: int, taken: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (kinds + 1 x bytes) and gates of a bit position; ``taken`` is the bit that is taken out of the counts once."""
    if isinstance(counts, PartCounts):
        return counts.predictions(place, taken is not None)
    zeros, ones = counts(place)
    if taken is not None:
        zeros = zeros - (taken == 0)
        ones = ones - (taken == 1)
    inputs = np.full((CONTEXTS + 1, zeros.shape[1]), 0.3, dtype=np.float32)
    inputs[:CONTEXTS] = _stretched(zeros, ones)
    level = _levels((zeros + ones)[CONTEXTS - 2:])
    return inputs, level[0] * LEVELS + level[1]


def _mixed(weights: np.ndarray, inputs: np.ndarray, gates: np.ndarray) -> np.ndarray:
    total = np.zeros(len(gates))
    for weight, values in zip(np.ascontiguousarray(weights.T), inputs):
        total += weight[gates] * values
    return np.clip(total, -14, 14)


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x + BUCKETS // 2), 0, BUCKETS - 1).astype(np.int64)


def start_weights() -> np.ndarray:
    out = np.full((GATES, CONTEXTS + 1), 0.25, dtype=np.float64)
    out[:, CONTEXTS] = 0.0
    return out


def steps(copies: np.ndarray, order: np.ndarray):
    """(words, loads) of each step over the words ``order``; all copies of a word are in the loads of its steps."""
    n = -(-len(order) // STEP_WORDS)
    often = copies[order] * n > copies[order].sum()
    hot, rest = order[often], order[~often]
    for step in range(n):
        some = np.concatenate((hot, rest[step::n]))
        yield some, np.concatenate((copies[hot] / n, copies[rest[step::n]].astype(np.float64)))


def train(data: np.ndarray, counts, load: np.ndarray, weights: np.ndarray, refined: np.ndarray, curve: np.ndarray, seen: int, usual: float) -> None:
    """One online step over a batch of bytes: weights, refining table and curvature are updated in place.

    ``counts`` gives zeros and ones (kinds x bytes) of a bit position.
    A weight moves by its gradient over the running mean of its curvature, so gates and inputs of any size are stable.
    Both are taken over the load of the step, or over the ``usual`` load of a step if that is more: the load of a text that
    is repeated as a whole changes nothing, and within a task a copy counts the same in every step.
    """
    total = load.sum()
    share = total / max(total, usual)
    relative = load / total
    rate = RATE / math.sqrt(1 + seen / 10)
    for place, (_, bit) in enumerate(bits(data)):
        inputs, gates = _predictions(counts, place, bit)
        x = _mixed(weights, inputs, gates)
        p = 1.0 / (1.0 + np.exp(-x))
        error, slope = (bit - p) * relative, np.maximum(p * (1 - p), 0.01) * relative
        for k in range(CONTEXTS + 1):
            curve[:, k] += 0.03 * share * (np.bincount(gates, weights=slope * inputs[k] ** 2, minlength=GATES) - curve[:, k])
            weights[:, k] += rate * share * np.bincount(gates, weights=error * inputs[k], minlength=GATES) / (curve[:, k] + CURVE_FLOOR)
        cell = (gates * BUCKETS + _bucket(x)) * 2 + bit
        refined += np.bincount(cell, weights=load, minlength=GATES * BUCKETS * 2).reshape(refined.shape)


def log10_scores(words: list[bytes], model: "Tables") -> np.ndarray:
    """log10 probability of every spelling."""
    data, starts = spellings(words)
    return spelled_scores(data, starts, model.lookup(data, starts), model.weights, model.refined)


def spelled_scores(data: np.ndarray, starts: np.ndarray, counts, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 probability of every spelling; ``counts`` gives zeros and ones of a bit position."""
    return np.add.reduceat(byte_scores(data, counts, weights, refined), starts[:-1]) if len(data) else np.zeros(0)


def byte_scores(data: np.ndarray, counts, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 probability of every byte."""
    product = np.ones(len(data))  # of 8 probabilities above 1e-7
    ones, seen = refined[:, :, 1].ravel(), refined.sum(axis=2).ravel() + 20
    for place, (_, bit) in enumerate(bits(data)):
        inputs, gates = _predictions(counts, place, None)
        x = _mixed(weights, inputs, gates)
        cell = gates * BUCKETS + _bucket(x)
        mixed = 1.0 / (1.0 + np.exp(-x))
        p = (3 * mixed + (ones[cell] + mixed * 20) / seen[cell]) / 4
        product *= np.where(bit == 1, p, 1.0 - p)
    return np.log10(product)


class Tables:
    """A small model given as arrays: hashed slot counts, mixing weights, refining table."""

    def __init__(self, counts, weights, refined):
        self.counts, self.weights, self.refined = counts, weights, refined

    def lookup(self, data: np.ndarray, starts: np.ndarray):
        ctx, nodes = contexts(data, starts), [node for node, _ in bits(data)]

        def counts(place):
            index = slots(ctx, nodes[place])
            return tuple(np.stack([self.counts[k, side][index[k]] for k in range(CONTEXTS)]) for side in (0, 1))

        return counts


def path_counts(grams: np.ndarray, sums: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones (8 x wanted) at the bits of the last byte of each gram; ``sums`` are running sums from 0 over sorted ``grams``."""
    zeros, ones = np.empty((8, len(wanted)), dtype=np.float32), np.empty((8, len(wanted)), dtype=np.float32)

    def below(x):
        return sums[np.searchsorted(grams, x)]

    low = wanted & ~np.int64(255)
    first, last = below(low), below(low + 256)
    for k in range(8):
        half = np.int64(128 >> k)
        middle = below(low + half)
        zeros[k], ones[k] = middle - first, last - middle
        up = (wanted & half) != 0
        low, first, last = np.where(up, low + half, low), np.where(up, middle, first), np.where(up, last, middle)
    return zeros, ones


_LEADING = np.array([8 - x.bit_length() for x in range(256)], dtype=np.int64)


def trie_counts(data: np.ndarray, starts: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones (8 x bytes) of the whole word so far among the given words, which are distinct and in byte order."""
    sizes, n = np.diff(starts), len(starts) - 1
    own = np.repeat(copies, sizes).astype(np.float32)
    sides = sides_of(data)
    zeros, ones = own * (sides == 0), own * (sides == 1)
    # Bits that a word shares with the one before it.
    shared, pairs, m = np.zeros(n + 1, dtype=np.int64), np.arange(1, n), 0
    while len(pairs):
        differ = data[starts[pairs - 1] + m] ^ data[starts[pairs] + m]
        shared[pairs] = 8 * m + _LEADING[differ]
        pairs, m = pairs[differ == 0], m + 1
    with_others = np.maximum(shared[:-1], shared[1:])
    active, copies = np.arange(n), copies.astype(np.float64)
    for m in range(int(with_others.max(initial=0)) // 8 + 1):
        active = active[with_others[active] >= 8 * m]
        at, tied, load = starts[active] + m, shared[active], copies[active]
        for k in range(8 if len(active) else 0):
            new = tied < 8 * m + k
            new[0] = True
            runs = np.flatnonzero(new)
            one, both = np.add.reduceat(load * sides[k, at], runs), np.add.reduceat(load, runs)
            words = np.diff(runs, append=len(active))
            ones[k, at], zeros[k, at] = np.repeat(one, words), np.repeat(both - one, words)
    return zeros, ones


def sides_of(data: np.ndarray) -> np.ndarray:
    """The bits (8 x bytes) of the bytes."""
    return np.ascontiguousarray(np.unpackbits(data.astype(np.uint8)).reshape(-1, 8).T)


class Part:
    """The words of one alphabetic part with their counts in all contexts."""

    def __init__(self, data: bytes, copies: np.ndarray, heads: np.ndarray, grams: "Grams"):
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.starts = np.concatenate(([0], np.flatnonzero((self.data == 32) | (self.data == 10)) + 1))
        keys, crossing = gram_keys(self.data, self.starts, heads)
        where = np.flatnonzero(crossing >= 0)
        every = np.concatenate((*keys, crossing[where]))
        order, new = by_value(every)
        wanted, back = every[order[new]], np.empty(len(every), dtype=np.int64)
        back[order] = np.cumsum(new) - 1
        self.bytes, (self.zeros, self.ones) = wanted & 255, grams.counts(wanted)
        self.back = back[:len(keys) * len(self.data)].reshape(len(keys), -1)
        self.whole = trie_counts(self.data, self.starts, copies)
        rest = back[len(keys) * len(self.data):]
        self.whole[0][:, where], self.whole[1][:, where] = self.zeros[:, rest], self.ones[:, rest]
        self.stretched = {}

    def lookup(self, at: np.ndarray | slice = slice(None)) -> "PartCounts":
        """Zeros and ones of the bytes ``at`` by bit position."""
        return PartCounts(self, at)

    def inputs(self, out: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Inputs and levels (8 x grams, then 8 x bytes for the word so far); ``out`` takes each byte out of its own counts once, where it has any."""
        if out not in self.stretched:
            self.stretched[out] = [self._stretched(*counts, data, out) for counts, data in (((self.zeros, self.ones), self.bytes), (self.whole, self.data))]
        return self.stretched[out]

    @staticmethod
    def _stretched(zeros, ones, data, out):
        if out:
            sides = sides_of(data)
            zeros, ones = np.maximum(zeros - (sides == 0), 0), np.maximum(ones - (sides == 1), 0)
        return _stretched(zeros, ones), _levels(zeros + ones).astype(np.uint8)


class PartCounts:
    """Zeros and ones of some bytes of a part by bit position.

    What is worked out from the counts of a gram is worked out once for all bytes that have it.
    """

    def __init__(self, part: Part, at: np.ndarray | slice):
        self.part, self.at, self.back = part, at, part.back[:, at]

    def __call__(self, place: int) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate((table[place][self.back], whole[place][self.at][None]))
                     for table, whole in zip((self.part.zeros, self.part.ones), self.part.whole))

    def predictions(self, place: int, out: bool) -> tuple[np.ndarray, np.ndarray]:
        (grams, gram_levels), (whole, levels) = self.part.inputs(out)
        inputs = np.empty((CONTEXTS + 1, self.back.shape[1]), dtype=np.float32)
        for k, back in enumerate(self.back):
            inputs[k] = grams[place][back]
        inputs[CONTEXTS - 1], inputs[CONTEXTS] = whole[place][self.at], 0.3
        return inputs, gram_levels[place][self.back[-1]].astype(np.int64) * LEVELS + levels[place][self.at]


def gram_keys(data: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Grams of the first four contexts, and of the word so far where it is one of ``heads`` (sorted hashes), else -1."""
    *short, whole = kinds(data, starts)
    byte = data.astype(np.int64)
    keys = [(np.int64(k) << KIND_SHIFT) | (x.view(np.int64) << 8) | byte for k, x in enumerate(short)]
    if not len(heads):
        return keys, np.full(len(data), -1)
    at = np.minimum(np.searchsorted(heads, whole), len(heads) - 1)
    return keys, np.where(heads[at] == whole, (np.int64(len(short)) << KIND_SHIFT) | (at << 8) | byte, -1)


@lru_cache(maxsize=2)
def _held(pieces_: tuple[str, ...]) -> list:
    return [_piece(place) for place in pieces_]


def _piece(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams and their running sums from 0."""
    files, path = store(uri)
    with files.open_input_file(path) as f:
        rows = np.frombuffer(f.read(), dtype=[("gram", "<i8"), ("n", "<f8")])
    return rows["gram"].copy(), np.concatenate(([0.0], np.cumsum(rows["n"])))


class Grams:
    """Sorted files of grams; all grams of a context are in one file."""

    def __init__(self, pieces_: list[tuple[str, int, int, int]]):
        self.pieces = pieces_

    def counts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones (8 x wanted) of sorted distinct grams; those of contexts never seen are 0."""
        zeros, ones = np.zeros((8, len(wanted)), dtype=np.float32), np.zeros((8, len(wanted)), dtype=np.float32)
        places = tuple(p[0] for p in self.pieces)
        keep = sum(p[3] for p in self.pieces) <= HELD_GRAMS
        for i, (place, first, last, _) in enumerate(self.pieces):
            a, b = np.searchsorted(wanted, first & ~255), np.searchsorted(wanted, last | 255, side="right")
            if a < b:
                zeros[:, a:b], ones[:, a:b] = path_counts(*(_held(places)[i] if keep else _piece(place)), wanted[a:b])
        return zeros, ones


def _saved(rows: DataFrame) -> str:
    """Place of the file that the task has written; empty if an empty input had no task."""
    found = rows.first()
    return found["place"] if found else ""


def by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the 64-bit values in an order in which equal ones stand together, first places first; and where another value begins."""
    shift = np.uint64(max(len(values) - 1, 0).bit_length())
    mask = (np.uint64(1) << shift) - np.uint64(1)
    # Values, or their upper bits, with the place below them are sorted much faster than places.
    keys = values.view(np.uint64)
    small = int(keys.max(initial=0)).bit_length() + int(shift) <= 64
    keys = (keys << shift if small else keys & ~mask) | np.arange(len(values), dtype=np.uint64)
    keys.sort()
    order = (keys & mask).astype(np.int64)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[order][1:] != values[order][:-1]
    if not small and (new[1:] & (keys[1:] >> shift == keys[:-1] >> shift)).any():  # different values with the same upper bits
        order = np.argsort(values, kind="stable")
        new[1:] = values[order][1:] != values[order][:-1]
    return order, new


def _distinct(texts: list[bytes], training: list[bool]):
    """(hashes, counts in training texts, words) of the distinct words of a batch, the end included."""
    hashes, lengths, train_flags, chunks, offset = [], [], [], [], 0
    for first, last in pieces(texts):
        data = LOWER[np.frombuffer(b"\n".join(texts[first:last]), dtype=np.uint8)]
        starts, ends = word_spans(data)
        cuts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[first:last]])))
        owner = np.searchsorted(cuts, starts, side="right") - 1
        hashes.append(span_hashes(data, starts, ends))
        train_flags.append(np.array(training[first:last], dtype=bool)[owner] if len(starts) else np.zeros(0, dtype=bool))
        lengths.append(np.stack((starts + offset, ends + offset)))
        chunks.append(data.tobytes())
        offset += len(data)
    if not hashes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    all_hashes, spans, raw = np.concatenate(hashes), np.concatenate(lengths, axis=1), b"".join(chunks)
    order, new = by_value(all_hashes)
    runs = np.flatnonzero(new)
    where = order[runs]
    unique = all_hashes[where]
    count = np.add.reduceat(np.concatenate(train_flags).astype(np.int64)[order], runs) if len(runs) else np.zeros(0, dtype=np.int64)
    words = [raw[a:b] for a, b in zip(spans[0][where].tolist(), spans[1][where].tolist())]
    ends = int(sum(training))
    return (np.concatenate((unique.view(np.int64), [END_HASH])), np.concatenate((count, [ends])), words + [b""])


def word_counts(docs: DataFrame) -> DataFrame:
    """(tok, word, c): every distinct word of ``docs`` (text, training) with its count in training texts."""
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                hashes, counts, words = _distinct(text_bytes(batch.column("text")), batch.column("training").to_pylist())
                for at in range(0, len(words), 50_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[at:at + 50_000]), pa.array(words[at:at + 50_000], pa.binary()), pa.array(counts[at:at + 50_000])],
                        names=["tok", "word", "c"])

    rows = with_column_batches(docs, ["text", "training"], "tok bigint, word binary, c bigint", task)
    return materialise(rows.groupBy("tok").agg(F.first("word").alias("word"), F.sum("c").alias("c")), "lm-words")


def _word_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_WORDS):
            part = batch.slice(at, BATCH_WORDS)
            yield part, part.column("word").to_pylist()


def cuts(words: DataFrame, part_bytes: int) -> list[bytes]:
    """Beginnings of words that cut the distinct words, in byte order, into parts of about ``part_bytes``."""
    size = F.length("word") + 1
    total = int(words.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"])
    rows = int(words.count())
    # About CUT_SAMPLE words of each part reach the driver, cut to CUT_BYTES.
    step = max(1, rows * part_bytes // (CUT_SAMPLE * max(total, 1)))
    if total <= part_bytes:
        return []
    sample = words.where(F.pmod("tok", F.lit(step)) == 0).select(F.substring("word", 1, CUT_BYTES).alias("word"), size.alias("size")).collect()
    out, run = [], 0
    for r in sorted(sample, key=lambda r: bytes(r["word"])):
        if run >= part_bytes:
            out.append(bytes(r["word"]))
            run = 0
        run += r["size"] * step
    return sorted(set(out))


def heads_of(between: list[bytes]) -> np.ndarray:
    """Sorted hashes of all beginnings of the cuts: only they can have words in more than one part."""
    begins = sorted({c[:n] for c in between for n in range(len(c) + 1)})
    data = np.frombuffer(b"".join(begins), dtype=np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(b) for b in begins]))).astype(np.int64)
    return np.unique(span_hashes(data, edges[:-1], edges[1:])) if begins else np.zeros(0, dtype=np.uint64)


def deal(words: DataFrame, between: list[bytes]) -> DataFrame:
    """(toks, copies, data): one row for each alphabetic part with its words spelled one after another in byte order."""
    def number(batches):
        for part, some in _word_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([bisect_right(between, w) for w in some], pa.int32()), *[part.column(c) for c in ("tok", "word", "c")]],
                names=["part", "tok", "word", "c"])

    def spell(rows: pa.Table) -> pa.Table:
        some = rows.column("word").to_pylist()
        spelled = [w + b" " if w else END for w in some]
        order = sorted(range(len(some)), key=spelled.__getitem__)
        tok, c = (rows.column(x).to_numpy()[order] for x in ("tok", "c"))
        return pa.table({"part": rows.column("part")[:1].combine_chunks(), "toks": pa.array([tok], pa.list_(pa.int64())), "copies": pa.array([c], pa.list_(pa.int64())),
                         "data": pa.array([b"".join(spelled[i] for i in order)], pa.binary())})

    numbered = with_column_batches(words, ["tok", "word", "c"], "part int, tok bigint, word binary, c bigint", number)
    return materialise(numbered.groupBy("part").applyInArrow(spell, "part int, toks array<bigint>, copies array<bigint>, data binary"), "lm-parts")


def _parts(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            toks, copies = (batch.column(x)[i].values.to_numpy() for x in ("toks", "copies"))
            yield toks, copies, batch.column("data")[i].as_py()


def count_grams(parts: DataFrame, heads: np.ndarray, folder: str) -> Grams:
    """The grams of all training words with their counts, in sorted files."""
    make_folder(folder)

    def count(batches):
        for _, copies, text in _parts(batches):
            data = np.frombuffer(text, dtype=np.uint8)
            starts = np.concatenate(([0], np.flatnonzero((data == 32) | (data == 10)) + 1))
            load = np.repeat(copies, np.diff(starts))
            keys, crossing = gram_keys(data, starts, heads)
            for key in (*keys, crossing):
                use = (load > 0) & (key >= 0)
                unique, back = np.unique(key[use], return_inverse=True)
                n = np.bincount(back, weights=load[use], minlength=len(unique)).astype(np.int64)
                for at in range(0, len(unique), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(unique[at:at + 100_000]), pa.array(n[at:at + 100_000])], names=["gram", "n"])

    counted = with_column_batches(parts, ["toks", "copies", "data"], "gram bigint, n bigint", count)
    counted = materialise(counted.groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams")
    # A context has at most 256 grams.
    context = F.shiftright("gram", 8)
    dealt = counted.repartitionByRange(max(1, -(-counted.count() // PIECE_GRAMS)), context).sortWithinPartitions("gram")

    def save(batches):
        place, first, last, rows, out = f"{folder}/grams-{uuid.uuid4().hex}", None, None, 0, None
        for batch in batches:
            if batch.num_rows:
                some = np.empty(batch.num_rows, dtype=[("gram", "<i8"), ("n", "<f8")])
                some["gram"], some["n"] = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
                if out is None:
                    files, path = store(place)
                    out, first = files.open_output_stream(path, compression=None), int(some["gram"][0])
                out.write(some.tobytes())
                last, rows = int(some["gram"][-1]), rows + len(some)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"place": place, "first": first, "last": last, "rows": rows}])

    # Only places and ends of the files reach the driver.
    found = with_column_batches(dealt, ["gram", "n"], "place string, first bigint, last bigint, rows bigint", save).collect()
    return Grams(sorted((tuple(r) for r in found), key=lambda p: p[1]))


def fit(parts: DataFrame, heads: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights and refining table, learned online by every group of parts and averaged."""
    groups = max(1, -(-parts.count() // GROUP_PARTS))

    def learn(batches):
        group, state = None, None
        for batch in batches:
            for number, (toks, copies, text) in zip(batch.column("group").to_pylist(), _parts([batch])):
                if number != group:
                    yield from learned(state)
                    group = number
                    state = {"weights": start_weights(), "refined": np.zeros((GATES, BUCKETS, 2)), "curve": np.full(start_weights().shape, CURVE_START),
                             "mass": 0.0, "seen": 0, "usual": 0.0}
                learn_part(state, toks, copies, text)
        yield from learned(state)

    def learn_part(state, toks, copies, text):
        known = np.flatnonzero(copies)
        if not len(known):
            return
        part = Part(text, copies, heads, grams)
        known = known[np.argsort(toks[known])]  # by hash, so that a step sees words of the whole part
        for some, loads in steps(copies, known):
            first = part.starts[some] + BORDER_BYTES
            sizes = np.maximum(part.starts[some + 1] - first, 0)
            if not sizes.any():
                continue
            at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            load = np.repeat(loads, sizes)
            state["usual"] += (load.sum() - state["usual"]) / (state["seen"] + 1)
            train(part.data[at], part.lookup(at), load, state["weights"], state["refined"], state["curve"], state["seen"], state["usual"])
            state["seen"] += 1
        state["mass"] += float(copies.sum())

    def learned(state):
        if state and state["mass"]:
            values = np.concatenate(([state["mass"]], state["weights"].ravel() * state["mass"], state["refined"].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "value"])

    grouped = parts.withColumn("group", F.col("part") % groups)
    dealt = grouped.repartition(groups, "group").sortWithinPartitions("group", "part")
    values = with_column_batches(dealt, ["toks", "copies", "data", "group"], "at int, value double", learn)
    # Sums of fixed size, however many groups there are.
    sums = {r["at"]: r["value"] for r in values.groupBy("at").agg(F.sum("value").alias("value")).collect()}
    weights = start_weights()
    if not sums:
        return weights, np.zeros((GATES, BUCKETS, 2))
    flat = np.array([sums[i] for i in range(len(sums))])
    return flat[1:1 + weights.size].reshape(weights.shape) / flat[0], flat[1 + weights.size:].reshape(GATES, BUCKETS, 2)


def score_words(parts: DataFrame, heads: np.ndarray, grams: Grams, weights: np.ndarray, refined: np.ndarray) -> DataFrame:
    """(tok, c, lm): the log10 score of every distinct word behind its first two bytes."""
    def task(batches):
        for toks, copies, text in _parts(batches):
            part = Part(text, copies, heads, grams)
            sizes = np.diff(part.starts)
            at = np.flatnonzero(np.arange(len(part.data)) - np.repeat(part.starts[:-1], sizes) >= BORDER_BYTES)
            lm = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at], byte_scores(part.data[at], part.lookup(at), weights, refined), len(sizes))
            for at in range(0, len(toks), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at:at + 50_000]) for x in (toks, copies, lm)], names=["tok", "c", "lm"])

    return materialise(with_column_batches(parts, ["toks", "copies", "data"], "tok bigint, c bigint, lm double", task), "lm-scores")


@lru_cache(maxsize=2)
def _dictionary(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not uri:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    files, path = store(uri)
    with files.open_input_file(path) as f:
        rows = np.frombuffer(f.read(), dtype=[("tok", "<i8"), ("c", "<i8"), ("lm", "<f8")])
    rows = rows[np.argsort(rows["tok"])]
    return rows["tok"].copy(), rows["c"].copy(), rows["lm"].copy()


class Places:
    """Places of 64-bit hashes in their sorted array, from the first place for each beginning of FIRST_BITS bits."""

    FIRST_BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.shift = hashes, np.uint64(64 - self.FIRST_BITS)
        # Signed order: the beginnings of negative numbers come first.
        first = (np.arange(1 << self.FIRST_BITS, dtype=np.int64) - (1 << self.FIRST_BITS - 1)) << int(self.shift)
        self.first = np.roll(np.minimum(np.searchsorted(hashes, first), max(len(hashes) - 1, 0)).astype(np.int32), 1 << self.FIRST_BITS - 1)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, or any other place if it is not there; 0 in an empty array."""
        at = self.first[(wanted.view(np.uint64) >> self.shift).astype(np.int64)].astype(np.int64)
        more = np.flatnonzero(self.hashes[at] < wanted) if len(self.hashes) else []
        while len(more):
            at[more] += 1
            more = more[at[more] < len(self.hashes) - 1]
            more = more[self.hashes[at[more]] < wanted[more]]
        return np.minimum(at, max(len(self.hashes) - 1, 0))


def save_frequent(scored: DataFrame, frequent: int, folder: str) -> str:
    """The ``frequent`` most frequent training words as one file: a bounded dictionary for the scan."""
    make_folder(folder)
    place = f"{folder}/frequent"
    top = scored.where("c > 0").orderBy(F.desc("c"), "tok").limit(frequent)

    def save(batches):
        files, path = store(place)
        with files.open_output_stream(path, compression=None) as out:
            for batch in batches:
                rows = np.empty(batch.num_rows, dtype=[("tok", "<i8"), ("c", "<i8"), ("lm", "<f8")])
                for c in ("tok", "c", "lm"):
                    rows[c] = batch.column(c).to_numpy()
                out.write(rows.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([place])], names=["place"])

    return _saved(with_column_batches(top.coalesce(1), ["tok", "c", "lm"], "place string", save))


def tokens(texts: list[bytes]):
    """(first text, hashes, spelled bytes, border grams, bounds) of pieces of texts; every text has an end behind its words.

    Border grams (bytes x tokens) are the two bytes before and the first byte, and the byte before the blank with the first two bytes.
    """
    for first, last in pieces(texts):
        data = LOWER[np.frombuffer(b"\n".join(texts[first:last]), dtype=np.uint8)]
        starts, ends = word_spans(data)
        cuts_ = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[first:last]])))
        bounds = np.searchsorted(starts, cuts_)
        single = ends - starts == 1
        wide = data.astype(np.int64)
        second = np.where(single, 32, wide[np.minimum(starts + 1, len(data) - 1)]) if len(starts) else starts
        before = np.where(single, 32, wide[np.maximum(ends - 2, 0)]) if len(starts) else starts
        begin = np.insert(wide[starts] << 8 | second, bounds[1:], END_BYTES)
        finish = np.insert(before << 8 | wide[ends - 1], bounds[1:], END_BYTES)
        left = np.concatenate(([END_BYTES], finish[:-1]))
        hashes = np.insert(span_hashes(data, starts, ends).view(np.int64), bounds[1:], END_HASH)
        sizes = np.insert(ends - starts + 1, bounds[1:], 1)
        yield first, hashes, sizes, np.stack((left << 8 | begin >> 8, (left & 255) << 16 | begin)), bounds + np.arange(last - first + 1)


def border_counts(docs: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both bytes: sorted border grams of the training texts and their counts; at most 2**24 of each."""
    def added(held):
        grams, counts = (np.concatenate(x) for x in zip(*held))
        unique, back = np.unique(grams, return_inverse=True)
        return unique, np.bincount(back, weights=counts, minlength=len(unique)).astype(np.int64)

    def task(batches):
        held, size = [], 0
        for batch in batches:
            texts = [t for t, use in zip(text_bytes(batch.column("text")), batch.column("training").to_pylist()) if use]
            for _, hashes, _, grams, _ in tokens(texts):
                some = np.concatenate((grams[0], 1 << 24 | grams[1][hashes != END_HASH])).astype(np.int32)
                held.append(np.unique(some, return_counts=True))
                size += len(held[-1][0])
                if size > HELD_BORDERS:
                    held = [added(held)]
                    size = 0
        if held:
            grams, counts = added(held)
            for at in range(0, len(grams), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(grams[at:at + 100_000], pa.int64()), pa.array(counts[at:at + 100_000])], names=["gram", "n"])

    counted = with_column_batches(docs, ["text", "training"], "gram bigint, n bigint", task)
    found = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    grams, counts = (found.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order].astype(np.float64)
    cut = np.searchsorted(grams, 1 << 24)
    return [(grams[:cut], counts[:cut]), (grams[cut:] & 0xFFFFFF, counts[cut:])]


class Border:
    """One byte behind a border, mixed from contexts of no, one and two bytes; ``grams`` are those bytes and the byte itself."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.tables = []
        for k in range(BORDER_CONTEXTS):
            unique, back = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.tables.append((unique, np.concatenate(([0.0], np.cumsum(np.bincount(back, weights=counts, minlength=len(unique)))))))
        self.weights = np.full((GATES, BORDER_CONTEXTS + 1), 0.4)
        self.weights[:, BORDER_CONTEXTS] = 0.0
        self.grams = grams
        if len(grams):
            self._fit(grams, counts)
        self.known, self.table = self.scores(grams), None

    def _inputs(self, wanted: np.ndarray, out: bool):
        """Inputs (bits x contexts + 1), gates and bits of the last byte of each gram, which ``out`` takes out of the counts once."""
        bit = np.unpackbits((wanted & 255).astype(np.uint8)).reshape(-1, 8)
        inputs, totals = np.empty((len(wanted), 8, BORDER_CONTEXTS + 1)), []
        inputs[:, :, BORDER_CONTEXTS] = 0.3
        for k, (grams, sums) in enumerate(self.tables):
            zeros, ones = (x.T.astype(np.float64) for x in path_counts(grams, sums, wanted & ((1 << 8 * (k + 1)) - 1)))
            if out:
                zeros, ones = zeros - (bit == 0), ones - (bit == 1)
            inputs[:, :, k] = np.clip(np.log((ones + DELTA) / (zeros + DELTA)), -12, 12)
            totals.append(zeros + ones)
        one, two = (np.minimum(np.log2(t + 1).astype(np.int64) // 2, LEVELS - 1) for t in totals[1:])
        return inputs.reshape(-1, BORDER_CONTEXTS + 1), (one * LEVELS + two).ravel(), bit.ravel()

    def _fit(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Newton steps over all grams with all their copies, drawn a little towards the first weights."""
        inputs, gates, bit = self._inputs(grams, True)
        load, start, n = np.repeat(counts, 8), self.weights.copy(), BORDER_CONTEXTS + 1
        pull = 1e-3 * np.bincount(gates, weights=load, minlength=GATES) + 1e-9
        for _ in range(BORDER_ROUNDS):
            p = 1.0 / (1.0 + np.exp(-np.clip((self.weights[gates] * inputs).sum(axis=1), -14, 14)))
            slope = load * np.maximum(p * (1 - p), 1e-4)
            grad = np.stack([np.bincount(gates, weights=load * (bit - p) * inputs[:, i], minlength=GATES) for i in range(n)], axis=1)
            bend = np.empty((GATES, n, n))
            for i in range(n):
                for j in range(i, n):
                    bend[:, i, j] = bend[:, j, i] = np.bincount(gates, weights=slope * inputs[:, i] * inputs[:, j], minlength=GATES)
            grad -= pull[:, None] * (self.weights - start)
            bend += pull[:, None, None] * np.eye(n)
            self.weights += np.clip(np.linalg.solve(bend, grad[:, :, None])[:, :, 0], -1, 1)

    def scores(self, wanted: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram behind its others."""
        if not len(wanted):
            return np.zeros(0)
        inputs, gates, bit = self._inputs(wanted, False)
        x = np.clip((self.weights[gates] * inputs).sum(axis=1), -14, 14)
        return (-np.log1p(np.exp(np.where(bit == 1, -x, x))) / math.log(10)).reshape(-1, 8).sum(axis=1)

    def lookup(self, wanted: np.ndarray) -> np.ndarray:
        """``scores`` that takes seen grams from a table over the bytes that occur in each of the three places."""
        if self.table is None:  # made in the task
            used = [np.unique(self.grams >> shift & 255) for shift in (16, 8, 0)]
            self.places = [np.full(256, len(u)) for u in used]
            for place, u in zip(self.places, used):
                place[u] = np.arange(len(u))
            self.table = np.full([len(u) + 1 for u in used], np.nan)
            self.table[self._cells(self.grams)] = self.known
        out = self.table[self._cells(wanted)]
        new = np.isnan(out)
        rest, back = np.unique(wanted[new], return_inverse=True)
        out[new] = self.scores(rest)[back]
        return out

    def _cells(self, grams: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(place[grams >> shift & 255] for place, shift in zip(self.places, (16, 8, 0)))


def border_scores(borders: list[Border], grams: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """log10 probability of the first two bytes of each token; the end has one."""
    return borders[0].lookup(grams[0]) + np.where(hashes == END_HASH, 0.0, borders[1].lookup(grams[1]))


def text_so_far(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before each token in its text, and how many of them are the same."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order, new = by_value(hashes ^ mix64(owner.astype(np.uint64)).view(np.int64))
    starts = np.flatnonzero(new)
    same = np.empty(len(hashes), dtype=np.int64)
    same[order] = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    return np.arange(len(hashes)) - bounds[owner], same


def text_gates(before: np.ndarray) -> np.ndarray:
    """Gate by the number of tokens before, which is 1 or more."""
    return np.minimum(np.log2(np.maximum(before, 1)).astype(np.int64), TEXT_GATES - 1)


def ratio_cells(gates: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    return gates * CELLS + np.clip(np.rint(ratios * CELLS_A_UNIT) + CELL_ZERO, 1, CELLS - 1).astype(np.int64)


def text_odds(histogram: np.ndarray) -> np.ndarray:
    """Odds of the text so far by gate, most likely for the training tokens (expectation steps); cell 0 are the tokens that stand nowhere before."""
    share = np.full((TEXT_GATES, 1), 0.1)
    ratio = 10.0 ** ((np.arange(CELLS) - CELL_ZERO) / CELLS_A_UNIT)
    ratio[0] = 0.0
    n = histogram.reshape(TEXT_GATES, CELLS).astype(np.float64)
    for _ in range(TEXT_ROUNDS):
        share = (n * share * ratio / (1 - share + share * ratio)).sum(axis=1, keepdims=True) / (n.sum(axis=1, keepdims=True) + 1)
    return (share / (1 - share))[:, 0]


def scan_texts(docs: DataFrame, borders: list[Border], known: str, below: float) -> DataFrame:
    """One row for each text: sums over its frequent words, its other words, and what the text so far says."""
    def task(batches):
        tok, c, lm = _dictionary(known)
        places = Places(tok)
        log_c = np.log10((c + 0.5) / below)
        out_once = np.log10(np.maximum(c - 1, 0.5) / np.maximum(c, 1))
        for batch in batches:
            for first, hashes, sizes, grams, bounds in tokens(text_bytes(batch.column("text"))):
                keys = {x: batch.column(x).slice(first, len(bounds) - 1) for x in ("doc_id", "held_out", "training", "key")}
                at = places.of(hashes)
                inside = tok[at] == hashes if len(tok) else np.zeros(len(hashes), dtype=bool)
                border = border_scores(borders, grams, hashes)
                before, same = text_so_far(hashes, bounds)
                gates = text_gates(before)
                seen = same > 0
                share = np.log10(np.maximum(same, 1) / np.maximum(before, 1)) - border

                def sums(values, bounds=bounds):
                    return np.add.reduceat(values, bounds[:-1])

                def lists(values, rows, kind, bounds=bounds):
                    ends = np.searchsorted(rows, bounds)
                    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

                base = np.where(inside, log_c[at], 0.0) if len(c) else np.zeros(len(hashes))
                model = border + (np.where(inside, lm[at], 0.0) if len(c) else 0.0)
                again = np.flatnonzero(seen & inside)
                ratios = share[again] - lm[at[again]] if len(c) else np.zeros(0)
                pairs = np.empty(len(again), dtype=SEEN)
                pairs["gate"], pairs["ratio"] = gates[again], ratios
                raw, ends = pairs.tobytes(), np.searchsorted(again, bounds) * SEEN.itemsize
                rest = np.flatnonzero(~inside)
                training = np.repeat(keys["training"].to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                fresh = np.flatnonzero(training & ~seen & (before > 0))
                use = training[again]
                out = out_once[at[again]] if len(c) else ratios
                cells = np.concatenate((gates[fresh] * CELLS, ratio_cells(gates[again], ratios - out)[use]))
                cell, n = np.unique(cells, return_counts=True)
                # The cells of a piece stand in the row of its first text.
                first_only = np.concatenate(([0], np.full(len(bounds) - 1, len(cell))))
                yield pa.RecordBatch.from_arrays(
                    [keys["doc_id"], keys["held_out"], keys["training"], keys["key"], pa.array(np.diff(bounds)), pa.array(sums(sizes)),
                     pa.array(sums(inside.astype(np.int64))), pa.array(sums(base)), pa.array(sums(model)),
                     pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                     lists(hashes[rest], rest, pa.int64()), lists(np.where(seen, gates, -1)[rest], rest, pa.int32()),
                     lists(share[rest], rest, pa.float64()),
                     *[pa.ListArray.from_arrays(pa.array(first_only, pa.int32()), pa.array(x, pa.int64())) for x in (cell, n)]],
                    names=["doc_id", "held_out", "training", "key", "n_tokens", "n_bytes", "known", "base", "lm", "seen", "toks", "gates", "shares", "cells", "cell_n"])

    return materialise(with_column_batches(
        docs, ["doc_id", "held_out", "training", "key", "text"],
        "doc_id bigint, held_out boolean, training boolean, key bigint, n_tokens bigint, n_bytes bigint, known bigint, base double, lm double, seen binary, "
        "toks array<bigint>, gates array<int>, shares array<double>, cells array<bigint>, cell_n array<bigint>", task), "lm-texts")


def score_documents(docs: DataFrame, frequent: int = FREQUENT, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    fold = crc_mod_5()
    docs = docs.select("doc_id", "text", F.coalesce(fold != 1, F.lit(False)).alias("training"),
                       F.coalesce(fold == 1, F.lit(False)).alias("held_out"), F.xxhash64("doc_id", "text").alias("key"))
    words = word_counts(docs)
    folder = fresh_folder(spark, "lm")
    between = cuts(words, part_bytes)
    heads, parts = heads_of(between), deal(words, between)
    grams = count_grams(parts, heads, folder)
    scored = score_words(parts, heads, grams, *fit(parts, heads, grams))
    total = scored.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    below = n + 0.5 * (v + 1)
    borders = [Border(*x) for x in border_counts(docs)]
    texts = scan_texts(docs, borders, save_frequent(scored, frequent, folder), below)

    other = F.explode(F.arrays_zip("toks", "gates", "shares")).alias("w")
    rare = texts.select("key", "training", other).select(
        "key", "training", F.col("w.toks").alias("tok"), F.col("w.gates").alias("gate"), F.col("w.shares").alias("share"))
    rare = materialise(rare.join(scored, "tok").select("key", "training", "gate", "c", "lm", (F.col("share") - F.col("lm")).cast("float").alias("ratio")), "lm-rare")
    # Two histograms of fixed size.
    left_out = F.log10(F.greatest(F.col("c") - 1, F.lit(0.5)) / F.greatest("c", F.lit(1)))
    place = F.greatest(F.least(F.rint((F.col("ratio").cast("double") - left_out) * CELLS_A_UNIT) + CELL_ZERO, F.lit(CELLS - 1.0)), F.lit(1.0)).cast("long")
    counted = rare.where("training and gate >= 0").select((F.col("gate") * CELLS + place).alias("cell"), F.lit(1).cast("long").alias("n")).unionByName(
        texts.select(F.explode(F.arrays_zip("cells", "cell_n")).alias("h")).select(F.col("h.cells").alias("cell"), F.col("h.cell_n").alias("n")))
    histogram = np.zeros(TEXT_GATES * CELLS)
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        histogram[r["cell"]] = r["n"]
    odds = text_odds(histogram)
    # log10 of the odds that a text so far has against the words, and of the share that is left to the words.
    log_odds, left = np.log10(np.maximum(odds, 1e-300)), -np.log10(1 + odds)

    def with_text(batches):
        for batch in batches:
            counts = batch.column("n_tokens").to_numpy()
            # A gate holds the tokens before which at least 2**gate tokens stand, and fewer than in the next gate.
            edges = np.append(2.0 ** np.arange(TEXT_GATES), np.inf)
            held = np.diff(np.minimum(edges[None], np.maximum(counts[:, None], 1)), axis=1)
            more = held @ left
            for i, raw in enumerate(batch.column("seen")):
                pairs = np.frombuffer(raw.as_py(), dtype=SEEN)
                more[i] += np.logaddexp(0, (log_odds[pairs["gate"]] + pairs["ratio"]) * math.log(10)).sum() / math.log(10)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("doc_id", "held_out", "key", "n_tokens", "n_bytes", "known", "base")],
                                              pa.array(batch.column("lm").to_numpy() + more)],
                                             names=["doc_id", "held_out", "key", "n_tokens", "n_bytes", "known", "base", "lm"])

    head = with_column_batches(texts, ["doc_id", "held_out", "key", "n_tokens", "n_bytes", "known", "base", "lm", "seen"],
                               "doc_id bigint, held_out boolean, key bigint, n_tokens bigint, n_bytes bigint, known bigint, base double, lm double", with_text)
    against = F.get(F.array(*map(F.lit, log_odds.tolist())), F.col("gate")) + F.col("ratio").cast("double")
    gain = F.when(F.col("gate") < 0, 0.0).when(against > 30, against).otherwise(F.log10(1 + F.pow(F.lit(10.0), against)))
    sums = rare.groupBy("key").agg(
        F.sum(F.log10((F.col("c") + 0.5) / below)).alias("base_2"), F.sum(F.col("lm") + gain).alias("lm_2"),
        F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("known_2"))
    # Equal rows share a key, so the sums over rare words hold them all.
    rows = head.groupBy("key").agg(*[F.first(x).alias(x) for x in ("doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "lm")], F.count("*").alias("k"))
    out = rows.join(sums, "key", "left")

    def both(a, b, kind):
        return (F.col(a) + F.coalesce(F.col(b), F.lit(0)) / F.col("k")).cast(kind)

    out = out.select("doc_id", "held_out", "n_tokens", both("known", "known_2", "long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                     both("base", "base_2", "double").alias("base_score"), both("lm", "lm_2", "double").alias("score"), "n_bytes", "k")
    out = out.withColumn("bits_per_byte", -F.col("score") / math.log10(2) / F.col("n_bytes")).drop("n_bytes")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("_")).drop("k", "_")


@query("op8_context_mixing")
def context_mixing(spark: SparkSession, folder: str):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_documents(docs)
