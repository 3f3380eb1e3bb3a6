"""MinHash near-duplicates by SetSketch registers: banded candidates, joint likelihood, exact confirmation.

A document's set holds its distinct 5-word shingles (A-Z lower-cased); a shorter text is one shingle of all its words,
and a text without words is empty and linked with nothing.  Two documents are linked if 100 * |A & B| >= 75 * |A | B|.

1. Every set gets 128 registers: the smallest exponential value of its shingles under a register's hash, on an
   exponential scale (base 1.02), truncated to 12 bits.  The registers of a union are the larger of both.
2. Equal sets are one class, represented by its smallest id, so exact copies are never compared.
3. Four registers are a band.  Classes that share a band's bucket, directly or in a chain, are a family; a bucket is tied
   together by one row for each member, so a bucket of any size makes no pairs of rows.
4. A family is dealt into blocks, a large one into blocks of similar set sizes, since 75 % needs sizes within 4 : 3; a task
   gets one pair of blocks whose sizes allow a link.  It keeps the pairs whose registers (larger,
   smaller, equal, given both set sizes) do not rule 0.75 out by their joint likelihood, confirms those on the full sets unless both
   are connected already, and gives only the links that connect something: fewer than the rows it has read.
5. Components of these links and of the copies give the result.  No bucket, family or pair is capped or dropped.

A pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6, higher ones less; every reported link is exact.

Null texts count as empty; rows without an id are linked with nothing, their component_id is null and they are kept.
Repeated rows are one node.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import (carrying, 
    bits_set, fresh_folder, hashed_words, load_bits, materialise, mix64, save_bits, sliced, table, text_bytes,
    with_column_batches)
from vocspark.llm.components import components
from vocspark.llm.registry import query

SHINGLE_WORDS = 5
SHARE, OF = 75, 100
REGISTERS = 128
BAND = 4
BASE = 1.02
TOP = 4095
SHIFT = 200.0
# A candidate is dropped if 0.75 or more is this many times less likely (natural logarithm) than the best estimate.
DOUBT = 14.0
# A block of a family has about so many classes, and about so many shingles, at most.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
# A family of more blocks is cut by set size first: sizes of one level, or of two levels side by side, hold all that lie within
# OF : SHARE.  Levels are a little wider than that, so that rounding parts nothing.
WHOLE_BLOCKS = 3
LEVEL = math.log(OF / SHARE) * 1.000001
WANTED_BITS = 26
# So many ids or fewer are broadcast to drop documents; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_MULTIPLIERS = (mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLACE = mix64(np.arange(101, 101 + SHINGLE_WORDS, dtype=np.uint64)) | np.uint64(1)
_GRID = np.linspace(0.0, 1.0, 101)


def _combined(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return mix64(words * places)


def shingle_sets(texts: list[bytes]):
    """(index, sorted distinct 64-bit shingle hashes) of every text."""
    for first, words, bounds in hashed_words(texts):
        n = len(words)
        if n >= SHINGLE_WORDS:
            rolled = np.zeros(n - SHINGLE_WORDS + 1, dtype=np.uint64)
            for k in range(SHINGLE_WORDS):
                rolled += words[k:n - SHINGLE_WORDS + 1 + k] * _PLACE[k]
            rolled = mix64(rolled)
        for k in range(len(bounds) - 1):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b - a >= SHINGLE_WORDS:
                yield first + k, np.unique(rolled[a:b - SHINGLE_WORDS + 1])
            elif b > a:
                whole = (words[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield first + k, mix64(np.array([whole], dtype=np.uint64))
            else:
                yield first + k, words[:0]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set; those of an empty set are 0."""
    if not len(shingles):
        return np.zeros(REGISTERS, dtype="<u2")
    low = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(keys), 1024):
        np.minimum(low, (keys[at:at + 1024, None] * _MULTIPLIERS).min(axis=0), out=low)
    value = -np.log1p(-(low + 0.5) / 2.0 ** 32)
    return np.clip(np.floor(SHIFT - np.log(value) / np.log(BASE)), 1, TOP).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, None) * (BASE - 1) / BASE) / np.log(BASE)


def possible(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches (rows) leave a similarity of 0.75 or more open; sizes are the exact set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    # Logarithms are taken once for each share of the sizes.
    shares, at = np.unique(size_a / (size_a + size_b), return_inverse=True)
    u = shares[:, None]
    v, j = 1 - u, _GRID[None, :]
    tiny = 1e-9
    up, down = _share(u - v * j), _share(v - u * j)
    log_likelihood = (more[:, None] * np.log(np.maximum(up, tiny))[at] + less[:, None] * np.log(np.maximum(down, tiny))[at]
                      + same[:, None] * np.log(np.maximum(1 - up - down, tiny))[at])
    log_likelihood[(j > np.minimum(u, v) / np.maximum(u, v) + 0.02)[at]] = -np.inf
    return log_likelihood[:, _GRID >= SHARE / OF - 1e-9].max(axis=1) >= log_likelihood.max(axis=1) - DOUBT


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, two fingerprints of the set, its sketch) of ``docs`` (doc_id, text); texts are only read."""
    def task(batches):
        for batch in sliced(batches):
            texts = text_bytes(batch.column("text"))
            n = np.zeros(len(texts), dtype=np.int64)
            one, two = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            out = [b""] * len(texts)
            for i, shingles in shingle_sets(texts):
                n[i] = len(shingles)
                one[i] = mix64(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)
                two[i] = np.bitwise_xor.reduce(mix64(shingles + np.uint64(77)), initial=np.uint64(0)).astype(np.int64)
                out[i] = sketch(shingles).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(one), pa.array(two), pa.array(out, pa.binary())],
                                             names=["doc_id", "n_shingles", "print_1", "print_2", "sketch"])

    return with_column_batches(docs, ["doc_id", "text"], "doc_id bigint, n_shingles bigint, print_1 bigint, print_2 bigint, sketch binary", task)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, id): one row for each band of each class."""
    bands = REGISTERS // BAND

    def task(batches):
        for batch in batches:
            rows = _registers(batch.column("sketch")).astype(np.uint64).reshape(-1, bands, BAND)
            packed = np.zeros(rows.shape[:2], dtype=np.uint64)
            for k in range(BAND):
                packed = (packed << np.uint64(12)) | rows[:, :, k]
            keys = mix64(packed + (np.arange(bands, dtype=np.uint64) << np.uint64(56)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), bands))], names=["key", "id"])

    return with_column_batches(classes, ["id", "sketch"], "key bigint, id bigint", task)


class _Union(dict):
    """Disjoint sets of row numbers."""

    def root(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, x: int, y: int) -> None:
        self[self.root(x)] = self.root(y)


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    """Are two sorted sets similar enough?  Decided on the full sets."""
    if not len(one) or not len(two):
        return False
    if len(one) > len(two):
        one, two = two, one
    places = np.minimum(np.searchsorted(two, one), len(two) - 1)
    common = int((two[places] == one).sum())
    return OF * common >= SHARE * (len(one) + len(two) - common)


def block_links(first: list[int], second: list[int], sets: list[np.ndarray], registers: np.ndarray) -> list[tuple[int, int]]:
    """Confirmed links between two blocks of rows (or within one) that connect something not connected before."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    same, union, out = first == second, _Union(), []
    second_rows = np.array(second, dtype=np.int32)
    pairs = []
    for k, i in enumerate(first):
        others = second_rows[k + 1:] if same else second_rows
        fits = OF * np.minimum(sizes[i], sizes[others]) >= SHARE * np.maximum(sizes[i], sizes[others])
        others = others[fits]
        if len(others):
            open_ = others[possible(np.broadcast_to(registers[i], (len(others), REGISTERS)), registers[others],
                                    np.full(len(others), sizes[i]), sizes[others])]
            if len(open_):
                pairs.append((np.full(len(open_), i, dtype=np.int32), open_, (registers[i] == registers[open_]).sum(axis=1).astype(np.uint8)))
    if not pairs:
        return out
    # The most similar pairs come first; they connect most rows, and connected pairs need no confirmation.
    one, other, equal = (np.concatenate(x) for x in zip(*pairs))
    order = np.argsort(REGISTERS - equal, kind="stable")
    for at in range(0, len(order), 4096):
        some = order[at:at + 4096]
        for i, j in zip(one[some].tolist(), other[some].tolist()):
            if union.root(i) != union.root(j) and linked(sets[i], sets[j]):
                union.join(i, j)
                out.append((i, j))
    return out


def _grouped(batches, keys: list[str], columns: list[str]):
    """Consecutive rows of equal keys, also across batches: (key, lists of the columns)."""
    now, held = None, [[] for _ in columns]
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in keys))):
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, [[] for _ in columns]
            for into, v in zip(held, values):
                into.append(v[k])
    if now is not None:
        yield now, held


def block_pairs(sized: DataFrame) -> DataFrame:
    """(id, family, lo, hi, mine): every class of ``sized`` (id, family, n) in each pair of blocks that it takes part in."""
    number = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    large = sized.groupBy("family").agg(number.alias("blocks")).where(F.col("blocks") > WHOLE_BLOCKS).select("family", F.lit(True).alias("large"))
    level = F.when(F.col("large"), F.floor(F.log("n") / LEVEL)).otherwise(0).cast("long")
    levelled = sized.join(large, "family", "left").select("id", "family", "n", level.alias("level"))
    blocks = levelled.groupBy("family", "level").agg(number.alias("blocks"))
    # A level meets itself and those beside it; a block is named by its level and its number there.
    beside = blocks.select("family", F.explode(F.array(*[F.col("level") + k for k in (-1, 0, 1)])).alias("level"), F.col("level").alias("theirs"), "blocks")
    met = blocks.withColumnRenamed("blocks", "own").join(beside, ["family", "level"]).groupBy("family", "level").agg(
        F.first("own").alias("own"), F.collect_list(F.struct("theirs", "blocks")).alias("met"))

    def name(of: str, at):
        return F.shiftleft(F.col(of), 32) + at

    placed = levelled.join(met, ["family", "level"]).withColumn("mine", name("level", F.pmod(F.xxhash64("id"), "own"))).select(
        "id", "family", "mine", F.explode("met").alias("m")).select("id", "family", "mine", "m.*")
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("other", name("theirs", F.col("other"))).select(
        "id", "family", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")


def family_links(families: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): confirmed links that connect the classes of each family; ``families`` has (id, family)."""
    places = block_pairs(families.join(classes.select("id", "n"), "id"))

    # Texts are never shuffled: a bitmap of fixed size passes the wanted documents, and few others, to the join.
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << WANTED_BITS).cast("long"))
    place = save_bits(families.select(bit.alias("bit")), "bit", WANTED_BITS, fresh_folder(docs.sparkSession, "near-wanted"))

    def build(batches):
        for batch in sliced(batches):
            batch = batch.filter(pa.array(bits_set(load_bits(place), batch.column("bit").to_numpy())))
            texts = text_bytes(batch.column("text"))
            sets, registers = [b""] * len(texts), [b""] * len(texts)
            for i, shingles in shingle_sets(texts):
                sets[i], registers[i] = shingles.tobytes(), sketch(shingles).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sets, pa.binary()), pa.array(registers, pa.binary())], names=["id", "shingles", "sketch"])

    some = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").withColumn("bit", bit)
    sets = with_column_batches(some, ["id", "bit", "text"], "id bigint, shingles binary, sketch binary", build)
    dealt = places.join(sets, "id").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")

    def task(batches):
        for (_, lo, hi), (mine, ids, shingles, registers) in _grouped(
                batches, ["family", "lo", "hi"], ["mine", "id", "shingles", "sketch"]):
            first, second = ([k for k, m in enumerate(mine) if m == side] for side in (lo, hi))
            found = block_links(first, second, [np.frombuffer(x, dtype=np.uint64) for x in shingles],
                                np.frombuffer(b"".join(registers), dtype="<u2").reshape(-1, REGISTERS))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in a], pa.int64()), pa.array([ids[k] for k in b], pa.int64())], names=["a", "b"])

    return with_column_batches(dealt, ["family", "lo", "hi", "mine", "id", "shingles", "sketch"], "a bigint, b bigint", task)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    marked = materialise(sketches(docs), "near-sketches")
    named = marked.where("doc_id IS NOT NULL AND n_shingles > 0")
    prints = ["n_shingles", "print_1", "print_2"]
    classes = materialise(named.groupBy(*prints).agg(F.min("doc_id").alias("id"), F.min_by("sketch", "doc_id").alias("sketch"))
                          .withColumnRenamed("n_shingles", "n"), "near-classes")
    copies = named.join(classes.withColumnRenamed("n", "n_shingles"), prints).where("doc_id <> id").select(
        F.col("doc_id").alias("a"), F.col("id").alias("b"))

    rows = band_keys(classes)
    shared = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "lo")
    ties = rows.join(shared, "key").where("id > lo").select("id", "lo").distinct()
    families = components(ties, "id", "lo").withColumnRenamed("component_id", "family")
    links = family_links(families, classes, docs)
    found = components(links.union(copies), "a", "b")
    out = marked.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


@carrying
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, that of the smallest id."""
    drop = materialise(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "near-drop")
    small = drop.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(drop) if small else drop, "doc_id", "left_anti").select(*docs.columns)


@query("op6_minhash_near_dedup")
def minhash_near_dedup(spark, folder):
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
