"""Which keywords of at most ``LONGEST`` code points a text contains, looked up by hash from every place of the text.

A keyword is packed exactly into two numbers of three code points each.  The packed keywords lie in part files in the shared folder,
each of about ``PART`` keywords; a task reads them as they are (from a local disk by memory map) and looks up the runs of its own texts.  So no text, run
or candidate is shuffled, memory does not depend on the number of keywords, and one list of ``PART`` keywords or fewer is one look-up from a place and size.
Texts are cut into pieces of ``PIECE`` places that reach over their ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.session import scratch_path, ship_package

LONGEST = 6
PART = 1 << 20
PIECE = 1 << 19
# Rows of a batch of found pairs.
OUT_ROWS = 1 << 16
# Stands for a missing code point; no text holds it.
NONE = 0x1FFFFF
# Bytes of an Arrow batch on its way to Python, unless the session has its own setting.
BATCH_KEY, BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; files of this machine are mapped, not copied."""
    if "://" not in uri or uri.startswith("file:"):
        return pafs.LocalFileSystem(use_mmap=True), uri.removeprefix("file://").removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of all texts, one behind the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _three(codes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` code points from every place, packed; places without so many are left out."""
    out = np.full(len(codes), NONE, dtype=np.uint64) if n == 0 else codes[:max(len(codes) - n + 1, 0)].copy()
    for k in range(1, 3):
        out <<= np.uint64(21)
        out |= codes[k:len(out) + k] if k < n else np.uint64(NONE)
    return out


def packed_runs(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``size`` code points from every place: two numbers for each that tell it from every other run of any size."""
    low = _three(codes[3:], size - 3) if size > 3 else None
    high = _three(codes, min(size, 3))
    if low is None:
        return high, _three(high, 0)
    return high[:len(low)], low


def _hashes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    h = high * np.uint64(0x9E3779B97F4A7C15) + low * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(parts)


def _texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def save_parts(listed: DataFrame, parts: int) -> dict[int, str]:
    """The file of each part of ``listed`` (word, carried), ``word`` of 1 to ``LONGEST`` code points, each pair once."""
    spark, folder = listed.sparkSession, scratch_path(listed.sparkSession, "short-keywords")
    ship_package(spark)
    files, path = _store(folder)
    files.create_dir(path, recursive=True)

    def pack(batches):
        for batch in batches:
            words = _texts(batch.column("word"))
            high, low = (np.zeros(len(words), dtype=np.uint64) for _ in range(2))
            for size in {len(w) for w in words}:
                at = np.array([k for k, w in enumerate(words) if len(w) == size], dtype=np.int64)
                first, second = packed_runs(_codes([words[k] for k in at]).astype(np.uint64), size)
                high[at], low[at] = first[::size], second[::size]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_part_of(_hashes(high, low), parts).astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (high, low)), batch.column("carried")],
                names=["part", "high", "low", "carried"])

    def save(rows: pa.Table) -> pa.Table:
        high, low, carried = (rows.column(c).to_numpy() for c in ("high", "low", "carried"))
        hashes = _hashes(high.view(np.uint64), low.view(np.uint64))
        bits = max(1, len(hashes).bit_length())
        bucket = hashes >> np.uint64(64 - bits)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1, dtype=np.uint64))
        place = f"{folder}/{uuid.uuid4().hex}"
        out, at = _store(place)
        with out.open_output_stream(at, compression=None) as f:
            for numbers in (np.array([bits, len(order)]), starts, high[order], low[order], carried[order]):
                f.write(numbers.astype("<i8").tobytes())
        return pa.table({"part": rows.column("part").slice(0, 1), "place": [place]})

    found = listed.select("word", "carried").mapInArrow(pack, "part bigint, high bigint, low bigint, carried bigint")
    return {r["part"]: r["place"] for r in found.groupBy("part").applyInArrow(save, "part bigint, place string").collect()}


@lru_cache(maxsize=2)
def _part(place: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of a bucket, starts of the buckets, the packed keywords and what they carry."""
    files, path = _store(place)
    with files.open_input_file(path) as f:
        numbers = np.frombuffer(f.read_buffer(), dtype="<i8")
    bits, n = (int(x) for x in numbers[:2])
    starts, rest = numbers[2:3 + (1 << bits)], numbers[3 + (1 << bits):]
    return bits, starts, rest[:n].view(np.uint64), rest[n:2 * n].view(np.uint64), rest[2 * n:]


def look_up(place: str, high: np.ndarray, low: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the run, number of the keyword in the file) of the runs that are keywords; a keyword with several numbers is several."""
    bits, starts, highs, lows, _ = _part(place)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    at, end = starts[bucket], starts[bucket + 1]
    open_ = np.flatnonzero(at < end)
    at, end = at[open_], end[open_]
    while len(open_):
        same = (highs[at] == high[open_]) & (lows[at] == low[open_])
        if same.any():
            yield open_[same], at[same]
        at = at + 1
        more = at < end
        open_, at, end = open_[more], at[more], end[more]


def _found(texts: list[str], sizes: list[int], parts: int, places: dict[int, str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(file, number of the text, number of the keyword), each once, of the keywords in the texts."""
    codes, lengths = _codes(texts), np.array([len(t) for t in texts], dtype=np.int64)
    text_of, ends = np.repeat(np.arange(len(texts), dtype=np.int32), lengths), np.cumsum(lengths)
    hits: dict[str, list[np.ndarray]] = {p: [] for p in places.values()}
    for first in range(0, len(codes), PIECE):
        piece, of = codes[first:first + PIECE + LONGEST - 1].astype(np.uint64), text_of[first:first + PIECE]
        left = ends[of] - np.arange(first, first + len(of))
        for size in sizes:
            inside = np.flatnonzero(left >= size)
            high, low = (x[inside] for x in packed_runs(piece, size))
            hashes, whose = _hashes(high, low), of[inside].astype(np.int64)
            part = _part_of(hashes, parts) if parts > 1 else None
            for k, place in places.items():
                mine = slice(None) if part is None else np.flatnonzero(part == k)
                n, its = len(_part(place)[2]), whose[mine]
                new = [its[run] * n + word for run, word in look_up(place, high[mine], low[mine], hashes[mine])]
                if new:
                    hits[place].append(np.unique(np.concatenate(new)))
    for place, some in hits.items():
        if some:
            one = some[0] if len(some) == 1 else np.unique(np.concatenate(some))
            yield place, *np.divmod(one, len(_part(place)[2]))


def _words(high: np.ndarray, low: np.ndarray) -> list[str]:
    """The keywords that the numbers stand for."""
    shifts = np.array([42, 21, 0], dtype=np.uint64)
    codes = np.concatenate([(x[:, None] >> shifts) & np.uint64(NONE) for x in (high, low)], axis=1).astype("<u4")
    held = codes != NONE
    joined, ends = codes[held].tobytes().decode("utf-32-le", "surrogatepass"), np.cumsum(held.sum(axis=1)).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def parts_of(count: int) -> int:
    return max(1, -(-count // PART))


def short_pairs(texts: DataFrame, sizes: list[int], parts: int, places: dict[int, str], named: bool = True) -> DataFrame:
    """(key, word, carried) for every keyword in the files of :func:`save_parts` and row of ``texts`` (key, t) that holds it; without ``word`` unless ``named``.

    ``sizes`` are the numbers of code points of the keywords.
    """
    spark, kind = texts.sparkSession, texts.schema["key"].dataType.simpleString()
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_SIZE)

    def task(batches):
        for batch in batches:
            keys = batch.column("key")
            for place, text, word in _found(_texts(batch.column("t")), sizes, parts, places):
                _, _, high, low, carried = _part(place)
                for at in range(0, len(text), OUT_ROWS):
                    some = word[at:at + OUT_ROWS]
                    columns = [keys.take(pa.array(text[at:at + OUT_ROWS]))]
                    if named:
                        own, of = np.unique(some, return_inverse=True)
                        columns.append(pa.array(_words(high[own], low[own]), pa.string()).take(pa.array(of)))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(carried[some])], names=names)

    names = ["key", *["word"] * named, "carried"]
    schema = f"key {kind}, {'word string, ' * named}carried bigint"
    return texts.select("key", "t").mapInArrow(task, schema)
