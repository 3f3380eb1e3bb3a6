"""Helpers shared by the operators of this subpackage: file access, hashing, byte-level words, row conversion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.session import scratch_path, ship_package

# Characters that separate words in the documented word rule [^\x20\x09-\x0D]+ .
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Work on raw text in pieces of about this many bytes, so that NumPy's temporaries stay small.
PIECE_BYTES = 1 << 18


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder; Spark's one-slash ``file:`` spelling is accepted."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared place that the cluster names; its files outlive any executor."""
    return scratch_path(spark, label)


def make_folder(uri: str) -> None:
    """Create a folder that tasks will write single files into."""
    files, path = store(uri)
    files.create_dir(path, recursive=True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def crc_mod_5(doc_id: str | F.Column = "doc_id") -> F.Column:
    """Fold of a document: crc32 of the id as text, modulo 5."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % 5


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about PIECE_BYTES each; a long text is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > PIECE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def with_column_batches(df: DataFrame, columns: list[str], schema: str, task: Callable) -> DataFrame:
    """mapInArrow over the named columns; ``task`` gets and gives record batches."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(tidied(task), schema)


# Rows and bytes of an Arrow batch on its way to Python; long texts make small batches.
BATCH_ROWS, BATCH_SIZE = "2000", "4m"


def small_batches(spark: SparkSession) -> None:
    """Let Spark cut Arrow batches by bytes, so that executor and worker hold a few megabytes of texts each; own settings stay."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_SIZE)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def tidied(task: Callable) -> Callable:
    """``task``, giving memory back to the system at its end, since idle workers stay beside the executor."""
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()
    return run


def give_back() -> None:
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (shifts, xors and odd multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**n modulo 2**64."""
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= 4 * PIECE_BYTES:
        if len(_POWERS["up"]) <= n:
            size = min(4 * PIECE_BYTES, max(2 * n, 1 << 16))
            _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
        return _POWERS["up"], _POWERS["down"]
    return _powers(_BASE, n), _powers(_INVERSE, n)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    word = np.empty(len(data) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(_IS_SPACE[data], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span: a polynomial over random byte values, from one running sum."""
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    sums = (total[ends] - total[starts]) * down[starts]
    return mix64(sums + (ends - starts).astype(np.uint64))


def hashed_words(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces of texts: index of the first text, word hashes (A-Z lower-cased), and each text's word bounds.

    Bounds has one entry more than the piece has texts: words bounds[k]:bounds[k + 1] belong to text first + k.
    """
    for first, last in pieces(texts):
        joined = b"\n".join(texts[first:last])
        data = LOWER[np.frombuffer(joined, dtype=np.uint8)]
        starts, ends = word_spans(data)
        lengths = np.fromiter((len(t) + 1 for t in texts[first:last]), dtype=np.int64, count=last - first)
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        yield first, span_hashes(data, starts, ends), np.searchsorted(starts, cuts)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that copies of long texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def save_bits(numbers: DataFrame, column: str, bits: int, folder: str) -> str:
    """A bitmap of 2**bits places with the given numbers set, as one file; its size does not depend on the input."""
    make_folder(folder)
    place = f"{folder}/bits"

    def save(batches):
        packed = np.zeros(max(1 << bits >> 3, 1), dtype=np.uint8)
        for batch in batches:
            numbers = batch.column(column).to_numpy()
            np.bitwise_or.at(packed, numbers >> 3, (128 >> (numbers & 7)).astype(np.uint8))
        files, path = store(place)
        with files.open_output_stream(path, compression=None) as out:
            out.write(packed.data)
        yield pa.RecordBatch.from_arrays([pa.array([place])], names=["place"])

    found = with_column_batches(numbers.select(column).distinct().coalesce(1), [column], "place string", save).first()
    return found["place"] if found else ""


@lru_cache(maxsize=2)
def load_bits(place: str) -> np.ndarray:
    """The packed bytes of a bitmap."""
    if not place:
        return np.zeros(0, dtype=np.uint8)
    files, path = store(place)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


def bits_set(packed: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    if not len(packed):
        return np.zeros(len(numbers), dtype=bool)
    return (packed[numbers >> 3] >> (7 - (numbers & 7))) & 1 == 1


def unused(taken: list[str], wanted: list[str]) -> list[str]:
    """The wanted names, with underscores in front until none is taken (in any case)."""
    taken, mark = {c.lower() for c in taken}, ""
    while any((mark + w).lower() in taken for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]


def add_columns(df: DataFrame, inputs: list[str], added: str, work: Callable) -> DataFrame:
    """``df`` with the columns of the DDL string ``added``, computed in Arrow batches.

    ``work`` gets the input arrays of a batch and gives the added arrays.  Other columns are carried; one with an added
    name is replaced.
    """
    from pyspark.sql.types import StructType
    ship_package(df.sparkSession)
    fresh = StructType.fromDDL(added)
    kept = [c for c in df.columns if c not in fresh.names]
    sent = {c: n for c, n in zip(inputs, unused(df.columns, [f"_in{i}" for i in range(len(inputs))])) if c not in kept}
    given, names = [sent.get(c, c) for c in inputs], fresh.names
    ready = df.select(*kept, *[F.col(c).alias(n) for c, n in sent.items()])
    types = [pa.large_binary() if f.dataType.typeName() == "binary" else None for f in fresh]

    def run(batches):
        for batch in sliced(batches):
            new = [x if t is None or isinstance(x, pa.Array) else pa.array(x, pa.binary())
                   for x, t in zip(work(*[batch.column(n) for n in given]), types)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, names=kept + names)

    small_batches(df.sparkSession)
    return ready.mapInArrow(tidied(run), StructType([df.schema[c] for c in kept] + list(fresh)))


DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def carrying(stage: Callable) -> Callable:
    """A pipeline stage that sees no columns but those of documents under their names.

    All others are carried under neutral names and get their own back, so they clash with nothing inside; one named
    like a column that the stage adds is replaced.
    """
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        names = {c: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT_COLUMNS}
        inside = docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns])
        out = stage(spark, inside, folder)
        back = {n: c for c, n in names.items()}
        added = {c.lower() for c in out.columns if c not in back}
        return out.select(*[F.col(c).alias(back.get(c, c)) for c in out.columns if c not in back or back[c].lower() not in added])
    return run
