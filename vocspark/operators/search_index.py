"""Free-text search over a stored table through posting lists of trigrams.

The rows lie in blocks (directories of one Parquet table), each row under a number given when it is written.  Every run of three code points of
the lower-case text columns is filed once for each row: posting lists (gram, rows) are made inside the tasks that read the rows, a few million
characters at a time, so only lists are shuffled.  They lie in directories by the hash of the gram, sorted by gram in small row groups: a
lookup reads the row groups of its grams only.  The lists of a frequent gram are dealt over tasks.  A second small table holds how many
postings a gram has.

A search takes the rarest grams of its text, keeps the rows that hold all of them, reads the blocks of those rows (partition pruning at run
time by a broadcast of block numbers, never more than ``blocks``) and confirms with the plain search, so the result is that of
:func:`vocspark.operators.filters.search` over the whole table.  Texts of fewer than three code points, and those whose grams are in most blocks
anyway, cost what a scan costs.

Null texts are never found, repeated rows are kept, an empty table and a gram that no row holds give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.operators.filters import SEARCH_COLUMNS, search
from vocspark.session import ship_package

GRAM = 3
# Grams of the searched text that are looked up; more would read more postings than they save rows.
LOOKED_UP = 4
# Code points of a piece of text, and of the pieces whose postings are made at once.
PIECE, AT_ONCE = 1 << 12, 1 << 22
BUCKETS = 64
ROW_GROUP_BYTES = 1 << 20
ROW, BLOCK = "_row", "_block"


def _bucket_of(gram: Column | str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _block_of(row: Column | str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")


def _pieces(texts: DataFrame) -> DataFrame:
    """(row, piece) of (row, t); a text is cut into pieces that overlap by what a gram needs."""
    cut = F.regexp_extract_all("t", F.lit(f"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    return texts.filter(F.length("t") >= GRAM).select(F.col(ROW).alias("row"), F.explode(cut).alias("piece"))


def gram_code(gram: str) -> int:
    """Three code points in one number."""
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


def _lists(rows: np.ndarray, pieces: list[str]) -> pa.RecordBatch:
    """(gram, rows): the rows of every gram of the pieces, each row once; ``rows`` has equal numbers side by side."""
    points = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    inside = np.flatnonzero(piece[:1 - GRAM] == piece[GRAM - 1:])
    grams = points[inside] << 42 | points[inside + 1] << 21 | points[inside + 2]
    order = np.argsort(grams, kind="stable")
    grams, holders = grams[order], rows[piece[inside[order]]]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (holders[1:] != holders[:-1])
    grams, holders = grams[new], holders[new]
    firsts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, dtype=np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(grams)), pa.int32()), pa.array(holders, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(grams[firsts], pa.int64()), lists], names=["gram", "rows"])


def _posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, pieces = batch.column("row").to_numpy(), batch.column("piece").to_pylist()
        step = AT_ONCE // PIECE
        for at in range(0, len(pieces), step):
            yield _lists(rows[at:at + step], pieces[at:at + step])


@dataclass(frozen=True)
class SearchIndex:
    """An index in ``folder`` on a shared file system over the text ``columns`` of the rows beside it; ``schema`` is that of the rows.

    The same five values open a written index again.
    """

    spark: SparkSession
    folder: str
    schema: T.StructType
    columns: tuple[str, ...]
    blocks: int

    def _read(self, part: str) -> DataFrame:
        schema = {"postings": "gram bigint, rows array<bigint>, bucket int", "counts": "gram bigint, n bigint"}.get(part) or T.StructType(
            [*self.schema.fields, T.StructField(ROW, T.LongType()), T.StructField(BLOCK, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")

    def rows(self) -> DataFrame:
        return self._read("rows").drop(ROW, BLOCK)

    def rarest(self, text: str) -> list[int] | None:
        """At most ``LOOKED_UP`` grams of ``text``, the rarest first; None if a gram of it is in no row.  Reads one count for each gram."""
        low = text.lower()
        grams = sorted({gram_code(low[i:i + GRAM]) for i in range(len(low) - GRAM + 1)})
        counted = {r["gram"]: r["n"] for r in self._read("counts").filter(F.col("gram").isin(grams)).collect()}
        if len(counted) < len(grams):
            return None
        return sorted(grams, key=lambda g: (counted[g], g))[:LOOKED_UP]

    def candidates(self, grams: list[int]) -> DataFrame:
        """(row): rows that hold all of ``grams``, at most ``LOOKED_UP`` of them."""
        buckets = self.spark.createDataFrame([(g,) for g in grams], "gram bigint").select(_bucket_of("gram")).collect()
        held = self._read("postings").filter(F.col("bucket").isin([r[0] for r in buckets]) & F.col("gram").isin(grams))
        held = held.select("gram", F.explode("rows").alias("row"))
        if len(grams) == 1:
            return held.select("row").distinct()
        return held.groupBy("row").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("row")

    def search(self, text: str) -> DataFrame:
        """The rows with ``text`` in any of the columns, in any letter case; an empty text matches every non-null text."""
        stored, found = self._read("rows"), search(text, self.columns)
        if len(text.lower()) < GRAM:
            return stored.filter(found).drop(ROW, BLOCK)
        grams = self.rarest(text)
        if grams is None:
            return stored.limit(0).drop(ROW, BLOCK)
        rows = self.candidates(grams).withColumnRenamed("row", ROW)
        touched = rows.select(_block_of(ROW, self.blocks).alias(BLOCK)).distinct()
        near = stored.join(F.broadcast(touched), BLOCK, "left_semi").join(rows, ROW, "left_semi")
        return near.filter(found).drop(ROW, BLOCK)


def build_search_index(df: DataFrame, folder: str, columns=SEARCH_COLUMNS, blocks: int = 256) -> SearchIndex:
    """Write ``df`` and its postings below ``folder``; columns it does not have are left out.

    ``blocks`` should give blocks of about a hundred megabytes; it is also the bound of what a search broadcasts.
    """
    spark, taken = df.sparkSession, tuple(c for c in columns if c in df.columns)
    if clash := {ROW, BLOCK} & set(df.columns):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    numbered = df.withColumn(ROW, F.monotonically_increasing_id()).withColumn(BLOCK, _block_of(ROW, blocks))
    numbered.repartition(BLOCK).write.partitionBy(BLOCK).parquet(f"{folder}/rows")
    index = SearchIndex(spark, folder, df.schema, taken, blocks)
    texts = index._read("rows").select(ROW, F.explode(F.array(*[F.lower(c) for c in taken])).alias("t"))
    small_groups = {"parquet.block.size": str(ROW_GROUP_BYTES)}
    ship_package(spark)
    small_groups = {"parquet.block.size": str(ROW_GROUP_BYTES)}
    lists = _pieces(texts).mapInArrow(_posting_lists, "gram bigint, rows array<bigint>").withColumn("bucket", _bucket_of("gram"))
    deal = F.pmod(F.xxhash64("rows"), F.lit(-(-blocks // BUCKETS)))
    lists.repartition("bucket", deal).sortWithinPartitions("bucket", "gram").write.options(**small_groups).partitionBy("bucket").parquet(f"{folder}/postings")
    counts = index._read("postings").groupBy("gram").agg(F.sum(F.size("rows")).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.options(**small_groups).parquet(f"{folder}/counts")
    return index
