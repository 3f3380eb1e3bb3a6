"""The keys of a stored table beside it, so that an insert reads no stored text.

A key row is the hash of an identifier or of a signature.  Keys lie in buckets, and every bucket has a Bloom filter of 64-bit blocks.  The keys
of a batch first ask the filters, a table many times smaller than the keys; only possible hits go on to the exact anti join
with the key rows.  A false positive costs that join one row and changes no result.

Both tables only grow by appended versions.  Filters merge by OR, so the blocks of all versions are combined when they are read; a version counts once Spark
has committed its filter (written last).  The number of blocks is fixed when the table is made: with more keys the filters pass
more, and :meth:`KeyTable.rebuild` makes larger ones from the keys alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.operators.dedup import first_accepted, key_rows

KEYS = "key string, version bigint"
BLOCKS = "block bigint, mask bigint, version bigint"
PROBES = 4
KEYS_A_BLOCK = 4
# Blocks of a bucket, so that a filter of one bucket is a megabyte.
BUCKET_BLOCKS = 1 << 17


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def _mask(key: Column) -> Column:
    """The bits of a key in its block."""
    bits = _hash(key, 2)
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for k in range(PROBES):
        place = F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, place))
    return mask


@dataclass
class KeyTable:
    """``folder`` on a shared file system; ``blocks`` is the number of filter blocks (four keys each are a good fill)."""

    spark: SparkSession
    folder: str
    blocks: int = BUCKET_BLOCKS

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, files = self._path(f"{self.folder}/filter/version=*/_SUCCESS")
        return sorted(int(str(s.getPath().getParent().getName()).split("=")[1]) for s in files.globStatus(path) or [])

    def _read(self, part: str, schema: str) -> DataFrame:
        places = [f"{self.folder}/{part}/version={v}" for v in self.versions()]
        columns = schema.rsplit(",", 1)[0]
        return self.spark.read.schema(columns).parquet(*places) if places else self.spark.createDataFrame([], columns)

    def keys(self) -> DataFrame:
        return self._read("keys", KEYS)

    def _block(self, key: Column) -> Column:
        return F.pmod(_hash(key, 1), F.lit(self.blocks))

    def _filter_of(self, keys: DataFrame) -> DataFrame:
        key = F.col("key")
        return keys.select(self._block(key).alias("block"), _mask(key).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))

    def filter(self) -> DataFrame:
        """One row for each used block; those of all versions joined by OR."""
        return self._read("filter", BLOCKS).groupBy("block").agg(F.bit_or("mask").alias("mask"))

    def append(self, pairs: DataFrame, token: str | None = None) -> int:
        """Add the keys of accepted (id, sig) pairs as a new version.

        ``token`` is a version number of the caller (such as a batch number) and makes a repeated append replace itself.
        """
        version = (max(self.versions(), default=-1) + 1) if token is None else int(token)
        both = pairs.select(F.explode(F.array(F.concat(F.lit("i"), "id"), F.concat(F.lit("s"), "sig"))).alias("key"))
        # near in buckets, so that a bucket's keys share row groups
        parts = max(1, self.blocks // BUCKET_BLOCKS)
        both.filter(F.col("key").isNotNull()).repartition(parts, self._block(F.col("key")) % parts).write.mode("overwrite").parquet(
            f"{self.folder}/keys/version={version}")
        added = self.spark.read.schema("key string").parquet(f"{self.folder}/keys/version={version}")
        self._filter_of(added).write.mode("overwrite").parquet(f"{self.folder}/filter/version={version}")
        return version

    def rebuild(self, folder: str, blocks: int) -> KeyTable:
        """The same keys with filters of another size, as one version of a table in ``folder``."""
        new = KeyTable(self.spark, folder, blocks)
        self.keys().write.mode("overwrite").parquet(f"{folder}/keys/version=0")
        new._filter_of(self.spark.read.schema("key string").parquet(f"{folder}/keys/version=0")).write.mode("overwrite").parquet(f"{folder}/filter/version=0")
        return new

    def possible(self, keys: DataFrame) -> DataFrame:
        """Of distinct (key) rows those that the filters may hold."""
        key = F.col("key")
        asked = keys.select("key", self._block(key).alias("block"), _mask(key).alias("need"))
        return asked.join(self.filter(), "block").filter(F.col("mask").bitwiseAND(F.col("need")) == F.col("need")).select("key")

    def known(self, keys: DataFrame) -> DataFrame:
        """Of distinct (key) rows those that are stored: the filters first, then the exact keys."""
        return self.possible(keys).join(self.keys().distinct(), "key", "left_semi")

    def unknown_pairs(self, pairs: DataFrame) -> DataFrame:
        """The (id, sig, ord) pairs neither of whose keys is stored."""
        both = pairs.select(F.explode(F.array(F.concat(F.lit("i"), "id"), F.concat(F.lit("s"), "sig"))).alias("key")).filter(F.col("key").isNotNull()).distinct()
        hits = self.known(both)
        kept = pairs.join(hits.select(F.col("key").alias("_i")), F.concat(F.lit("i"), "id") == F.col("_i"), "left_anti")
        return kept.join(hits.select(F.col("key").alias("_s")), F.concat(F.lit("s"), "sig") == F.col("_s"), "left_anti")


def insert_by_keys(batch: DataFrame, table: KeyTable, order_col: str, token: str | None = None, **names) -> DataFrame:
    """The rows of ``batch`` to insert, as the insert that reads the stored rows would choose them; their keys are added to the table.

    ``order_col`` must be unique.  Write the rows under the same token before the keys count: on a repeat with the same token both are replaced.
    """
    accepted = first_accepted(table.unknown_pairs(key_rows(batch, order_col, **names)))
    table.append(accepted, token)
    return batch.join(accepted.select(F.col("ord").alias(order_col)), order_col, "left_semi")


def keys_of_stored(table: KeyTable, stored: DataFrame, key: str = "feedback_id", title: str = "title", content: str = "content") -> int:
    """Fill a new table once from stored rows; later inserts add their own keys."""
    return table.append(key_rows(stored.withColumn("_no_order", F.lit(0)), "_no_order", key, title, content))
