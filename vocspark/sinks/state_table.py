"""The state table in buckets: a merge rewrites only the buckets of the changed items.

Rows lie in ``data/version=<v>/bucket=<b>``, by the hash of their id.  A manifest folder ``manifest/version=<v>`` names the version that holds each bucket
at present; it is written after the data and counts once Spark has committed it (``_SUCCESS``), so a merge that breaks off
changes nothing and a reader always sees one whole version.  Older versions stay readable until :meth:`StateTable.vacuum`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.operators.state import upsert_states
from vocspark.schema import STATE_SCHEMA
from vocspark.sinks.tables import project

BUCKETS = 256
MANIFEST = "bucket int, version bigint, buckets int, token string"


@dataclass
class StateTable:
    """``folder`` on a shared file system; ``buckets`` counts for a new table, an old one keeps its own."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        path, files = self._path(f"{self.folder}/manifest/version=*/_SUCCESS")
        found = files.globStatus(path) or []
        return sorted(int(str(s.getPath().getParent().getName()).split("=")[1]) for s in found)

    def manifest(self, version: int | None = None) -> tuple[int, dict[int, int], int, str | None]:
        """Version, where each bucket lies, number of buckets, and the token of the newest commit; at most one row a bucket."""
        usable = [v for v in self.versions() if version is None or v <= version]
        if not usable:
            return 0, {}, self.buckets, None
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/version={usable[-1]}").collect()
        return usable[-1], {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}, rows[0]["buckets"], rows[0]["token"]

    def bucket_of(self, key: Column | str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _rows(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(places.items())]
        return self.spark.read.schema(STATE_SCHEMA).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The whole table, as of a version (null: the newest)."""
        return self._rows(self.manifest(version)[1])

    def _commit(self, rows: DataFrame, touched: list[int], old: tuple, token: str) -> int:
        version, places, buckets, _ = old
        new = version + 1
        target = f"{self.folder}/data/version={new}"
        (rows.withColumn("bucket", self.bucket_of("feedback_id", buckets)).repartition(max(1, len(touched)), "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(target))
        path, files = self._path(f"{target}/bucket=*")
        written = {int(str(s.getPath().getName()).split("=")[1]) for s in files.globStatus(path) or []}
        places = places | {b: new for b in written}
        entries = [(b, v, buckets, token) for b, v in sorted(places.items())] or [(-1, new, buckets, token)]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={new}")
        return new

    def create(self, states: DataFrame) -> int:
        """Version 1 of the table from existing states; an existing table is not touched."""
        if self.versions():
            raise ValueError(f"{self.folder} holds a table already")
        return self._commit(project(states, STATE_SCHEMA), list(range(self.buckets)), (0, {}, self.buckets, None), "create")

    def merge(self, changes: DataFrame, order_col: str = "ord", actor: str | None = None, token: str | None = None) -> int:
        """Apply a change log; a merge with the token of the newest commit was done already and does nothing.

        Reads and writes only buckets in which some changed item lies; at most one number for each bucket reaches the driver.
        """
        old = self.manifest()
        version, places, buckets, last = old
        if token is not None and token == last:
            return version
        changes = changes.filter(F.coalesce("feedback_id", F.lit("")) != "").persist()  # the source of a micro-batch is read once
        try:
            touched = sorted(r["b"] for r in changes.select(self.bucket_of("feedback_id", buckets).alias("b")).distinct().collect())
            current = self._rows({b: places[b] for b in touched if b in places})
            return self._commit(upsert_states(current, changes, order_col, actor), touched, old, token or "")
        finally:
            changes.unpersist()

    def vacuum(self) -> int:
        """Delete bucket folders that the newest version does not use, and older manifests; gives the number of deleted bucket folders."""
        version, places, _, _ = self.manifest()
        kept, gone = {(v, b) for b, v in places.items()}, 0
        path, files = self._path(f"{self.folder}/data/version=*/bucket=*")
        for status in files.globStatus(path) or []:
            found = status.getPath()
            place = tuple(int(str(p.getName()).split("=")[1]) for p in (found.getParent(), found))
            if place[0] <= version and place not in kept:
                gone += files.delete(found, True)
        for v in self.versions()[:-1]:
            path, files = self._path(f"{self.folder}/manifest/version={v}")
            files.delete(path, True)
        return gone
