"""Which arriving rows are new, decided in the stream's own state.

Rows whose identifier or signature was accepted before are dropped, as the de-duplicated insert drops them, without reading the stored table: the
state knows both keys of every accepted row.  Identifiers and signatures are made from the same text, so rows that share one of them have
the same normalised content; that content's hash is the grouping key, and all decisions about a key are made in one group.

Spark gives every group to Python, and takes it back, as Arrow batches of its own, whose cost is their number of columns.  So all columns of one type
travel as one array.

The state lives in the RocksDB store, so it may be larger than memory.  With ``keep`` a group's keys are forgotten that long after its last arrival,
by event-time timers on the arrival time; without it they are kept like the table's own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vocspark.functions.ids import content_signature
from vocspark.functions.text import normalize_for_id
from vocspark.session import ship_package

STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVAL = "arrived_at"
KEYS = ["voc_group", "voc_id", "voc_sig", "voc_order"]


def with_keys(rows: DataFrame, order: Column, key: str = "feedback_id", title: str = "title", content: str = "feedback") -> DataFrame:
    """Rows with their group, identifier, signature and order, all as text."""
    return rows.withColumns({
        "voc_group": F.sha2(normalize_for_id(content), 256), "voc_id": F.coalesce(F.col(key), F.lit("")),
        "voc_sig": F.sha2(content_signature(title, content), 256), "voc_order": order.cast("string")})


def packed(rows: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str], list[Column]]:
    """The columns ``keep``, and all others as one array for each type; the names of the arrays, and the other columns cut out of them again."""
    taken, arrays, back = {c.lower() for c in rows.columns}, {}, []
    for field in rows.schema:
        if field.name not in keep:
            kind = field.dataType.json()
            if kind not in arrays:
                name = f"voc_{len(arrays)}"
                while name in taken:
                    name = f"_{name}"
                arrays[kind] = name, []
            name, columns = arrays[kind]
            back.append(F.get(name, F.lit(len(columns))).alias(field.name, metadata=field.metadata))
            columns.append(F.col("`" + field.name.replace("`", "``") + "`"))
    return rows.select(*keep, *[F.array(*columns).alias(name) for name, columns in arrays.values()]), [name for name, _ in arrays.values()], back


class NewRows(StatefulProcessor):
    """Rows of a group that are first for their identifier and for their signature.

    Of a micro-batch only one row for each pair of keys is held, the one first in order; rows with an accepted key are dropped as they come.
    Rows leave with ``columns`` only.
    """

    def __init__(self, columns: list[str], keep_ms: int | None = None):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getMapState("taken", "key string", "accepted boolean")

    def _is_taken(self, known: bool, row: Row) -> bool:
        return known and (self.taken.containsKey((f"i{row.voc_id}",)) or self.taken.containsKey((f"s{row.voc_sig}",)))

    def _take(self, row: Row) -> None:
        self.taken.updateValue((f"i{row.voc_id}",), (True,))
        self.taken.updateValue((f"s{row.voc_sig}",), (True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, first, dropped, arrived = self.taken.exists(), {}, set(), 0
        for row in rows:
            pair = row.voc_id, row.voc_sig
            if self.keep_ms is not None:
                arrived = max(arrived, int(row[ARRIVAL].timestamp() * 1000))
            if pair in first:
                if row.voc_order < first[pair].voc_order:
                    first[pair] = row
            elif pair not in dropped:
                if self._is_taken(known, row):
                    dropped.add(pair)
                else:
                    first[pair] = row
        ids, sigs = set(), set()
        for row in sorted(first.values(), key=lambda r: (r.voc_order, r.voc_id, r.voc_sig)):
            if row.voc_id not in ids and row.voc_sig not in sigs:
                ids.add(row.voc_id)
                sigs.add(row.voc_sig)
                self._take(row)
                yield Row(**{c: row[c] for c in self.columns})
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(arrived + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.taken.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.taken.updateValue((f"i{initialState.voc_id}",), (True,))
        self.taken.updateValue((f"s{initialState.voc_sig}",), (True,))

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in the RocksDB store; another store cannot hold map states."""
    if spark.conf.get(STORE_KEY, "") != ROCKSDB:
        spark.conf.set(STORE_KEY, ROCKSDB)


def only_new(rows: DataFrame, order: Column, stored: DataFrame | None = None, keep: str | None = None, **names) -> DataFrame:
    """The streaming ``rows`` that are new.  ``stored`` are rows already in the table when the stream first starts; only their keys are kept."""
    spark = rows.sparkSession
    ship_package(spark)
    use_rocksdb(spark)
    keyed = with_keys(rows, order, **names)
    mode, keep_ms, initial = "None", None, None
    if keep is not None:
        keyed = keyed.withColumn(ARRIVAL, F.current_timestamp()).withWatermark(ARRIVAL, "0 seconds")
        mode, keep_ms = "EventTime", int(spark.range(1).select(F.expr(f"timestampdiff(MILLISECOND, timestamp'1970-01-01', timestamp'1970-01-01' + interval {keep})")).first()[0])
    if stored is not None:
        initial = with_keys(stored, F.lit(""), **names).select("voc_group", "voc_id", "voc_sig").distinct().groupBy("voc_group")
    narrow, columns, back = packed(keyed, KEYS if keep is None else [*KEYS, ARRIVAL])
    fresh = narrow.groupBy("voc_group").transformWithState(NewRows(columns, keep_ms), narrow.select(*columns).schema, "Append", mode, initial)
    return fresh.select(*back)
