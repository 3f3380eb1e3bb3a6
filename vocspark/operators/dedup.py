"""De-duplicated insert, keyword back-fill and latest-per-title.

All decisions are made on narrow key rows; the wide rows move once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.functions.dates import iso_timestamp
from vocspark.functions.ids import content_signature
from vocspark.session import cut_lineage


# Largest rank the optimizer pushes below a shuffle, and parts of a source for ranks above it.
GROUP_LIMIT, SOURCE_PARTS = 1_000, 64


def _signature(title: str, content: str) -> Column:
    return F.sha2(content_signature(title, content), 256)


def _identifier(key: str) -> Column:
    """The identifier as a key; rows without one share the empty identifier."""
    return F.coalesce(F.col(key), F.lit("")).alias("id")


def key_rows(batch: DataFrame, order_col: str, key: str = "feedback_id", title: str = "title",
             content: str = "content") -> DataFrame:
    """(id, sig, ord): one row per distinct identifier-and-signature pair, at its first position.

    A later row with the same pair can never be accepted, so copies are gone before any join,
    by a partial aggregation that needs no sight of the whole group.
    """
    return (batch.select(_identifier(key), _signature(title, content).alias("sig"), F.col(order_col).alias("ord"))
            .groupBy("id", "sig").agg(F.min("ord").alias("ord")))


def first_accepted(pairs: DataFrame) -> DataFrame:
    """Rows accepted when (id, sig, ord) rows are taken in order and both keys must be unused.

    A row that is first for its id and first for its signature is certain; its keys then rule out
    every other holder.  Repeating that decides all rows: it is the sequential greedy matching of
    ids and signatures, found in a few rounds.  Each round works on two minima per key, which
    combine before the shuffle, so one key with very many rows is no bottleneck.
    """
    rest, accepted = cut_lineage(pairs), None
    while True:
        by_id = rest.groupBy("id").agg(F.min(F.struct("ord", "sig")).alias("m")).select("id", "m.ord", "m.sig")
        by_sig = rest.groupBy("sig").agg(F.min(F.struct("ord", "id")).alias("m")).select("sig", "m.ord", "m.id")
        sure = cut_lineage(by_id.join(by_sig, ["id", "sig", "ord"]))
        accepted = sure if accepted is None else accepted.unionByName(sure)
        rest = cut_lineage(rest.join(sure.select("id"), "id", "left_anti")
                           .join(sure.select("sig"), "sig", "left_anti"))
        if rest.isEmpty():
            return accepted


def insert_keys(batch: DataFrame, stored: DataFrame, order_col: str, key: str = "feedback_id",
                title: str = "title", content: str = "content") -> DataFrame:
    """Keys of the batch rows to insert: new to the stored table and first within the batch."""
    pairs = key_rows(batch, order_col, key, title, content)
    pairs = pairs.join(stored.select(_identifier(key)), "id", "left_anti")
    pairs = pairs.join(stored.select(_signature(title, content).alias("sig")).distinct(), "sig", "left_anti")
    return first_accepted(pairs)


def rows_to_insert(batch: DataFrame, stored: DataFrame, order_col: str, **names) -> DataFrame:
    """The batch rows that :func:`insert_keys` accepts; ``order_col`` must be unique."""
    accepted = insert_keys(batch, stored, order_col, **names)
    return batch.join(accepted.select(F.col("ord").alias(order_col)), order_col, "left_semi")


def insert_counters(batch: DataFrame, accepted: DataFrame, original_id: str | None = None,
                    key: str = "feedback_id") -> DataFrame:
    """One row: new_items, existing_items, total_items, id_regenerated."""
    changed = (~F.col(original_id).eqNullSafe(F.col(key))).cast("long") if original_id else F.lit(0)
    totals = batch.agg(F.count(F.lit(1)).alias("total_items"),
                       F.coalesce(F.sum(changed), F.lit(0)).cast("long").alias("id_regenerated"))
    new = accepted.agg(F.count(F.lit(1)).alias("new_items"))
    one = F.lit(1).alias("one")
    return (totals.select("*", one).join(new.select("*", one), "one")
            .select("new_items", (F.col("total_items") - F.col("new_items")).alias("existing_items"),
                    "total_items", "id_regenerated"))


def backfill_keywords(stored: DataFrame, batch: DataFrame, order_col: str, key: str = "feedback_id",
                      column: str = "matched_keywords") -> DataFrame:
    """Give stored rows without keywords those of the first batch row that has some."""
    fresh = (batch.filter(F.size(column) > 0).groupBy(key)
             .agg(F.min_by(column, order_col).alias("_fresh")))
    empty = F.col(column).isNull() | (F.size(column) == 0)
    return (stored.join(fresh, key, "left")
            .withColumn(column, F.when(empty & F.col("_fresh").isNotNull(), F.col("_fresh")).otherwise(F.col(column)))
            .drop("_fresh"))


def latest_per_title(df: DataFrame, order_col: str, title: str = "title", created: str = "created") -> DataFrame:
    """Newest row per title; a readable date beats an unreadable one, ties keep the first seen.

    The filter on rank 1 becomes a group limit below the shuffle: a task sends one row per title.
    """
    newest_first = Window.partitionBy(title).orderBy(F.col("_at").desc_nulls_last(), F.col(order_col).asc())
    return (df.withColumn("_at", iso_timestamp(created))
            .withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") == 1)
            .drop("_at", "_rank"))


def limit_per_source(df: DataFrame, limit: int, source: str = "source", created: str = "created",
                     key: str = "feedback_id") -> DataFrame:
    """The newest ``limit`` rows of every source, ties by key.

    Small limits run below the shuffle.  Larger ones the optimizer leaves above it, so a source is
    then split over many tasks first: a row beyond the limit of its part is beyond the limit.
    """
    def newest(rows: DataFrame, *group: Column | str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.col(created).desc_nulls_last(), F.col(key).asc())
        return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")

    if limit > GROUP_LIMIT:
        df = newest(df, source, F.pmod(F.xxhash64(key), F.lit(SOURCE_PARTS)))
    return newest(df, source)


def stored_ids(df: DataFrame, key: str = "feedback_id") -> DataFrame:
    return df.select(key).filter(F.trim(key) != "").distinct()


def only_stored(df: DataFrame, ids: DataFrame, key: str = "feedback_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")
