"""Structured Streaming jobs over landed files.

Ingest writes batch-numbered folders, triage commits versions under the batch's name, so a batch that is run again after
a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vocspark.plans.flows import stored_form
from vocspark.schema import CHANGE_SCHEMA
from vocspark.sinks.state_table import StateTable
from vocspark.sinks.tables import project
from vocspark.streaming.keyed_state import only_new


def ingest_stream(spark: SparkSession, landed: str, schema: str, to_feedback: Callable[[DataFrame], DataFrame],
                  table: str, checkpoint: str, stored: DataFrame | None = None, keep: str | None = None) -> StreamingQuery:
    """Landed JSON files → feedback table, adding only what is new.

    ``to_feedback`` maps raw records to feedback rows.  Earlier rows are known by the stream's keyed state, so no stored row
    is read again; ``stored`` fills the state with the keys of an older table when the stream first starts, and with
    ``keep`` (an interval such as ``400 days``) keys are forgotten that long after their last arrival.  Within a
    micro-batch rows are taken by creation text and identifier.
    """
    rows = stored_form(project(to_feedback(spark.readStream.schema(schema).json(landed))))
    order = F.concat_ws("|", F.coalesce("created", F.lit("")), F.coalesce("feedback_id", F.lit("")))
    old = None if stored is None else stored_form(project(stored))
    fresh = only_new(rows, order, old, keep)

    def add_batch(batch: DataFrame, batch_id: int) -> None:
        project(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (fresh.writeStream.foreachBatch(add_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def triage_stream(spark: SparkSession, landed: str, states: StateTable, checkpoint: str) -> StreamingQuery:
    """Landed change files → the state table; a micro-batch rewrites the buckets of its items only."""
    changes = spark.readStream.schema(CHANGE_SCHEMA).json(landed)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        replace(states, spark=batch.sparkSession).merge(batch, token=f"{checkpoint}#{batch_id}")

    return (changes.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
