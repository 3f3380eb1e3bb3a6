"""Landed waves, merges and key tables: what the incremental forms keep equals the same rule over everything at once."""

from pyspark.sql import functions as F

from bindings.base import FEEDBACK_SQL, feedback
from bindings.registry import query
from bindings.storage import BATCH_SQL, ID_SQL, SYNC_SIG_SQL, batch, stored_batch
from bindings.triage import SHOWN_SQL, UPSERT_SQL, _shown, changes, states
from vocspark.functions.ids import feedback_id
from vocspark.operators import key_table
from vocspark.session import scratch_path
from vocspark.sinks.state_table import StateTable
from vocspark.streaming import jobs

GREEDY_SQL = """list_reduce(list({{'ids': [feedback_id], 'sigs': [sig], 'ords': [doc_id]}} ORDER BY {order}), lambda a, x:
  CASE WHEN list_has_any(a.ids, x.ids) OR list_has_any(a.sigs, x.sigs) THEN a
  ELSE {{'ids': list_concat(a.ids, x.ids), 'sigs': list_concat(a.sigs, x.sigs), 'ords': list_concat(a.ords, x.ords)}} END)"""


@query("stream_ingest", f"""WITH {FEEDBACK_SQL}, ba AS (SELECT doc_id, {ID_SQL} AS feedback_id, {SYNC_SIG_SQL} AS sig, created FROM fb),
once AS (SELECT feedback_id, sig, min((doc_id % 2, created, doc_id)) AS o FROM ba GROUP BY ALL),
fold AS (SELECT {GREEDY_SQL.format(order='doc_id[1], doc_id[2], feedback_id')} AS r FROM (SELECT feedback_id, sig, [CAST(o[1] AS VARCHAR), o[2]] AS doc_id FROM once)),
acc AS (SELECT unnest(r.ids) AS feedback_id, unnest(r.ords) AS o FROM fold) SELECT feedback_id, CAST(o[1] AS BIGINT) AS wave, o[2] AS created FROM acc""")
def stream_ingest(spark, folder):
    """All documents land in two waves of JSON files; the stream is started anew for the second and reads nothing of the first."""
    root = scratch_path(spark, "stream-ingest")
    rows = feedback(spark, folder).select("doc_id", "feedback", "title", "created")

    def to_feedback(raw):
        return raw.withColumn("feedback_id", feedback_id(F.lit(""), "feedback", F.lit("")))

    for wave in (0, 1):
        rows.filter(F.col("doc_id") % 2 == wave).drop("doc_id").write.json(f"{root}/landed/wave{wave}")
        jobs.ingest_stream(spark, f"{root}/landed/*", "feedback string, title string, created string", to_feedback,
                           f"{root}/table", f"{root}/checkpoint").awaitTermination()
    found = spark.read.option("basePath", f"{root}/table").parquet(f"{root}/table")
    return found.select("feedback_id", F.col("batch").cast("long").alias("wave"), "created")


@query("stream_triage", f"WITH {UPSERT_SQL} SELECT {SHOWN_SQL} FROM up")
def stream_triage(spark, folder):
    """The change log lands in two waves by time and is merged into a bucketed state table that starts with the labelled documents."""
    root = scratch_path(spark, "stream-triage")
    table = StateTable(spark, f"{root}/states", buckets=64)
    table.create(states(spark, folder))
    log = changes(spark, folder)
    middle = log.agg(F.expr("percentile_approx(ord, 0.5)").alias("m")).first()["m"]
    for wave, part in enumerate((F.col("ord") <= middle, F.col("ord") > middle)):
        log.filter(part).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{root}/landed/wave{wave}")
        jobs.triage_stream(spark, f"{root}/landed/*", table, f"{root}/checkpoint").awaitTermination()
    return _shown(table.read())


@query("keyed_insert", f"""WITH {BATCH_SQL.replace('ORDER BY doc_id)', 'ORDER BY doc_id % 2, doc_id)')} SELECT doc_id, feedback_id, CAST(doc_id % 2 AS BIGINT) AS wave FROM ba JOIN acc USING (doc_id)""")
def keyed_insert(spark, folder):
    """The key table is filled once from the stored rows; two batches are then inserted without reading stored texts."""
    keys = key_table.KeyTable(spark, scratch_path(spark, "keys"))
    key_table.keys_of_stored(keys, stored_batch(spark, folder))
    rows, out = batch(spark, folder), None
    for wave in (0, 1):
        part = key_table.insert_by_keys(rows.filter(F.col("doc_id") % 2 == wave), keys, "doc_id")
        part = part.select("doc_id", "feedback_id", F.lit(wave).cast("long").alias("wave"))
        out = part if out is None else out.unionByName(part)
    return out
