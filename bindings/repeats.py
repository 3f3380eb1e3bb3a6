"""Similar items and repeating requests."""

from pyspark.sql import functions as F

from bindings.records import page_blocks
from bindings.registry import query
from vocspark.operators.repeats import analyze_repeats
from vocspark.operators.similarity import find_similar, most_similar_first


def titles(spark, folder):
    """Page headings as short requests."""
    return page_blocks(spark, folder).select(
        F.col("page_key").cast("long").alias("feedback_id"), F.col("title").alias("feedback"),
        F.concat(F.lit("s"), F.pmod(F.col("page_key").cast("long"), F.lit(5)).cast("string")).alias("source"))


@query("similar_items")
def similar_items(spark, folder):
    """All page headings that resemble the first one of the table."""
    items = titles(spark, folder)
    probe = items.agg(F.min_by("feedback", "feedback_id").alias("t")).first()["t"]
    return most_similar_first(find_similar(items, probe, threshold=0.4).select("feedback_id", "similarity", "preview"))


def _analysis(spark, folder):
    return analyze_repeats(titles(spark, folder), F.col("feedback_id"))


@query("repeat_clusters")
def repeat_clusters(spark, folder):
    rows = _analysis(spark, folder).summary()
    return rows.select("leader_id", "count", *[F.array_join(c, ",").alias(c) for c in ("sources", "audiences", "priorities", "keywords")])


@query("repeat_top")
def repeat_top(spark, folder):
    rows = _analysis(spark, folder).top_requests()
    return rows.select("leader_id", "count", F.array_join("sources", ",").alias("sources"), F.array_join("keywords", ",").alias("keywords"))


@query("repeat_metrics")
def repeat_metrics(spark, folder):
    return _analysis(spark, folder).metrics()
