"""Counts, distributions, option lists and trends.

All groupings here have few groups, so map-side partial aggregation leaves next to nothing to
shuffle however unevenly the rows are spread.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.functions.classify import confidence_level, priority_weight, sla_days
from vocspark.functions.common import blank_to_null
from vocspark.functions.text import request_keywords
from vocspark.schema import DEFAULT_STATE, PRIORITIES, STATES

# What a missing facet value counts as.
FACET_DEFAULTS = {
    "audience": "Unknown", "enhanced_category": "Other", "subcategory": "Uncategorized",
    "priority": "medium", "primary_domain": "General", "feature_area": "General", "source": "Unknown",
}
TREND_FACETS = ["audience", "enhanced_category", "subcategory", "priority", "feature_area"]
OPTION_FACETS = ["source", "category", "enhanced_category", "subcategory", "impact_type", "audience",
                 "primary_domain", "sentiment"]
TOP_REQUESTS, TOP_KEYWORDS = 10, 20


def facet_value(name: str) -> Column:
    return F.coalesce(blank_to_null(name), F.lit(FACET_DEFAULTS[name]))


def _long_form(values: Mapping[str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in values.items()]))


def facet_counts(df: DataFrame, facets=tuple(FACET_DEFAULTS)) -> DataFrame:
    """(facet, value, n) for all facets in one pass."""
    return (df.select(_long_form({f: facet_value(f) for f in facets}).alias("x"))
            .groupBy(F.col("x.facet").alias("facet"), F.col("x.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def trend_counts(df: DataFrame) -> DataFrame:
    return facet_counts(df, TREND_FACETS)


def cross_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    """Count matrix in long form."""
    return (df.groupBy(facet_value(first).alias(first), facet_value(second).alias(second))
            .agg(F.count(F.lit(1)).alias("n")))


def priority_distribution(df: DataFrame) -> DataFrame:
    """(priority, n, percentage); the window runs over the few result rows only."""
    counts = df.groupBy(facet_value("priority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percentage", F.round(F.col("n") * 100 / total, 1))


def confidence_buckets(df: DataFrame) -> DataFrame:
    return df.groupBy(confidence_level("confidence").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def top_requests(df: DataFrame, limit: int = TOP_REQUESTS, created: str = "created",
                 key: str = "feedback_id") -> DataFrame:
    """The first ``limit`` urgent developer, urgent customer and critical items.

    Order: priority weight, then oldest, then key.  The rank filter is pushed below the shuffle
    as a group limit, so each task sends at most ``limit`` rows per list.
    """
    urgent = F.col("priority").isin("high", "critical")
    lists = F.array_compact(F.array(
        F.when((F.col("audience") == "Developer") & urgent, F.lit("top_developer_requests")),
        F.when((F.col("audience") == "Customer") & urgent, F.lit("top_customer_requests")),
        F.when(F.col("priority") == "critical", F.lit("critical_issues"))))
    order = Window.partitionBy("list_name").orderBy(
        priority_weight("priority").desc(), F.col(created).asc_nulls_last(), F.col(key).asc())
    picked = df.filter(urgent).select(key, created, "feedback_gist", "audience", "subcategory", "priority",
                                      F.explode(lists).alias("list_name"))
    return (picked.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
            .select("list_name", "position", key, "feedback_gist", "audience", "subcategory", "priority"))


def top_keywords(df: DataFrame, text: Column | str = "feedback", limit: int = TOP_KEYWORDS) -> DataFrame:
    """Most frequent request keywords, every occurrence counted, ties by word."""
    return (df.select(F.explode(request_keywords(text)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("word").asc()).limit(limit))


def facet_options(df: DataFrame, facets=tuple(OPTION_FACETS)) -> DataFrame:
    """Sorted distinct non-empty values per facet, plus all states of the vocabulary and the data."""
    present = {f: blank_to_null(f) for f in facets}
    if "state" in df.columns:
        present["state"] = F.coalesce(blank_to_null("state"), F.lit(DEFAULT_STATE))
    seen = (df.select(_long_form(present).alias("x")).select("x.facet", "x.value")
            .filter(F.col("value").isNotNull()))
    fixed = [("state", s) for s in STATES] + [("priority", p) for p in PRIORITIES]
    vocabulary = df.sparkSession.createDataFrame(fixed, "facet string, value string")
    return seen.unionByName(vocabulary).distinct().orderBy("facet", "value")


def subcategories_by_area(df: DataFrame) -> DataFrame:
    """Sorted distinct subcategories per feature area."""
    pairs = df.select("feature_area", "subcategory").filter(
        blank_to_null("feature_area").isNotNull() & blank_to_null("subcategory").isNotNull()).distinct()
    return pairs.groupBy("feature_area").agg(F.sort_array(F.collect_list("subcategory")).alias("subcategories"))


def domain_counts(df: DataFrame) -> DataFrame:
    return (df.groupBy(facet_value("primary_domain").alias("primary_domain"))
            .agg(F.count(F.lit(1)).alias("n")))


def source_counts(df: DataFrame) -> DataFrame:
    """Items per source plus a total row."""
    return (df.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.grouping("source").alias("g"))
            .select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "n"))


def state_analytics(history: DataFrame) -> DataFrame:
    """Per entered state: how many entries, and the mean seconds until the next change."""
    seconds = F.unix_micros(F.col("next_at").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return history.groupBy(F.col("new_state").alias("state")).agg(
        F.count(F.lit(1)).alias("entries"), F.count("next_at").alias("left_again"),
        F.round(F.sum(seconds) / F.count("next_at") / 1_000_000, 0).alias("mean_seconds"))


def weekly_trend(df: DataFrame, facet: str, created: str = "created_ts") -> DataFrame:
    return (df.groupBy(F.date_trunc("week", F.col(created)).cast("date").cast("string").alias("week"),
                       facet_value(facet).alias(facet)).agg(F.count(F.lit(1)).alias("n")))


def user_activity(changes: DataFrame) -> DataFrame:
    return changes.groupBy("updated_by").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("state").alias("states"), F.max("at").alias("last_at"))


def with_due_date(df: DataFrame, as_of: Column, created: str = "created_ts") -> DataFrame:
    """Target date by priority, and whether an open item is past it."""
    due = F.date_add(F.to_date(F.col(created)), sla_days("priority"))
    still_open = ~F.coalesce(F.col("state"), F.lit(DEFAULT_STATE)).isin("CLOSED", "IRRELEVANT")
    return df.withColumns({"due_date": due, "overdue": F.coalesce(still_open & (due < as_of), F.lit(False))})

