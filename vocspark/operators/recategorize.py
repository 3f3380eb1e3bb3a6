"""Classify stored rows again without losing what people decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.classify import classification, keyword_hits
from vocspark.functions.common import blank_to_null
from vocspark.operators.filters import uncurated
from vocspark.operators.state import SHARED_FIELDS
from vocspark.taxonomy import Taxonomy

AUTO_FIELDS = ["enhanced_category", "subcategory", "feature_area", "audience", "priority", "impact_type", "confidence"]


def recategorize_preserving(feedback: DataFrame, states: DataFrame, tax: Taxonomy, at: Column,
                            content: str = "feedback") -> DataFrame:
    """Un-curated rows with fresh classes; filled state values win over fresh ones.

    Adds ``overrides_kept``.  Text is title, blank line, content.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit("")))
    s = states.select("feedback_id", *[blank_to_null(c).alias(f"s_{c}") for c in SHARED_FIELDS])
    rows = feedback.filter(uncurated()).withColumn("_hits", keyword_hits(text, tax))
    rows = rows.withColumn("_new", classification(text, tax, hits=F.col("_hits"))).drop("_hits")
    rows = rows.join(s, "feedback_id", "left")
    kept = F.lit(False)
    for c in SHARED_FIELDS:
        kept = kept | F.col(f"s_{c}").isNotNull()
    fresh = {c: F.col(f"_new.{c}") for c in [*AUTO_FIELDS, "category", "domains", "primary_domain"]}
    fresh.update({c: F.coalesce(F.col(f"s_{c}"), F.col(f"_new.{c}")) for c in SHARED_FIELDS})
    fresh["primary_category"] = F.col("_new.enhanced_category")
    fresh["recategorized_at"] = at
    fresh["overrides_kept"] = kept
    return rows.withColumns(fresh).drop("_new", *[f"s_{c}" for c in SHARED_FIELDS])


def recategorize_all(feedback: DataFrame, tax: Taxonomy, at: Column, content: str = "feedback") -> DataFrame:
    """All rows; the classes of un-curated ones are renewed from their content, domains stay."""
    renew = uncurated()
    text = F.coalesce(content, F.lit(""))
    fresh = feedback.withColumn("_hits", keyword_hits(F.when(renew, text), tax))
    fresh = fresh.withColumn("_new", F.when(renew, classification(text, tax, hits=F.col("_hits")))).drop("_hits")
    values = {c: F.when(renew, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in AUTO_FIELDS}
    values["recategorized_at"] = F.when(renew, at).otherwise(F.col("recategorized_at"))
    return fresh.withColumns(values).drop("_new")


def preserving_counters(result: DataFrame) -> DataFrame:
    return result.agg(F.count(F.lit(1)).alias("updated"),
                      F.coalesce(F.sum(F.col("overrides_kept").cast("long")), F.lit(0)).cast("long").alias("preserved"))


def skip_counters(feedback: DataFrame) -> DataFrame:
    """One row: recategorized, skipped_user_modified, total_processed."""
    done = F.coalesce(F.sum(uncurated().cast("long")), F.lit(0)).cast("long")
    return feedback.agg(done.alias("recategorized"), F.count(F.lit(1)).alias("total_processed")).select(
        "recategorized", (F.col("total_processed") - F.col("recategorized")).alias("skipped_user_modified"),
        "total_processed")
