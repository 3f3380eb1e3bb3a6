"""Canonical table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

DOMAIN_TYPE = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("domain_id", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("matched_keywords", T.ArrayType(T.StringType())),
    T.StructField("color", T.StringType()),
])


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


FEEDBACK_SCHEMA = T.StructType(
    _fields(T.StringType(),
            "feedback_id", "title", "feedback", "feedback_gist", "url", "raw",
            "source", "area", "scenario", "organization", "customer", "tag", "status", "created")
    + _fields(T.TimestampType(), "created_ts")
    + _fields(T.StringType(),
              "created_by", "category", "primary_category", "enhanced_category", "subcategory",
              "feature_area", "audience", "priority", "impact_type")
    + _fields(T.DoubleType(), "confidence")
    + _fields(T.ArrayType(DOMAIN_TYPE), "domains")
    + _fields(T.StringType(), "primary_domain")
    + _fields(T.ArrayType(T.StringType()), "matched_keywords")
    + _fields(T.StringType(), "sentiment")
    + _fields(T.DoubleType(), "sentiment_score")
    + _fields(T.StringType(), "sentiment_confidence", "state", "notes")
    + _fields(T.TimestampType(), "last_updated")
    + _fields(T.StringType(), "updated_by")
    + _fields(T.BooleanType(), "user_modified")
    + _fields(T.TimestampType(), "recategorized_at")
)

STATE_SCHEMA = T.StructType(
    _fields(T.StringType(), "feedback_id", "state", "notes", "primary_domain",
            "category", "subcategory", "feature_area")
    + _fields(T.TimestampType(), "last_updated")
    + _fields(T.StringType(), "updated_by")
)

CHANGE_SCHEMA = T.StructType(
    _fields(T.LongType(), "ord")
    + _fields(T.StringType(), "feedback_id", "state", "notes", "domain", "updated_by")
    + _fields(T.TimestampType(), "at")
)

# Workflow states, priority weights with their target days, and defaults.
STATES = {
    "NEW": "New",
    "TRIAGED": "Triaged",
    "CLOSED": "Closed",
    "IRRELEVANT": "Irrelevant",
}
STATE_DESCRIPTIONS = {
    "NEW": "Collected, nobody has looked at it yet",
    "TRIAGED": "Reviewed and put in its category",
    "CLOSED": "Handled and finished",
    "IRRELEVANT": "Outside the scope of the product",
}
DEFAULT_STATE = "NEW"
PRIORITIES = {"critical": (4, 1), "high": (3, 7), "medium": (2, 14), "low": (1, 30)}
DEFAULT_STATUS = "New"
SYSTEM_ACTOR = "System"
