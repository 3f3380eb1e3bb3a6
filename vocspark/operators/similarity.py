"""Items similar to a given text: one scan, no join, no shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.common import col, first_filled, truncate, with_once
from vocspark.functions.similarity import SIMILAR_AT, SLACK, WORD_WEIGHT, score
from vocspark.functions.text import compare_form
from vocspark.session import ship_package
from vocspark.taxonomy import literal_strings

PREVIEW_CHARS = 100


def item_text(df: DataFrame, text: str = "feedback", fallback: str = "feedback_gist") -> Column:
    """The text of an item: its feedback, else its gist."""
    return first_filled(text, fallback) if fallback in df.columns else F.coalesce(col(text), F.lit(""))


def find_similar(df: DataFrame, probe: str, threshold: float = SIMILAR_AT, exclude_self: bool = True,
                 text: str = "feedback", autojunk: bool = False) -> DataFrame:
    """Rows whose score from ``probe`` reaches the threshold, with ``similarity`` and ``preview``.

    The exact score runs in Python only for rows that pass a JVM-side bound from lengths and
    shared words, which no qualifying row can fail.
    """
    spark = df.sparkSession
    ship_package(spark)
    probe_form = spark.range(1).select(compare_form(F.lit(probe)).alias("c")).first()["c"]
    if not probe_form:
        return df.withColumns({"similarity": F.lit(0.0), "preview": F.lit("")}).limit(0)
    probe_words = sorted(set(probe_form.split(" ")))

    @F.pandas_udf("double")
    def exact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: score(probe_form, t, autojunk))

    rows = df.withColumn("_raw", item_text(df, text))
    if exclude_self:
        rows = rows.filter(F.col("_raw") != probe)
    rows = rows.withColumn("_form", compare_form("_raw")).filter(F.col("_form") != "")
    rows = rows.withColumn("_words", F.array_distinct(F.split("_form", " ")))
    length, n = F.length("_form"), len(probe_form)
    bound = 2 * F.least(length, F.lit(n)) / (length + n) + WORD_WEIGHT * F.size(
        F.array_intersect("_words", literal_strings(probe_words))) / F.greatest(F.size("_words"), F.lit(len(probe_words)))
    # A generator output is computed once a row; a plain column would be scored again by the filter.
    return (with_once(with_once(rows, "_bound", bound).filter(F.col("_bound") >= threshold - SLACK), "_score", exact("_form"))
            .filter(F.col("_score") >= threshold)
            .withColumns({"similarity": F.round("_score", 3), "preview": truncate("_raw", PREVIEW_CHARS)})
            .drop("_raw", "_form", "_words", "_bound", "_score"))


def most_similar_first(df: DataFrame, key: str = "feedback_id") -> DataFrame:
    return df.orderBy(F.col("similarity").desc(), F.col(key).asc())
