"""CSV snapshots: the newest one by name, typed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.schema import FEEDBACK_SCHEMA


def latest_snapshot_path(spark: SparkSession, folder: str, prefix: str = "feedback_") -> str | None:
    """Path of the snapshot whose name sorts last, on any file system Spark can read."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{prefix}*.csv")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(s.getPath().toString()) for s in found or [])
    return names[-1] if names else None


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = FEEDBACK_SCHEMA) -> DataFrame:
    """Read text columns and restore types; NaN and unreadable lists become null and []."""
    header = spark.read.option("header", True).csv(path).columns
    text = T.StructType([T.StructField(c.lstrip("﻿"), T.StringType()) for c in header])
    raw = (spark.read.schema(text).option("header", True).option("multiLine", True)
           .option("escape", '"').option("enforceSchema", True).csv(path))
    columns = []
    for f in schema.fields:
        if f.name not in raw.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value = F.when(~F.lower(f.name).isin("nan", ""), F.col(f.name))
        if isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.StringType):
                value = parse_list_text(value)
            else:
                value = F.from_json(value, f.dataType)
        elif not isinstance(f.dataType, T.StringType):
            value = value.try_cast(f.dataType)
        columns.append(value.alias(f.name))
    return raw.select(*columns)


def parse_list_text(c: Column) -> Column:
    """A list written as JSON, or with single quotes; anything else is an empty list."""
    kind = "array<string>"
    return F.coalesce(F.from_json(c, kind, {"allowSingleQuotes": "true"}), F.array().cast(kind))


def load_latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    path = latest_snapshot_path(spark, folder)
    return read_snapshot(spark, path) if path else spark.createDataFrame([], FEEDBACK_SCHEMA)
