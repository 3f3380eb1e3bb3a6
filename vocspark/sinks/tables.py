"""Projection to the stored layout, table writes, snapshots and schema upgrades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.functions.text import sanitize_frame
from vocspark.operators.filters import keyword_gate
from vocspark.schema import FEEDBACK_SCHEMA


def project(df: DataFrame, schema: T.StructType = FEEDBACK_SCHEMA) -> DataFrame:
    """Exactly the columns of the layout: missing ones null, extra ones dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Upgrade an older table: append the columns it lacks, keep its own."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.name not in df.columns]


def keywords_to_text(c: Column | str) -> Column:
    """A keyword list as JSON text; a missing list is '[]'."""
    return F.coalesce(F.to_json(c), F.lit("[]"))


def keywords_from_text(c: Column | str) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def nested_to_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats that know only scalars."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    out = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)}
    return df.withColumns(out) if out else df


def write_snapshot(df: DataFrame, folder: str, stamp: str) -> str:
    """CSV snapshot folder ``feedback_<stamp>.csv``; the stamp is given, not read from the clock."""
    path = f"{folder.rstrip('/')}/feedback_{stamp}.csv"
    (nested_to_json(project(df)).write.mode("errorifexists").option("header", True)
     .option("escape", '"').option("encoding", "UTF-8").csv(path))
    return path


def write_table(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet",
                schema: T.StructType = FEEDBACK_SCHEMA, only_with_keywords: bool = False,
                partition_by: list[str] | None = None) -> None:
    """Sanitised rows in the stored layout; overwriting also replaces the table's layout."""
    rows = keyword_gate(df) if only_with_keywords else df
    writer = sanitize_frame(project(rows, schema)).write.mode(mode).format(fmt)
    if mode == "overwrite":
        writer = writer.option("overwriteSchema", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def create_table_if_missing(spark: SparkSession, name: str, schema: T.StructType = FEEDBACK_SCHEMA,
                            fmt: str = "parquet") -> None:
    """Catalog table with the layout, unless it exists."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt}")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType = FEEDBACK_SCHEMA) -> DataFrame:
    """The stored table with any missing columns added, or an empty one if there is none yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return project(spark.read.option("mergeSchema", True).parquet(path), schema)
