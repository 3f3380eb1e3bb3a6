"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Below this many bytes per core, a scan is spread over all cores; above, the scan's own
# partitions are kept, so a large table is never shuffled just to be read.
SPREAD_BYTES_PER_CORE = 32 * 1024 * 1024


def spread_small(df: DataFrame) -> DataFrame:
    """Use every core on small inputs, whose few row groups would all land in one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES_PER_CORE else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
