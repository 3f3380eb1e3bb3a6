"""Deep pages of a sorted view without sorting it for every page.

A view is written once in its order: range-partitioned by the sort columns, one directory for each range, and beside it how many rows each range
holds.  A page adds up those counts, reads the one or two ranges in which its rows lie, and sorts only them.  Rows that agree in all sort
columns are told apart by a number given when they are written, so a value that very many rows share is cut over ranges too.

Null sort values stand where the sort columns put them; an empty view and pages behind the end are empty; repeated rows stay.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.operators.filters import PAGE_SIZE, sort_keys

RANGE, TIE = "_range", "_tie"
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class PagedTable:
    """``directory``: (range, rows) of every range that holds rows, in order; one small entry for each written file."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    order: tuple[Column, ...]
    directory: tuple[tuple[int, int], ...]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.directory)

    def ranges_of(self, first: int, rows: int) -> tuple[list[int], int]:
        """The ranges that hold the places ``first`` to ``first + rows - 1`` (from 0), and how many rows of them come before."""
        ends = list(accumulate(n for _, n in self.directory))
        if rows <= 0 or not ends or first >= ends[-1]:
            return [], 0
        low, high = bisect_right(ends, first), bisect_right(ends, min(first + rows, ends[-1]) - 1)
        return [r for r, _ in self.directory[low:high + 1]], first - (ends[low - 1] if low else 0)

    def page(self, number: int, per_page: int = PAGE_SIZE) -> DataFrame:
        """Page ``number`` (from 1), in order."""
        wanted, before = self.ranges_of((number - 1) * per_page, per_page)
        schema = T.StructType([*self.schema.fields, T.StructField(TIE, T.LongType()), T.StructField(RANGE, T.IntegerType())])
        stored = self.spark.read.schema(schema).parquet(f"{self.folder}/rows").filter(F.col(RANGE).isin(wanted) if wanted else F.lit(False))
        return stored.orderBy(*self.order, F.col(TIE)).offset(before).limit(per_page).drop(RANGE, TIE)

    def summary(self, number: int, per_page: int = PAGE_SIZE) -> DataFrame:
        """One row: total_count, page, per_page, has_more, from the directory alone."""
        return self.spark.createDataFrame([(self.total, number, per_page, self.total > number * per_page)],
                                          "total_count bigint, page bigint, per_page bigint, has_more boolean")


def open_pages(spark: SparkSession, folder: str, schema: T.StructType, sort_by: str = "newest", created: str = "created",
               key: str = "feedback_id") -> PagedTable:
    """A written view, with the schema of its rows and the order it was written in."""
    counts = spark.read.schema("range int, rows bigint").parquet(f"{folder}/counts").collect()
    return PagedTable(spark, folder, schema, tuple(sort_keys(sort_by, created, key)), tuple(sorted((r["range"], r["rows"]) for r in counts)))


def write_pages(df: DataFrame, folder: str, sort_by: str = "newest", created: str = "created", key: str = "feedback_id",
                range_rows: int = RANGE_ROWS) -> PagedTable:
    """Write ``df`` below ``folder`` in the order of :func:`vocspark.operators.filters.sort_keys`, about ``range_rows`` rows a range.

    The view behind ``df`` is read three times (count, range borders, rows) and should be a table.
    """
    spark = df.sparkSession
    if clash := {RANGE, TIE} & set(df.columns):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    ranges = max(1, -(-df.count() // range_rows))
    dealt = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(ranges, *sort_keys(sort_by, created, key), F.col(TIE))
    dealt.withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(f"{folder}/rows")
    found = spark.read.schema(f"{RANGE} int").parquet(f"{folder}/rows").groupBy(F.col(RANGE).alias("range")).agg(F.count(F.lit(1)).alias("rows"))
    found.write.parquet(f"{folder}/counts")
    return open_pages(spark, folder, df.schema, sort_by, created, key)
