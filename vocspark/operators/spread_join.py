"""An inner join whose frequent keys are dealt over many tasks, at any size of the input.

A key is heavy if it holds more than one part in ``SHARE`` of the left rows.  At most ``SHARE`` keys can be, so their list has a proven bound and may
go to every task.  The left rows of a heavy key are dealt over as many salts as it holds such parts, and its right rows are repeated once
a salt: no bucket of the join gets more than one part in ``SHARE`` of the left rows from one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1_000


def heavy_keys(counts: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """(key, _splits) of the heavy keys, at most ``share`` rows; ``counts`` has the columns ``key`` and ``n`` and one row a key."""
    # Both sides of the join read one shuffle of the counts.
    both = counts.join(F.broadcast(counts.agg(F.sum("n").alias("_total"))), F.col("n") * share > F.col("_total"))
    heavy = both.select(key, F.ceil(F.col("n") * share / F.col("_total")).cast("int").alias("_splits"))
    return counts.sparkSession.createDataFrame(heavy.collect(), heavy.schema)


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, deal_by: str, share: int = SHARE) -> DataFrame:
    """``left`` inner join ``right`` on ``key``; left rows of a heavy key are dealt by the hash of ``deal_by``.  Null keys match nothing."""
    heavy = F.broadcast(heavy_keys(counts, key, share))
    salt = F.when(F.col("_splits").isNull(), 0).otherwise(F.pmod(F.hash(deal_by), F.col("_splits")))
    dealt = left.join(heavy, key, "left").withColumn("_salt", salt).drop("_splits")
    last = F.coalesce("_splits", F.lit(1)) - 1
    copies = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_splits")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
