"""Connected components of an edge table by alternating star contractions, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) of every node that has an edge; component_id is the smallest id reachable.

    Each round hangs the larger neighbours of a node on its smallest neighbour, then the smaller ones; about
    log(nodes) rounds.  Minima are combined before the shuffle, and the join back has one row per node on one side,
    so that a hub with very many edges can be split.  Rounds are cut by tables in the shared folder.
    Self-loops and nulls are ignored; an empty edge table gives an empty result.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                      .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialise(large, "edges")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(
            low.select("hi", F.col("m").alias("lo"))).distinct()
        now = materialise(small, "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
    return stars.union(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
