"""Repeating requests: greedy leader clusters of similar texts, exactly as taken one by one.

In order, an item that no earlier leader covers and that has a similar item becomes a leader; the
similar items are its members, also those an earlier leader covers.

* Equal texts behave alike, so they are one node from the start: copies never meet each other.
* Only uncovered nodes are ever compared with the others.  They are taken in order in batches of
  bounded size; a batch travels to the executors and the node table is scanned once, in place.
  No pair is made that is not a membership, and nothing is grouped by text or shuffled.
* Memberships of each round are a table in the shared folder; a lost executor redoes one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.functions.common import truncate
from vocspark.functions.similarity import REPEAT_AT, ProbeSet
from vocspark.functions.text import compare_form, request_keywords
from vocspark.operators.similarity import item_text
from vocspark.session import scratch_path, ship_package
from vocspark.sources.tables import spread_small

# A batch of probes is broadcast, so both its rows and its characters are bounded.  The first batch
# is small: its leaders often cover most of the table, and what they cover is never a probe.
FIRST_BATCH_ROWS, BATCH_GROWTH, BATCH_ROWS, BATCH_CHARS = 32, 4, 1_024, 8_000_000
TOP_CLUSTERS, TOP_SUMMARIES, SUMMARY_KEYWORDS = 10, 5, 5


@dataclass
class RepeatAnalysis:
    """``memberships``: (leader_node, node, similarity); ``items``: (node, id …); ``nodes``: one row per text."""

    items: DataFrame
    nodes: DataFrame
    memberships: DataFrame
    total: DataFrame

    def leaders(self) -> DataFrame:
        """(leader_node, alone): nodes with another node as member, or with copies of their own."""
        own = F.col("leader_node") == F.col("node")
        per_leader = self.memberships.groupBy("leader_node").agg(
            F.max(~own).alias("has_others"), F.max(own).alias("covers_itself"))
        joined = per_leader.join(self.nodes.select(F.col("node").alias("leader_node"), "copies"), "leader_node")
        return joined.filter(F.col("has_others") | (F.col("covers_itself") & (F.col("copies") > 1))).select(
            "leader_node", "covers_itself")

    def leader_items(self) -> DataFrame:
        """The leading item of each cluster: the first copy, or every copy of a text unlike itself."""
        first = self.nodes.select(F.col("node").alias("leader_node"), F.col("first_ord"))
        lead = self.leaders().join(first, "leader_node")
        items = self.items.withColumnRenamed("node", "leader_node")
        return items.join(lead, "leader_node").filter(
            ~F.col("covers_itself") | (F.col("ord") == F.col("first_ord"))).drop("first_ord")

    def summary(self) -> DataFrame:
        """One row per cluster: count, distinct sources/audiences/priorities, keywords, summary.

        Counts and value sets come from one pre-aggregated row per node, not from its copies.
        """
        kinds = ["source", "audience", "priority"]
        per_node = self.items.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), *[F.collect_set(k).alias(k) for k in kinds])
        member = self.memberships.join(per_node, "node").groupBy("leader_node").agg(
            F.sum("n").alias("members"), *[F.array_distinct(F.flatten(F.collect_set(k))).alias(f"m_{k}") for k in kinds])
        rows = self.leader_items().join(member, "leader_node")
        count = F.col("members") + F.when(F.col("covers_itself"), 0).otherwise(1)
        return rows.select(
            F.col("id").alias("leader_id"), "ord", count.cast("long").alias("count"),
            *[F.array_sort(F.array_union(f"m_{k}", F.array(k))).alias(plural) for k, plural in
              zip(kinds, ("sources", "audiences", "priorities"), strict=True)],
            request_keywords("text").alias("keywords"),
            truncate(F.coalesce("gist", F.lit("")), 100).alias("summary"))

    def top(self, limit: int = TOP_CLUSTERS) -> DataFrame:
        return self.summary().orderBy(F.col("count").desc(), F.col("ord").asc()).limit(limit)

    def top_requests(self) -> DataFrame:
        return self.top(TOP_SUMMARIES).withColumn("keywords", F.slice("keywords", 1, SUMMARY_KEYWORDS))

    def metrics(self) -> DataFrame:
        """One row: total_items, unique_requests, cluster_count, repetition_rate."""
        lead = self.leaders()
        touched = (self.memberships.join(lead, "leader_node", "left_semi").select("node")
                   .union(lead.select(F.col("leader_node").alias("node"))).distinct())
        clustered = touched.join(self.nodes.select("node", "copies"), "node").agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("clustered"))
        clusters = self.leader_items().agg(F.count(F.lit(1)).alias("cluster_count"))
        one = F.lit(1).alias("one")
        both = self.total.select("*", one).join(clustered.select("*", one), "one").join(clusters.select("*", one), "one")
        return both.select(
            "total_items", (F.col("total_items") - F.col("clustered")).cast("long").alias("unique_requests"), "cluster_count",
            F.round(F.col("clustered") * 100 / F.greatest("total_items", F.lit(1)), 1).alias("repetition_rate"))


def analyze_repeats(df: DataFrame, order_by: Column, key: str = "feedback_id", text: str = "feedback",
                    threshold: float = REPEAT_AT, autojunk: bool = False) -> RepeatAnalysis:
    """Cluster the items of ``df``; ``order_by`` is the order in which items are taken, ties by key."""
    def or_null(name: str, default: str) -> Column:
        return (F.coalesce(name, F.lit(default)) if name in df.columns else F.lit(default)).alias(name)

    items = df.select(
        F.col(key).alias("id"), F.struct(order_by.alias("o"), F.col(key).alias("k")).alias("ord"),
        item_text(df, text).alias("text"), or_null("source", "Unknown"), or_null("audience", "Unknown"),
        or_null("priority", "medium"), or_null("feedback_gist", "").alias("gist"))
    items = items.withColumn("form", compare_form("text")).filter(F.col("form") != "")
    items = _stored(items.withColumn("node", F.sha2("form", 256)), "items")
    nodes = _stored(items.groupBy("node").agg(
        F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("copies"), F.any_value("form").alias("form")), "nodes")
    memberships = _scan_in_rounds(nodes, threshold, autojunk)
    return RepeatAnalysis(items.drop("form"), nodes, memberships, df.agg(F.count(F.lit(1)).alias("total_items")))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MEMBER_TYPE = T.StructType([T.StructField("leader_node", T.StringType()), T.StructField("node", T.StringType()),
                            T.StructField("similarity", T.DoubleType())])


def _scan_in_rounds(nodes: DataFrame, threshold: float, autojunk: bool) -> DataFrame:
    spark = nodes.sparkSession
    folder = scratch_path(spark, "memberships")
    scan_input = spread_small(nodes.select("node", "form"))
    done, last = spark.createDataFrame([], MEMBER_TYPE), None
    round_no, rows = 0, FIRST_BATCH_ROWS
    while batch := _next_batch(nodes, done, last, rows):
        probes = _uncovered_in_batch(spark, batch, threshold, autojunk)
        last = batch[-1]["first_ord"]
        _matches(scan_input, probes, threshold, autojunk).write.parquet(f"{folder}/round={round_no}")
        done = spark.read.schema(MEMBER_TYPE).parquet(*[f"{folder}/round={r}" for r in range(round_no + 1)])
        round_no, rows = round_no + 1, min(rows * BATCH_GROWTH, BATCH_ROWS)
    return done


def _next_batch(nodes: DataFrame, done: DataFrame, last, rows: int) -> list:
    """The next undecided nodes in order, within both bounds; at least one if any is left."""
    open_nodes = nodes if last is None else nodes.filter(
        F.col("first_ord") > F.struct(F.lit(last["o"]).alias("o"), F.lit(last["k"]).alias("k")))
    open_nodes = open_nodes.join(done.select("node").distinct(), "node", "left_anti")
    heads = (open_nodes.select("node", "first_ord", F.length("form").alias("size"))
             .orderBy("first_ord").limit(rows).collect())
    chosen, chars = [], 0
    for row in heads:
        chars += row["size"]
        if chosen and chars > BATCH_CHARS:
            break
        chosen.append(row["node"])
    if not chosen:
        return []
    return nodes.filter(F.col("node").isin(chosen)).select("node", "first_ord", "form").orderBy("first_ord").collect()


def _uncovered_in_batch(spark, batch: list, threshold: float, autojunk: bool) -> list[tuple[str, str]]:
    """Nodes of the batch that no earlier node of the batch covers; pairs are scored on the executors.

    What comes back are pairs of positions, at most half the square of the batch bound.
    """
    numbered = [(str(i), r["form"]) for i, r in enumerate(batch)]
    frame = spark.createDataFrame(numbered, "node string, form string").repartition(spark.sparkContext.defaultParallelism)
    covers: dict[int, list[int]] = {}
    for edge in _matches(frame, numbered, threshold, autojunk, earlier_only=True).select(
            F.col("leader_node").cast("int").alias("i"), F.col("node").cast("int").alias("j")).collect():
        covers.setdefault(edge["i"], []).append(edge["j"])
    covered, probes = set(), []
    for i, row in enumerate(batch):
        if i not in covered:
            probes.append((row["node"], row["form"]))
            covered.update(covers.get(i, ()))
    return probes


def _matches(nodes: DataFrame, probes: list[tuple[str, str]], threshold: float, autojunk: bool,
             earlier_only: bool = False) -> DataFrame:
    """Memberships of ``nodes`` in the clusters of the probes; ``earlier_only``: of probes listed before the node."""
    ship_package(nodes.sparkSession)
    shared = nodes.sparkSession.sparkContext.broadcast(probes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [n for n, _ in shared.value]
        probe_set = ProbeSet([t for _, t in shared.value], threshold, autojunk)
        place = {name: i for i, name in enumerate(names)} if earlier_only else {}
        for batch in batches:
            listed = probe_set.matches_of(batch["form"].tolist(), [place.get(node) for node in batch["node"]])
            found = [(names[i], node, value) for node, pairs in zip(batch["node"], listed, strict=True) for i, value in pairs]
            yield pd.DataFrame(found, columns=["leader_node", "node", "similarity"])

    return nodes.select("node", "form").mapInPandas(scan, MEMBER_TYPE)
