"""Queries that plain SQL cannot say, on whole small tables, against one-row-at-a-time statements."""

import html
import re

from pyspark.sql import functions as F

from bindings import QUERIES, records, repeats
from bindings.fixture import GIST, KEYWORDS, LEXICON, TAXONOMY
from tests import plain
from vocspark.functions import classify as C
from vocspark.functions.similarity import score
from vocspark.plans import flows
from vocspark.sources import records as sources
from vocspark.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"


def titles(spark):
    rows = repeats.titles(spark, FOLDER).collect()
    return sorted((r["feedback_id"], r["feedback"], r["source"]) for r in rows)


def test_page_headings_are_all_found(spark):
    pages = {str(r["page_id"]): r["html"] for r in read_table(spark, FOLDER, "pages").collect()}
    got = {r["page_key"]: r["title"] for r in QUERIES["forum_blocks"](spark, FOLDER).collect()}
    want = {k: re.sub(r"\s+", " ", html.unescape(re.search(r"<article><h1>(.*?)</h1>", v, re.S).group(1))).strip() for k, v in pages.items()}
    assert got == want


def test_repeat_clusters(spark):
    rows = titles(spark)
    source = {k: s for k, _, s in rows}
    clusters, clustered = plain.repeats([(k, t) for k, t, _ in rows], 0.4, score)
    got = {r["leader_id"]: (r["count"], r["sources"]) for r in QUERIES["repeat_clusters"](spark, FOLDER).collect()}
    assert got == {k: (n, ",".join(sorted({source[m] for m in [k, *members]}))) for k, n, members in clusters}
    m = QUERIES["repeat_metrics"](spark, FOLDER).first()
    assert (m["total_items"], m["unique_requests"], m["cluster_count"]) == (len(rows), len(rows) - clustered, len(clusters))
    best = sorted(clusters, key=lambda c: -c[1])[:5]
    assert sorted((r["leader_id"], r["count"]) for r in QUERIES["repeat_top"](spark, FOLDER).collect()) == sorted((k, n) for k, n, _ in best)


def test_similar_items(spark):
    rows = titles(spark)
    probe = rows[0][1]
    want = {k for k, t, _ in rows if t != probe and score(plain.compare_form(probe), plain.compare_form(t)) >= 0.4}
    assert {r["feedback_id"] for r in QUERIES["similar_items"](spark, FOLDER).collect()} == want


def test_collect_flow(spark):
    raw = sources.union_sources(
        sources.issues(records.raw_issues(spark, FOLDER), KEYWORDS), sources.posts(records.raw_posts(spark, FOLDER), KEYWORDS, "x"),
        sources.work_item_feedback(sources.work_items(records.raw_work_items(spark, FOLDER)), KEYWORDS))
    full = flows.enrich(raw, TAXONOMY, F.lit("2024-06-01").cast("timestamp"), LEXICON, GIST).collect()
    assert len(full) == QUERIES["collect_flow"](spark, FOLDER).count() > 300
    alone = C.classify(spark.createDataFrame(
        [(i, r["feedback"], r["source"], r["scenario"], r["organization"]) for i, r in enumerate(full)],
        "n int, feedback string, source string, scenario string, organization string"), TAXONOMY).orderBy("n").collect()
    shared = ("category", "enhanced_category", "subcategory", "audience", "confidence", "primary_domain")
    assert [tuple(r[c] for c in shared) for r in full] == [tuple(r[c] for c in shared) for r in alone]
    assert all(len(r["feedback_id"]) == 36 and 0 < len(r["feedback_gist"]) <= 150 for r in full)
