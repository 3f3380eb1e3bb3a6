"""Sources, sinks, flows and streams on small records."""

import datetime as dt
import json

from pyspark.sql import functions as F

from vocspark.operators import dedup
from vocspark.plans import flows
from vocspark.schema import FEEDBACK_SCHEMA, STATE_SCHEMA
from vocspark.sinks import tables
from vocspark.sinks.state_table import StateTable
from vocspark.sources import forum_html, records, snapshots
from vocspark.streaming import jobs
from vocspark.taxonomy import default_taxonomy


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def json_frame(spark, schema, *rows):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string")
    return lines.select(F.from_json("v", schema).alias("r")).select("r.*")


def test_posts(spark):
    raw = json_frame(
        spark, records.POST_SCHEMA,
        {"title": "Report broken", "selftext": "an ERROR", "permalink": "/p/1", "author": None, "created_utc": 60,
         "link_flair_richtext": [{"e": "text", "t": "A"}, {"e": "emoji", "t": "x"}, {"e": "text", "t": ""}, {"e": "text", "t": "B"}]},
        {"title": "Report", "selftext": "", "permalink": "/p/2", "author": "ann", "created_utc": 61.5, "link_flair_text": "plain"},
        {"title": "Nothing", "selftext": "of interest", "permalink": "/p/3", "author": "bob", "created_utc": 0})
    got = [tuple(r) for r in records.posts(raw, ["report"], "sub").select(
        "url", "customer", "tag", "created", "impact_type", "feedback", "organization").collect()]
    assert got == [("https://www.reddit.com/p/1", "N/A", "A, B", "1970-01-01T00:01:00", "Bug", "Report broken\n\nan ERROR", "Reddit/sub"),
                   ("https://www.reddit.com/p/2", "ann", "plain", "1970-01-01T00:01:01.500000", "Feedback", "Report\n\n", "Reddit/sub")]


def test_issues_and_discussions(spark):
    raw = json_frame(
        spark, records.ISSUE_SCHEMA,
        {"owner": "o", "repo": "r", "number": 1, "title": "T", "body": None, "user": None, "created_at": "2024-01-01T00:00:00Z", "html_url": "u1",
         "state": "closed", "labels": [{"name": "Bug"}, {"name": ""}, {"name": "x"}]},
        {"owner": "o", "repo": "r", "number": 2, "title": "PR", "pull_request": {"url": "z"}})
    r = records.issues(raw, ["t"]).collect()
    assert len(r) == 1
    assert (r[0]["tag"], r[0]["status"], r[0]["customer"], r[0]["feedback"], r[0]["impact_type"], r[0]["matched_keywords"]) == (
        "Bug, x", "Closed", "Anonymous", "T\n\n", "Bug", ["t"])
    talk = json_frame(spark, records.DISCUSSION_SCHEMA, {"owner": "o", "title": "Idea", "body": "improve", "html_url": "u"},
                      {"owner": "o", "title": "x", "user": {"login": "ann"}, "category": {"name": "Q&A"}})
    got = [tuple(r) for r in records.discussions(talk, []).select("area", "customer", "impact_type", "organization").collect()]
    assert got == [("General", "Anonymous", "Feature Request", "GitHub/o"), ("Q&A", "ann", "Feedback", "GitHub/o")]


def test_repositories(spark):
    raw = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "owner string, repo string")
    schema = "owner string, repo string, enabled boolean"
    config = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "", True)], schema)
    assert [tuple(r) for r in records.wanted_repositories(raw, config).collect()] == [("a", "x")]
    assert [tuple(r) for r in records.wanted_repositories(raw, config.limit(0), ("b", "x")).collect()] == [("b", "x")]


def work(spark):
    long = "<p>" + "word " * 200 + "</p>"
    return json_frame(
        spark, records.WORK_ITEM_SCHEMA,
        {"id": 1, "fields": {"System.Title": "One", "System.CreatedBy": '{"displayName":"Ann"}', "System.Description": long, "System.CreatedDate": "2024-05-01"},
         "relations": [{"rel": "System.LinkTypes.Hierarchy-Forward", "url": "h/2"}, {"rel": "Some-CHILD", "url": "h/3x"}, {"rel": "Other", "url": "h/3"}]},
        {"id": 2, "fields": {"System.Title": "Two", "System.History": "seen", "System.Description": "", "System.CreatedBy": "{}", "System.CreatedDate": "2024-05-02"}},
        {"id": 3, "fields": {"System.CreatedDate": "2020-01-01"}})


def test_work_items(spark):
    rows = {r["id"]: r for r in records.work_items(work(spark), "https://h").collect()}
    assert rows[1]["created_by"] == "Ann" and len(rows[1]["description"]) == 999 and len(rows[1]["preview"]) == 503 and rows[1]["preview"].endswith("...")
    assert (rows[2]["description"], rows[2]["created_by"]) == ("seen", "Unknown")
    assert (rows[3]["title"], rows[3]["type"], rows[3]["description"], rows[3]["created_by"]) == ("No Title", "Unknown", records.NO_DESCRIPTION, "Unassigned")
    assert [tuple(r) for r in records.child_ids(work(spark)).collect()] == [(1, 2)]
    assert [r["id"] for r in records.children_or_recent(work(spark), 1, now(), 5).collect()] == [2]
    assert [r["id"] for r in records.children_or_recent(work(spark), 3, now(), 5).collect()] == [2, 1]
    made = {r["ado_id"]: r for r in records.work_item_feedback(records.work_items(work(spark))).collect()}
    assert made["2"]["title"] == "[ADO-2] Two" and made["2"]["feedback"] == "Two\n\nseen" and made["3"]["feedback"] == "No Title"


PAGE = """<html><section class="entry x"><h3 class="head"><a href="/t/1">Slow &amp; <b>sad</b></a></h3><i class=who>Ann</i>
<div class="when"><time class="d">&lrm;03-04-2024</time> <time class="t">05:06 PM</time></div>
<p class="text">Some <i>text</i>\n here<br>more</p><ul><li>L1</li><li>L2</li></ul></section>
<section class="entry"><h3 class="head"><a>no link</a></h3></section>
<section class="entry"><h3 class="head"><a href="https://else/2">Only title</a></h3><p class="text"> </p></section>"""
LAYOUT = forum_html.PageSpec(block="section.entry", title="h3.head a", body="p.text", author="i.who", date="div.when time.d",
                             time="div.when time.t", label="ul li")


def test_forum_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>")], "page_num int, html string")
    bare = forum_html.extract_blocks(pages, "page_num", forum_html.PageSpec("section", "h3 a", "p")).first()
    assert (bare["title"], bare["author"], bare["date_text"], list(bare["labels"])) == ("Slow &sad", None, None, [])
    blocks = forum_html.extract_blocks(pages, "page_num", LAYOUT)
    assert blocks.count() == 3
    rows = forum_html.forum_feedback(blocks, ["sad"], now(), "https://forum/x").orderBy("url").collect()
    got = [(r["feedback"], r["url"], r["customer"], r["tag"], r["created"]) for r in rows]
    assert got == [("Only title", "https://else/2", "Unknown Author", "", "2024-06-01T00:00:00+00:00"),
                   ("Some text here more", "https://forum/t/1", "Ann", "L1, L2", "2024-03-04T17:06:00+00:00")]


def collected(spark, *texts):
    df = spark.createDataFrame([(i, t, f"2024-01-{i + 1:02d}T00:00:00Z") for i, t in enumerate(texts)], "n long, feedback string, created string")
    return flows.enrich(df.withColumns({"source": F.lit("Reddit"), "scenario": F.lit("Customer"), "organization": F.lit(""),
                                        "customer": F.lit("ann"), "title": F.lit(None).cast("string"),
                                        "matched_keywords": F.array(F.lit("k"))}), default_taxonomy(), now())


def test_enrich_fills_every_column(spark):
    r = collected(spark, "The dashboard is slow. I hate it").first()
    assert (r["enhanced_category"], r["primary_domain"], r["sentiment"], r["state"], r["updated_by"], r["audience"]) == (
        "Using the product", "Speed", "Negative", "NEW", "System", "Customer")
    assert len(r["feedback_id"]) == 36 and r["created_ts"] == dt.datetime(2024, 1, 1)
    assert not [c for c in FEEDBACK_SCHEMA.names if c not in r.asDict()]


def test_work_item_titles_carry_no_sentiment(spark):
    raw = json_frame(spark, records.WORK_ITEM_SCHEMA, {"id": 1, "fields": {"System.Title": "terrible bad", "System.Description": "good"}},
                     {"id": 2, "fields": {"System.Title": "terrible bad"}})
    rows = flows.enrich(records.work_item_feedback(records.work_items(raw)), default_taxonomy(), now())
    assert [r["sentiment"] for r in rows.orderBy("title").collect()] == ["Positive", "Negative"]
    assert "sentiment_text" not in rows.columns


def test_enrich_is_one_narrow_stage(spark):
    plan = collected(spark, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_view(spark):
    from vocspark.operators.filters import FilterSpec
    view = flows.filtered_view(collected(spark, "slow report", "nice button", "slow menu"), FilterSpec(domains=("Speed",)), 1, 1)
    assert view.summary.first().asDict() == {"total_count": 2, "page": 1, "per_page": 1, "has_more": True}
    assert view.rows.first()["feedback"] == "slow menu" and view.filters == {"domains": ("Speed",)}
    assert ("primary_domain", "Speed") in {(r["facet"], r["value"]) for r in view.facets.collect()}


def test_sync_twice_adds_once(spark):
    batch = collected(spark, "slow report", "slow  report!", "nice button")
    none = spark.createDataFrame([], FEEDBACK_SCHEMA)
    states = spark.createDataFrame([(collected(spark, "slow report").first()["feedback_id"], "CLOSED", "n", "Mine", None, None, None, None, "bob")], STATE_SCHEMA)
    first = flows.sync(batch, none, states, "n")
    assert first.counters.first()["new_items"] == 3
    current = {r["feedback"]: (r["state"], r["primary_domain"]) for r in first.current.collect()}
    assert current["slow report"] == ("CLOSED", "Mine") and current["nice button"][0] == "NEW"
    again = flows.sync(batch, tables.project(first.stored_after), states, "n")
    assert again.counters.first()["new_items"] == 0 and again.stored_after.count() == 3


def test_projection_and_migration(spark):
    df = spark.createDataFrame([("a", 1)], "feedback_id string, extra int")
    assert tables.project(df).schema.names == FEEDBACK_SCHEMA.names
    assert tables.missing_columns(df, STATE_SCHEMA)[0] == "state"
    assert tables.add_missing_columns(df, STATE_SCHEMA).columns == ["feedback_id", "extra", *STATE_SCHEMA.names[1:]]


def test_snapshot_round_trip(spark, tmp_path):
    folder = str(tmp_path)
    rows = collected(spark, 'a "quoted", slow\nline\\', "good")
    tables.write_snapshot(rows.limit(1), folder, "20240101_000000")
    tables.write_snapshot(rows, folder, "20240102_000000")
    back = snapshots.load_latest_snapshot(spark, folder)
    assert back.schema.simpleString() == FEEDBACK_SCHEMA.simpleString() and back.count() == 2

    def view(df):
        return sorted((r["feedback"], r["confidence"], r["matched_keywords"], [d["domain"] for d in r["domains"]], r["created_ts"]) for r in df.collect())
    assert view(back) == view(tables.project(rows))
    assert snapshots.load_latest_snapshot(spark, folder + "/none").count() == 0


def test_snapshot_reads_foreign_spelling(spark, tmp_path):
    (tmp_path / "feedback_1.csv").write_text("﻿feedback_id,confidence,matched_keywords,title\na,nan,\"['x', 'y']\",nan\nb,0.5,oops,t\n", encoding="utf-8")
    got = [tuple(r) for r in snapshots.load_latest_snapshot(spark, str(tmp_path)).select(
        "feedback_id", "confidence", "matched_keywords", "title").orderBy("feedback_id").collect()]
    assert got == [("a", None, ["x", "y"], None), ("b", 0.5, [], "t")]


def test_table_write(spark, tmp_path):
    path = str(tmp_path / "t")
    df = collected(spark, "a\x07b", "c").withColumn("matched_keywords", F.when(F.col("n") == 0, F.array(F.lit("k"))))
    tables.write_table(df, path, only_with_keywords=True)
    got = tables.read_or_empty(spark, path)
    assert [r["feedback"] for r in got.collect()] == ["ab"]
    tables.write_table(df, path, mode="overwrite")
    assert tables.read_or_empty(spark, path).count() == 2
    assert tables.read_or_empty(spark, path + "none").count() == 0
    tables.create_table_if_missing(spark, "made_table", STATE_SCHEMA)
    tables.create_table_if_missing(spark, "made_table", STATE_SCHEMA)
    assert spark.table("made_table").columns == STATE_SCHEMA.names
    spark.sql("DROP TABLE made_table")


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(json.dumps(r) for r in rows))
    (folder / f".{name}").rename(folder / name)


def test_ingest_stream(spark, tmp_path):
    landed, table = tmp_path / "in", str(tmp_path / "table")
    schema = "feedback string, created string"

    def to_feedback(df):
        more = df.withColumns({"source": F.lit("Reddit"), "scenario": F.lit(""), "organization": F.lit(""), "customer": F.lit("x"),
                               "title": F.lit(None).cast("string")})
        return flows.enrich(more, default_taxonomy(), now())

    def run():
        q = jobs.ingest_stream(spark, str(landed), schema, to_feedback, table, str(tmp_path / "cp"))
        q.awaitTermination(120)
        return sorted(r["feedback"] for r in spark.read.schema(FEEDBACK_SCHEMA).parquet(table).collect())

    land(landed, "a.json", [{"feedback": "one", "created": "2024-05-01"}, {"feedback": "one", "created": "2024-05-01"}, {"feedback": "two", "created": "2024-05-02"}])
    assert run() == ["one", "two"]
    land(landed, "b.json", [{"feedback": "two", "created": "2024-05-02"}, {"feedback": "old", "created": "2001-01-01"}])
    assert run() == ["old", "one", "two"]


def test_triage_stream(spark, tmp_path):
    landed, table = tmp_path / "in", StateTable(spark, str(tmp_path / "states"), buckets=16)

    def run():
        jobs.triage_stream(spark, str(landed), table, str(tmp_path / "cp")).awaitTermination(120)
        return {r["feedback_id"]: (r["state"], r["notes"]) for r in table.read().collect()}

    land(landed, "a.json", [{"ord": 1, "feedback_id": "a", "state": "TRIAGED", "at": "2024-01-01T00:00:00Z"}, {"ord": 2, "feedback_id": "b", "notes": "n"}])
    assert run() == {"a": ("TRIAGED", None), "b": ("NEW", "n")}
    land(landed, "b.json", [{"ord": 3, "feedback_id": "a", "notes": "m"}])
    assert run() == {"a": ("TRIAGED", "m"), "b": ("NEW", "n")}
    assert table.versions() == [1, 2]


def test_collect_limits_each_source(spark):
    a = spark.range(5).select(F.lit("A").alias("source"), F.col("id").cast("string").alias("url"), F.lit("2024").alias("created"))
    b = a.withColumn("source", F.lit("B")).limit(1)
    got = sorted((r["source"], r["url"]) for r in flows.collect(a, b, limit=2).collect())
    assert got == [("A", "0"), ("A", "1"), ("B", "0")]
    assert flows.collect(a, b).count() == 6


def test_union_fills_unknown_columns(spark):
    a, b = spark.createDataFrame([("x",)], "source string"), spark.createDataFrame([("y", "t")], "source string, tag string")
    assert sorted((r["source"], r["tag"]) for r in records.union_sources(a, b).collect()) == [("x", None), ("y", "t")]
    assert dedup.stored_ids(spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "feedback_id string")).count() == 1
