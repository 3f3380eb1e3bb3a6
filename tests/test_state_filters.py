"""Triage state, filters and statistics on small tables with every special case."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vocspark.operators import filters, recategorize, state, stats
from vocspark.schema import CHANGE_SCHEMA, STATE_SCHEMA
from vocspark.taxonomy import default_taxonomy

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(i, *r, T0 + dt.timedelta(minutes=i)) for i, r in enumerate(rows)], CHANGE_SCHEMA)


def table(spark, rows):
    return spark.createDataFrame(rows, STATE_SCHEMA)


def test_upsert_equals_one_by_one_application(spark):
    rng = random.Random(2)
    current = {f"f{i}": {"state": rng.choice(["NEW", None]), "notes": None, "domain": "D", "by": "x"} for i in range(4)}
    rows = [(rng.choice(["f0", "f1", "f2", "f7", "f8", "", None]), rng.choice([None, "TRIAGED", "CLOSED"]), rng.choice([None, "n", ""]),
             rng.choice([None, "E", ""]), rng.choice([None, "", "ann"])) for _ in range(60)]
    start = table(spark, [(k, v["state"], v["notes"], v["domain"], None, None, None, T0, v["by"]) for k, v in current.items()])
    got = {r["feedback_id"]: (r["state"], r["notes"], r["primary_domain"], r["updated_by"])
           for r in state.upsert_states(start, log(spark, rows)).collect()}
    for key, s, n, d, who in rows:
        if not key:
            continue
        row = current.setdefault(key, {"state": "NEW", "notes": None, "domain": None, "by": None})
        for name, value in (("state", s), ("notes", n), ("domain", d)):
            if value is not None:
                row[name] = value
        row["by"] = who or "unknown_user"
    assert got == {k: (v["state"], v["notes"], v["domain"], v["by"]) for k, v in current.items()}


def test_session_actor_wins(spark):
    out = state.collapse_changes(log(spark, [("a", "NEW", None, None, "ann")]), actor="me").first()
    assert out["updated_by"] == "me"


def test_history_across_slices_and_within(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "cold"]), rng.choice(["NEW", "TRIAGED", "CLOSED", None]), None, None, "u") for _ in range(300)]
    got = sorted((r["feedback_id"], r["at"], r["old_state"], r["new_state"], r["next_at"]) for r in state.state_history(log(spark, rows)).collect())
    want, last = [], {}
    for i, (key, s, *_rest) in enumerate(rows):
        if s is None or last.get(key, (None, None))[0] == s:
            continue
        at = T0 + dt.timedelta(minutes=i)
        want.append([key, at, last.get(key, (None, None))[0], s, None])
        if key in last:
            last[key][1][4] = at
        last[key] = (s, want[-1])
    assert got == sorted(tuple(w) for w in want)


def test_field_edits_are_routed(spark):
    schema = "feedback_id string, primary_domain string, category string, subcategory string, feature_area string, audience string"
    feedback = spark.createDataFrame([("a", "D", "C", "S", "A", "Customer")], schema)
    states = table(spark, [("b", "NEW", "n", None, None, None, None, T0, "x")])
    rows = [("a", "primary_domain", "D2"), ("a", "audience", "Developer"), ("a", "state", "CLOSED"), ("c", "audience", "Developer"),
            ("d", "category", None), ("a", "title", "no"), ("b", "notes", None), ("a", "primary_domain", "D3")]
    edits = spark.createDataFrame([(i, *r, T0 + dt.timedelta(hours=i), f"u{i}") for i, r in enumerate(rows)],
                                  "ord long, feedback_id string, field string, value string, at timestamp, by string")
    f, s = state.apply_field_edits(feedback, states, edits)
    assert tuple(f.first()) == ("a", "D3", "C", "S", "A", "Developer")
    got = {r["feedback_id"]: (r["state"], r["notes"], r["primary_domain"], r["updated_by"]) for r in s.collect()}
    assert got == {"a": ("CLOSED", None, "D3", "u7"), "b": ("NEW", None, None, "u6"), "d": (None, None, None, "u4")}


def test_overlay_sync_and_fallback_treat_blank_as_open(spark):
    feedback = spark.createDataFrame(
        [("a", "NEW", "D", None, None, None), ("b", "NEW", "D", None, None, None), ("c", "NEW", None, None, None, None)],
        "feedback_id string, state string, primary_domain string, notes string, updated_by string, last_updated timestamp")
    states = table(spark, [("a", "CLOSED", "", "", None, None, None, T0, ""), ("b", "", "n", "E", None, None, None, None, "ann"),
                           ("c", None, None, "E", None, None, None, None, None), (" ", None, None, None, None, None, None, None, None)])
    got = {r["feedback_id"]: (r["state"], r["primary_domain"], r["notes"], r["updated_by"], r["last_updated"])
           for r in state.overlay_states(feedback, states).collect()}
    assert got == {"a": ("CLOSED", "D", None, None, T0), "b": ("NEW", "E", "n", "ann", None), "c": ("NEW", "E", None, None, None)}
    synced = {r["feedback_id"]: (r["primary_domain"], r["domain_synced"]) for r in state.sync_domains(feedback, states).collect()}
    assert synced == {"a": ("D", False), "b": ("E", True), "c": ("E", True)}
    full = feedback.withColumns({c: F.lit("x") for c in ("category", "subcategory", "feature_area")})
    assert state.states_with_fallback(states, full).count() == 3
    assert state.states_with_fallback(states, full, keep_blank_ids=True).count() == 4


def test_changes_are_split(spark):
    changes = log(spark, [("a", "NEW", None, "D", None), ("", "NEW", None, None, None), ("a", "odd", None, None, None), ("a", None, None, "X", None)])
    valid, rejected = state.split_changes(changes, ["D"])
    assert valid.count() == 1
    assert sorted(r["reason"] for r in rejected.collect()) == ["missing feedback_id", "unknown domain", "unknown state"]


def test_initial_state_keeps_work_in_progress(spark):
    df = spark.createDataFrame([("a", None, "old", None, None), ("b", "CLOSED", "n", T0, "ann")],
                               "feedback_id string, state string, notes string, last_updated timestamp, updated_by string")
    got = [tuple(r) for r in state.initial_states(df, F.lit("2024-05-05").cast("timestamp")).collect()]
    assert got == [("a", "NEW", "", dt.datetime(2024, 5, 5), "System"), ("b", "CLOSED", "n", T0, "ann")]


def test_curated_rows_are_not_recategorized(spark):
    schema = ("feedback_id string, title string, feedback string, source string, scenario string, organization string, user_modified boolean, "
              "category string, enhanced_category string, subcategory string, feature_area string, audience string, priority string, "
              "impact_type string, confidence double, primary_domain string, recategorized_at timestamp")
    rows = [(k, "t", "the dashboard is slow", "", "", "", flag, *["old"] * 7, 0.0, "old", None) for k, flag in (("a", True), ("b", False), ("c", None))]
    feedback = spark.createDataFrame(rows, schema)
    out = {r["feedback_id"]: r for r in recategorize.recategorize_all(feedback, default_taxonomy(), F.lit(T0)).collect()}
    assert out["a"]["enhanced_category"] == "old" and out["a"]["recategorized_at"] is None
    assert out["b"]["enhanced_category"] != "old" and out["c"]["primary_domain"] == "old"
    states = table(spark, [("b", None, None, "", "Mine", None, None, T0, "x")])
    kept = recategorize.recategorize_preserving(feedback, states, default_taxonomy(), F.lit(T0))
    rows = {r["feedback_id"]: r for r in kept.collect()}
    assert set(rows) == {"b", "c"} and rows["b"]["category"] == "Mine" and rows["b"]["primary_domain"] == "Speed"
    assert recategorize.preserving_counters(kept).first().asDict() == {"updated": 2, "preserved": 1}
    assert recategorize.skip_counters(feedback).first().asDict() == {"recategorized": 2, "skipped_user_modified": 1, "total_processed": 3}


def items(spark):
    rows = [("a", "S1", "Developer", "high", None, None, "Positive", "X", "x1", "BUG", "Find ME", "2024-03-01"),
            ("b", "S2", "Customer", "low", "CLOSED", "", "Neutral", "Y", "y1", "BUG", None, "2024-01-01"),
            ("c", "S1", "Customer", "critical", "NEW", "Login", "Neutral", "me too", "y1", "QUESTION", "text", None),
            ("d", None, None, None, None, "None", None, None, None, None, "", "2024-02-01")]
    return spark.createDataFrame(rows, "feedback_id string, source string, audience string, priority string, state string, primary_domain string, "
                                       "sentiment string, enhanced_category string, subcategory string, impact_type string, feedback string, created string")


def ids(df):
    return [r["feedback_id"] for r in df.collect()]


def test_filters(spark):
    df, spec = items(spark), filters.FilterSpec
    assert ids(spec().apply(df)) == list("abcd")
    assert ids(spec(sources=("S1",), audiences=("Customer",)).apply(df)) == ["c"]
    assert ids(spec(states=("NEW",)).apply(df)) == ["a", "c", "d"]
    assert ids(spec(domains=("Uncategorized",)).apply(df)) == ["a", "b", "d"]
    assert ids(spec(domains=("Uncategorized", "Login")).apply(df)) == list("abcd")
    assert ids(spec(search="ME").apply(df)) == ["a", "c"]
    assert ids(spec(search="none").apply(df)) == []
    assert ids(spec(stored_only=True).apply(df, df.filter("feedback_id = 'b'"))) == ["b"]


def test_filter_parameters():
    parse = filters.FilterSpec.parse
    assert parse({"sources": " a, ,b ", "states": "All", "search": " q "}) == filters.FilterSpec(sources=("a", "b"), search="q")
    assert parse({}, {"sources": "x", "states": "All"}).sources == ("x",)
    assert parse({"states": "NEW"}, {"sources": "x"}).sources == ()
    assert parse({"domains": "A"}).applied() == {"domains": ("A",)}


def test_sort_and_pages(spark):
    df = items(spark)
    assert ids(filters.page(df, 1, 10)) == ["a", "d", "b", "c"]
    assert ids(filters.page(df, 1, 10, "oldest")) == ["b", "d", "a", "c"]
    assert ids(filters.page(df, 2, 2, "priority")) == ["b", "d"]
    assert filters.page_summary(df, 2, 2).first().asDict() == {"total_count": 4, "page": 2, "per_page": 2, "has_more": False}
    plan = filters.page(df, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_statistics(spark):
    df = items(spark).withColumns({"feature_area": F.lit("General"), "confidence": F.lit(None).cast("double"), "category": F.lit(""),
                                   "feedback_gist": F.lit("g")})
    counts = {(r["facet"], r["value"]): r["n"] for r in stats.facet_counts(df).collect()}
    assert counts[("primary_domain", "General")] == 2 and counts[("priority", "medium")] == 1 and counts[("source", "Unknown")] == 1
    assert {r["priority"]: r["percentage"] for r in stats.priority_distribution(df).collect()} == dict.fromkeys(["high", "low", "critical", "medium"], 25.0)
    assert [tuple(r) for r in stats.confidence_buckets(df).collect()] == [("low", 4)]
    top = {(r["list_name"], r["position"]): r["feedback_id"] for r in stats.top_requests(df).collect()}
    assert top == {("top_developer_requests", 1): "a", ("top_customer_requests", 1): "c", ("critical_issues", 1): "c"}
    options = {(r["facet"], r["value"]) for r in stats.facet_options(df).collect()}
    assert ("state", "IRRELEVANT") in options and ("state", "NEW") in options and not any(v in ("", None) for _, v in options)
    assert stats.subcategories_by_area(df).first()["subcategories"] == ["x1", "y1"]
    assert {r["source"]: r["n"] for r in stats.source_counts(df.na.fill("?", ["source"])).collect()} == {"S1": 2, "S2": 1, "?": 1, "TOTAL": 4}


def test_history_keeps_changes_without_time_or_id(spark):
    rows = [("a", "NEW", None, 1), ("a", "DONE", None, 2), (None, "NEW", "2024-01-01 00:00:00", 1), (None, "DONE", "2024-01-01 05:00:00", 2)]
    df = spark.createDataFrame(rows, "feedback_id string, state string, at string, ord int").select(
        "feedback_id", "state", F.col("at").cast("timestamp").alias("at"), "ord", F.lit("").alias("notes"), F.lit("u").alias("updated_by"))
    got = sorted((str(r.feedback_id), str(r.old_state), r.new_state) for r in state.state_history(df).collect())
    assert got == [("None", "NEW", "DONE"), ("None", "None", "NEW"), ("a", "NEW", "DONE"), ("a", "None", "NEW")]


def test_of_several_category_edits_the_last_counts(spark):
    edits = spark.createDataFrame([("i", "One", "s", "f", None, 1), ("i", "Two", "s", "f", "D", 2), (None, "x", "s", "f", None, 3)],
                                  "feedback_id string, category_name string, subcategory_name string, feature_area string, domain_code string, ord int")
    feedback = spark.createDataFrame([("i", *["old"] * 5, False)], "feedback_id string, category string, subcategory string, feature_area string, "
                                     "primary_domain string, enhanced_category string, user_modified boolean")
    states = spark.createDataFrame([("i", "NEW", "", *["old"] * 4, None, "u")], "feedback_id string, state string, notes string, category string, "
                                   "subcategory string, feature_area string, primary_domain string, last_updated timestamp, updated_by string")
    f, s = state.apply_category_edits(feedback, states, edits, F.lit(None).cast("timestamp"))
    assert [(r.category, r.primary_domain) for r in f.collect()] == [("Two", "D")] and [r.category for r in s.collect()] == ["Two"]
