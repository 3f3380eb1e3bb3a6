"""Greedy acceptance and clustering against their one-by-one statements."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import plain
from vocspark.functions.similarity import ProbeSet, score
from vocspark.operators import dedup, repeats, similarity

VOCABULARY = "login button broken dark mode slow report export chart please add crash when open the a page".split()


def sentences(rng, n):
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return texts + rng.sample(texts, n // 6) + [t.upper() + "!" for t in rng.sample(texts, 3)] + ["", None, "?!"]


@pytest.mark.parametrize("seed", range(8))
def test_first_accepted_equals_sequential_rule(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(2, 80)
    rows = [(k, f"i{rng.randint(0, n // 2)}", f"s{rng.randint(0, n // 2)}") for k in range(n)]
    df = spark.createDataFrame(rng.sample(rows, n), "ord long, id string, sig string")
    pairs = df.groupBy("id", "sig").agg(F.min("ord").alias("ord"))
    assert sorted(r["ord"] for r in dedup.first_accepted(pairs).collect()) == plain.accept_in_order(rows)


def test_first_accepted_on_one_hot_key(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"i{k}", f"s{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "ord long, id string, sig string")
    assert dedup.first_accepted(df).count() == 401


def batch(spark, rows):
    return spark.createDataFrame(rows, "n long, feedback_id string, title string, content string, matched_keywords array<string>")


def test_insert_is_idempotent_and_counts(spark):
    rows = [(0, "a", "T", "one", ["k"]), (1, "a", "T", "one", []), (2, "b", " t ", "ONE ", []), (3, "c", "T", "three", []), (4, "d", None, None, None)]
    df = batch(spark, rows)
    empty = df.limit(0)
    keys = dedup.insert_keys(df, empty, "n")
    new = dedup.rows_to_insert(df, empty, "n")
    assert sorted(r["n"] for r in new.collect()) == [0, 3, 4]
    counters = dedup.insert_counters(df.withColumn("old", F.when(F.col("n") == 0, "a")), keys, "old").first().asDict()
    assert counters == {"new_items": 3, "existing_items": 2, "total_items": 5, "id_regenerated": 4}
    assert dedup.rows_to_insert(df, new, "n").count() == 0


def test_backfill_takes_first_filled_list_and_keeps_existing(spark):
    stored = batch(spark, [(0, "a", "", "", None), (1, "b", "", "", []), (2, "c", "", "", ["old"]), (3, "d", "", "", None)])
    fresh = batch(spark, [(0, "a", "", "", []), (1, "a", "", "", ["x"]), (2, "a", "", "", ["y"]), (3, "b", "", "", ["z"]), (4, "c", "", "", ["w"])])
    got = {r["feedback_id"]: r["matched_keywords"] for r in dedup.backfill_keywords(stored, fresh, "n").collect()}
    assert got == {"a": ["x"], "b": ["z"], "c": ["old"], "d": None}


def test_latest_per_title(spark):
    rows = [(0, "t", "2024-01-01"), (1, "t", "2024-02-01T00:00:00Z"), (2, "t", "2024-02-01"), (3, "t", "soon"), (4, "u", "soon"), (5, "u", None)]
    df = spark.createDataFrame(rows, "n long, title string, created string")
    assert {r["title"]: r["n"] for r in dedup.latest_per_title(df, "n").collect()} == {"t": 1, "u": 4}


def test_rank_filters_run_below_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("feedback_id"), (F.col("id") % 2).cast("string").alias("source"), F.col("id").cast("string").alias("created"))
    text = dedup.limit_per_source(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_large_limits_split_a_source_first(spark, monkeypatch):
    monkeypatch.setattr(dedup, "GROUP_LIMIT", 3)
    df = spark.range(500).select(F.col("id").alias("feedback_id"), (F.col("id") % 3 == 0).cast("string").alias("source"),
                                 (F.col("id") % 50).cast("string").alias("created"))
    got = {(r["source"], r["feedback_id"]) for r in dedup.limit_per_source(df, 7).collect()}
    want = set()
    for flag in ("true", "false"):
        rows = [i for i in range(500) if (i % 3 == 0) == (flag == "true")]
        rows.sort(key=lambda i: i)
        rows.sort(key=lambda i: str(i % 50), reverse=True)
        want |= {(flag, i) for i in rows[:7]}
    assert got == want


def expected(texts, threshold, autojunk=False):
    rows = [(f"i{n:03d}", t) for n, t in enumerate(texts)]
    return plain.repeats(rows, threshold, lambda a, b: score(a, b, autojunk)), len(rows)


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.8])
def test_clusters_equal_sequential_loop(spark, threshold, monkeypatch):
    monkeypatch.setattr(repeats, "FIRST_BATCH_ROWS", 3)
    monkeypatch.setattr(repeats, "BATCH_ROWS", 9)
    texts = sentences(random.Random(5), 50)
    df = spark.createDataFrame([(f"i{n:03d}", n, t, f"src{n % 3}") for n, t in enumerate(texts)],
                               "feedback_id string, n int, feedback string, source string")
    (clusters, clustered), total = expected(texts, threshold)
    result = repeats.analyze_repeats(df, F.col("n"), threshold=threshold)
    rows = result.summary().orderBy("ord").collect()
    assert [(r["leader_id"], r["count"]) for r in rows] == [(k, c) for k, c, _ in clusters]
    for r, (key, _, members) in zip(rows, clusters, strict=True):
        assert r["sources"] == sorted({f"src{int(m[1:]) % 3}" for m in [key, *members]})
    assert result.metrics().first().asDict() == {
        "total_items": total, "unique_requests": total - clustered, "cluster_count": len(clusters),
        "repetition_rate": round(clustered / total * 100, 1)}
    assert [r["count"] for r in result.top().collect()] == sorted((c for _, c, _ in clusters), reverse=True)[:10]


def test_clusters_with_the_library_heuristic(spark, monkeypatch):
    """Texts of 200 characters and more, among them copies that do not even resemble themselves."""
    monkeypatch.setattr(repeats, "FIRST_BATCH_ROWS", 2)
    rng = random.Random(11)
    long = [" ".join(rng.choice(VOCABULARY) for _ in range(60)) for _ in range(6)]
    texts = long + [long[0], long[0], long[1]] + sentences(rng, 12)
    df = spark.createDataFrame([(f"i{n:03d}", n, t) for n, t in enumerate(texts)], "feedback_id string, n int, feedback string")
    (clusters, clustered), total = expected(texts, 0.4, autojunk=True)
    result = repeats.analyze_repeats(df, F.col("n"), autojunk=True)
    assert [(r["leader_id"], r["count"]) for r in result.summary().orderBy("ord").collect()] == [(k, c) for k, c, _ in clusters]
    assert result.metrics().first()["unique_requests"] == total - clustered


def test_a_third_of_all_items_are_copies(spark):
    rows = [(f"i{n:04d}", n, "export the chart to a file" if n % 3 == 0 else f"{n * 7919} qq{n}") for n in range(300)]
    df = spark.createDataFrame(rows, "feedback_id string, n int, feedback string")
    result = repeats.analyze_repeats(df, F.col("n"), threshold=0.95)
    assert result.nodes.count() == 201
    top = result.top().first()
    assert (top["leader_id"], top["count"]) == ("i0000", 100)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab c", min_size=1, max_size=12), min_size=1, max_size=6), st.text(alphabet="abd ", min_size=1, max_size=12),
       st.sampled_from([0.3, 0.4, 0.7, 0.9]))
def test_bounds_lose_no_pair(probes, text, threshold):
    probes = [" ".join(p.split()) or "a" for p in probes]
    text = " ".join(text.split()) or "b"
    want = [(i, v) for i, v in ((i, score(p, text)) for i, p in enumerate(probes)) if v >= threshold]
    got = ProbeSet(probes, threshold).matches(text)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want, strict=True))


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abcdé ", min_size=1, max_size=40), min_size=1, max_size=5),
       st.lists(st.text(alphabet="abcdfé ", min_size=1, max_size=40), min_size=1, max_size=12), st.sampled_from([0.0, 0.4, 0.7]))
def test_many_texts_score_as_one_by_one(probes, texts, threshold):
    got = ProbeSet(probes, threshold).matches_of(texts)
    assert got == [[(i, v) for i, v in ((i, score(p, t)) for i, p in enumerate(probes)) if v >= threshold] for t in texts]


def test_long_and_short_texts_score_as_one_by_one():
    """Windows of every size, texts beyond the byte-sized tables, more characters than are counted apart, and the heuristic."""
    rng = random.Random(2)
    wide = [chr(0x4E00 + k) for k in range(150)]
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(n)) for n in (1, 4, 9, 20, 36, 37, 45, 60, 90)]
    texts += ["".join(rng.choice(wide) for _ in range(n)) for n in (40, 120, 255, 256)] + [texts[3], "\U0001F600 a \ud800"]
    for autojunk in (False, True):
        got = ProbeSet(texts, 0.2, autojunk).matches_of(texts)
        for text, found in zip(texts, got, strict=True):
            assert found == [(i, v) for i, v in ((i, score(p, text, autojunk)) for i, p in enumerate(texts)) if v >= 0.2]
    before = ProbeSet(texts, 0.2).matches_of(texts, list(range(len(texts))))
    assert all(i < k for k, found in enumerate(before) for i, _ in found)


def test_candidates_are_scored_together(monkeypatch):
    """The standard library's matcher is left to long texts: short ones never reach it."""
    monkeypatch.setattr("vocspark.functions.similarity.SequenceMatcher", None)
    texts = [t for t in sentences(random.Random(4), 60) if t]
    assert sum(map(len, ProbeSet(texts[:20], 0.4).matches_of(texts))) > 20


def test_find_similar(spark):
    texts = sentences(random.Random(3), 40)
    df = spark.createDataFrame([(f"i{n:03d}", t) for n, t in enumerate(texts)], "feedback_id string, feedback string")
    probe = texts[4]
    for threshold in (0.4, 0.7):
        got = {r["feedback_id"]: r["similarity"] for r in similarity.find_similar(df, probe, threshold).collect()}
        want = {f"i{n:03d}": score(plain.compare_form(probe), plain.compare_form(t)) for n, t in enumerate(texts) if t and t != probe}
        assert got.keys() == {k for k, v in want.items() if v >= threshold}
        assert all(abs(got[k] - want[k]) <= 0.0005001 for k in got)
    assert similarity.find_similar(df, "!!!").count() == 0
    kept = similarity.find_similar(df, probe, 0.99, exclude_self=False)
    assert "i004" in {r["feedback_id"] for r in kept.collect()}


def test_gist_stands_in_for_missing_feedback(spark):
    df = spark.createDataFrame([("a", None, "open the report page"), ("b", "", "x" * 200)], "feedback_id string, feedback string, feedback_gist string")
    got = similarity.find_similar(df, "open the report pages").first()
    assert got["feedback_id"] == "a" and got["preview"] == "open the report page"
