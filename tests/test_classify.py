"""Classification: both keyword engines, ties and defaults."""

import json

import pytest

from bindings.base import feedback
from bindings.fixture import TAXONOMY
from vocspark.functions import classify as C
from vocspark.taxonomy import (
    Group, Taxonomy, TaxonomyError, clean_keywords, default_taxonomy, load_taxonomy, parse_categories, parse_groups)

DATA = "/root/testdata/sf0.001"


def test_both_engines_agree_on_documents(spark):
    one, two = (C.classify(feedback(spark, DATA), TAXONOMY, engine=engine).orderBy("doc_id").collect() for engine in ("jvm", "automaton"))
    assert one == two and len(one) == 200


def frame(spark, *texts, source="", scenario="", organization=""):
    return spark.createDataFrame([(t, source, scenario, organization) for t in texts],
                                 "feedback string, source string, scenario string, organization string")


def test_empty_text(spark):
    rows = C.classify(frame(spark, None, ""), default_taxonomy()).collect()
    for r in rows:
        assert (r["enhanced_category"], r["subcategory"], r["audience"], r["priority"], r["feature_area"], r["confidence"],
                r["impact_type"], r["domains"], r["primary_domain"]) == (
            "Other", "Uncategorized", "Unknown", "medium", "General", 0.0, "FEEDBACK", [], None)


def test_audience_bonus_alone_gives_a_category(spark):
    r = C.classify(frame(spark, "nothing relevant"), default_taxonomy()).first()
    assert (r["audience"], r["enhanced_category"], r["confidence"]) == ("Customer", "Using the product", 0.25)


def test_case_and_substring_matching(spark):
    r = frame(spark, "The DASHBOARDS are slowish").select(C.matched_keywords("feedback", ["Dashboard", "slow", "fast"])).first()
    assert r[0] == ["Dashboard", "slow"]


def test_ties_go_to_the_first_entry(spark):
    tax = Taxonomy(subcategories=(), impact_types=(Group("A", "A", ("x",)), Group("B", "B", ("y",))),
                   domains=(Group("P", "P", ("x", "z")), Group("Q", "Q", ("y", "w"))), legacy_categories=(), audiences={"Developer": ("x",), "ISV": ("y",)})
    r = frame(spark, "x y").select(C.impact_type("feedback", tax).alias("i"), C.domains("feedback", tax).alias("d"),
                                   C.audience("feedback", tax).alias("a")).first()
    assert (r["i"], [d["domain"] for d in r["d"]], r["a"]) == ("A", ["P", "Q"], "Developer")


def test_rules_of_the_collectors(spark):
    df = spark.createDataFrame([("Please improve this", ["X"]), ("it is broken", []), ("add this", ["Help Wanted"]), ("hello", None)],
                               "t string, l array<string>")
    got = [tuple(r) for r in df.select(C.post_impact("t"), C.issue_impact("t", "l"), C.task_impact("t")).collect()]
    assert got == [("Feature Request", "Feature Request", "Feature Request"), ("Feedback", "Bug", "Task"),
                   ("Feedback", "Question", "Task"), ("Feedback", "Feedback", "Task")]


def test_priority_helpers(spark):
    df = spark.createDataFrame([("Critical",), ("high",), (None,), ("odd",), ("low",)], "p string")
    got = [tuple(r) for r in df.select(C.priority_weight("p"), C.sla_days("p"), C.priority_rank("p")).collect()]
    assert got == [(4, 1, 0), (3, 7, 1), (2, 14, 3), (2, 14, 4), (1, 30, 3)]


def test_standard_audience(spark):
    df = spark.createDataFrame([("ISV",), ("Platform",), ("Developer",), ("Customer",), ("?",), (None,)], "a string")
    assert [r[0] for r in df.select(C.standard_audience("a")).collect()] == ["Developer"] * 3 + ["Customer"] * 3


def test_confidence_levels(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (0.4,), (0.39,), (None,)], "c double")
    assert [r[0] for r in df.select(C.confidence_level("c")).collect()] == ["high", "medium", "medium", "low", "low"]


def test_loading_and_validation(tmp_path):
    (tmp_path / "keywords.json").write_text('[" a ", "", "b"]')
    (tmp_path / "categories.json").write_text(json.dumps(
        {"C": {"name": "Cat", "audience": "All", "subcategories": {"S": {"name": "Sub", "keywords": ["k", " "]}}}}))
    (tmp_path / "impact_types.json").write_text("not json")
    (tmp_path / "domains.json").write_text("")
    (tmp_path / "audiences.json").write_text("[]")
    tax = load_taxonomy(str(tmp_path))
    base = default_taxonomy()
    assert tax.tracked_keywords == ("a", "b") and tax.subcategories[0].keywords == ("k",)
    assert tax.impact_types == base.impact_types and tax.domains == base.domains and tax.audiences == base.audiences
    assert load_taxonomy(str(tmp_path / "nowhere")) == base


@pytest.mark.parametrize("bad", [{"C": {"subcategories": {}}}, {"C": {"name": "x"}}, {"C": {"name": "x", "subcategories": []}},
                                 {"C": {"name": "x", "subcategories": {"S": {"keywords": []}}}}, {"C": 3}])
def test_bad_categories_are_refused(bad):
    with pytest.raises(TaxonomyError):
        parse_categories(bad)


def test_bad_groups_and_keywords_are_refused():
    for bad in ({"G": {"keywords": []}}, {"G": {"name": "x"}}, {"G": {"name": "x", "keywords": "k"}}, []):
        with pytest.raises(TaxonomyError):
            parse_groups(bad)
    with pytest.raises(TaxonomyError):
        clean_keywords([1], "x")
    with pytest.raises(TaxonomyError):
        Taxonomy((), (), (Group("G", "G", tuple(f"k{i}" for i in range(20_001))),), (), {})


def test_text_is_read_once_without_shuffle(spark):
    df = C.classify(frame(spark, "x"), default_taxonomy(), engine="jvm").select("category", "priority")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.lower().count("lower(coalesce(feedback") <= 1
