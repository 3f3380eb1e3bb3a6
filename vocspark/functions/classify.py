"""Keyword classification as single expressions: no join and no shuffle.

The keywords of a taxonomy are looked up once per text; what follows is arithmetic on the few hits.
Each taxonomy is a constant array of structs, and the first maximum wins by struct comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.common import col, contains_any, let, with_once
from vocspark.functions.keywords import KeywordIndex, among
from vocspark.schema import PRIORITIES
from vocspark.taxonomy import Group, Taxonomy, constant, literal_strings

# Ordered impact rules of the collectors, each with the words that trigger it.
POST_IMPACT_RULES = [
    ("Bug", ["error", "bug", "issue", "problem"]),
    ("Feature Request", ["suggest", "feature", "improve"]),
    ("Question", ["help", "how to", "question"]),
]
ISSUE_LABEL_RULES = [
    ("Bug", ["bug", "defect", "error"]),
    ("Feature Request", ["enhancement", "feature", "feature request"]),
    ("Question", ["question", "help wanted", "support"]),
]
ISSUE_IMPACT_RULES = [
    ("Bug", ["error", "bug", "issue", "problem", "broken", "crash"]),
    ("Feature Request", ["suggest", "feature", "improve", "enhancement", "add"]),
    ("Question", ["help", "how to", "question", "how do i"]),
]
TASK_IMPACT_RULES = [
    ("Bug", ["error", "bug", "issue", "problem", "defect"]),
    ("Development Task", ["task", "implement", "develop", "create", "build"]),
    ("Feature Request", ["suggest", "feature", "improve", "enhancement"]),
    ("Testing", ["test", "verify", "validate", "qa"]),
]
# Confidence levels and the answer for a record without text.
CONFIDENCE_LEVELS = [("high", 0.7), ("medium", 0.4)]
EMPTY_RESULT = dict(enhanced_category="Other", subcategory="Uncategorized", audience="Unknown",
                    priority="medium", feature_area="General", impact_type="FEEDBACK")


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def matched_keywords(text: Column | str, keywords: Sequence[str]) -> Column:
    """Tracked keywords contained in the text, in list order and original spelling."""
    lits = literal_strings(list(keywords))
    return let(F.lower(F.coalesce(col(text), F.lit(""))),
               lambda t: F.filter(lits, lambda k: F.contains(t, F.lower(k))))


def ordered_rule(lowered: Column, rules, default: str) -> Column:
    """Name of the first rule with a word contained in the lower-case text."""
    table = constant([{"name": name, "words": list(words)} for name, words in rules])
    hits = F.filter(table, lambda r: F.exists(r["words"], lambda w: F.contains(lowered, w)))
    return F.coalesce(F.get(hits, F.lit(0))["name"], F.lit(default))


def post_impact(text: Column | str) -> Column:
    return let(F.lower(F.coalesce(col(text), F.lit(""))), lambda t: ordered_rule(t, POST_IMPACT_RULES, "Feedback"))


def task_impact(text: Column | str) -> Column:
    return let(F.lower(F.coalesce(col(text), F.lit(""))), lambda t: ordered_rule(t, TASK_IMPACT_RULES, "Task"))


def issue_impact(text: Column | str, labels: Column | str) -> Column:
    """Labels decide first, the wider word lists only when no label does."""
    lowered = F.transform(F.coalesce(col(labels), literal_strings([])), F.lower)
    by_label = F.coalesce(*[F.when(F.arrays_overlap(lowered, literal_strings(names)), F.lit(name))
                            for name, names in ISSUE_LABEL_RULES])
    by_text = let(F.lower(F.coalesce(col(text), F.lit(""))), lambda t: ordered_rule(t, ISSUE_IMPACT_RULES, "Feedback"))
    return F.coalesce(by_label, by_text)


def _rule_numbers(table_of: Sequence[tuple[str, list[int]]], hits: Column, default: str) -> Column:
    """Name of the first row with one of its keyword numbers among the hits."""
    table = constant([{"name": name, "numbers": numbers} for name, numbers in table_of if numbers])
    found = F.filter(table, lambda r: F.arrays_overlap(r["numbers"], hits))
    return F.coalesce(F.get(found, F.lit(0))["name"], F.lit(default))


def _legacy(hits: Column, tax: Taxonomy, index: KeywordIndex) -> Column:
    return _rule_numbers([(g.name, index.numbers(g.keywords)) for g in tax.legacy_categories], hits, tax.default_category)


def _count(hits: Column, numbers: Column) -> Column:
    return F.size(F.array_intersect(numbers, hits))


def _impact(hits: Column, groups: Sequence[Group], index: KeywordIndex) -> Column:
    scored = F.transform(
        constant([{"rank": -i, "id": g.id, "numbers": _list(index, g)} for i, g in enumerate(groups)]),
        lambda g: F.struct(_count(hits, g["numbers"]).alias("hits"), g["rank"].alias("rank"), g["id"].alias("id")))
    return let(F.array_max(scored), lambda b: F.when(b["hits"] > 0, b["id"]).otherwise(F.lit("FEEDBACK")))


def _list(index: KeywordIndex, group) -> list[int]:
    """Keyword numbers of a group; −1, which is never hit, keeps an empty list typed."""
    return index.numbers(group.keywords) or [-1]


def _domains(hits: Column, groups: Sequence[Group], index: KeywordIndex) -> Column:
    table = constant([{
        "rank": i, "domain": g.name, "domain_id": g.id, "color": g.color, "size": len(g.keywords),
        "keywords": [{"n": n, "word": w} for n, w in zip(index.numbers(g.keywords), g.keywords, strict=True)]}
        for i, g in enumerate(groups) if g.keywords])
    scored = F.transform(table, lambda g: let(
        F.transform(F.filter(g["keywords"], lambda k: F.array_contains(hits, k["n"])), lambda k: k["word"]),
        lambda m: F.struct(
            (-F.round(F.least(F.size(m) / g["size"], F.lit(1.0)), 2)).alias("key"),
            g["rank"].alias("rank"), g["domain"].alias("domain"), g["domain_id"].alias("domain_id"),
            F.size(m).alias("score"), m.alias("matched_keywords"), g["color"].alias("color"))))
    found = F.array_sort(F.filter(scored, lambda d: d["score"] > 0))
    return F.transform(found, lambda d: F.struct(
        d["domain"].alias("domain"), d["domain_id"].alias("domain_id"), (-d["key"]).alias("confidence"),
        d["score"].alias("score"), d["matched_keywords"].alias("matched_keywords"), d["color"].alias("color")))


def _audience(x: Column, tax: Taxonomy, index: KeywordIndex) -> Column:
    """Vote over keyword hits, source, scenario and organization; Developer, Customer, ISV win ties in that order."""
    rules, hits, source, scenario, organization = tax.rules, x["hits"], x["source"], x["scenario"], x["organization"]

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    def mentions(words) -> Column:
        return among(hits, index.numbers(words)) > 0

    partner, partner_text = scenario == "partner", mentions(rules.partner_terms)
    vendor = contains_any(organization, rules.vendor_orgs)
    in_dev = source.isin(list(rules.developer_sources))
    in_cust = source.isin(list(rules.customer_sources)) & ~in_dev
    votes = {
        "Developer": points(mentions(rules.portal_terms), 5) + points(in_dev, 3)
        + points(partner & ~partner_text, 2) + points(scenario == "internal", 2)
        + points(~vendor & contains_any(organization, rules.developer_orgs), 2),
        "Customer": points(in_cust, 1)
        + points(source.isin(list(rules.mixed_sources)) & ~in_dev & ~in_cust, 0.5)
        + points(scenario == "customer", 2),
        "ISV": points(partner & partner_text, 3) + points(vendor, 2) + points(mentions(rules.saas_terms), 3),
    }
    ballots = F.array(*[F.struct(
        (among(hits, index.numbers(tax.audiences.get(name, ()))) + score).alias("score"),
        F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, score) in enumerate(votes.items())])
    return let(F.array_max(ballots), lambda b: F.when(b["score"] > 0, b["name"]).otherwise(F.lit("Customer")))


def _best_subcategory(v: Column, tax: Taxonomy, index: KeywordIndex) -> Column:
    rules, audience, source = tax.rules, v["audience"], v["source"]
    bonus = F.when((audience == "Developer") & source.isin(list(rules.developer_bonus_sources))
                   | (audience == "Customer") & source.isin(list(rules.customer_bonus_sources)), 1).otherwise(0)
    table = constant([{
        "rank": -i, "category": s.category, "subcategory": s.name, "audience": s.audience, "priority": s.priority,
        "feature_area": s.feature_area, "size": len(s.keywords), "numbers": _list(index, s)}
        for i, s in enumerate(tax.subcategories)])
    scored = F.transform(table, lambda s: let(_count(v["hits"], s["numbers"]), lambda h: F.struct(
        (h + F.when((s["audience"] == audience) | (s["audience"] == "All"), 2).otherwise(0) + bonus).alias("score"),
        s["rank"].alias("rank"), h.alias("hits"), s["size"].alias("size"), s["category"].alias("category"),
        s["subcategory"].alias("subcategory"), s["priority"].alias("priority"), s["feature_area"].alias("feature_area"))))
    return F.array_max(scored)


def _lower(c: Column | str) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def keyword_hits(text: Column | str, tax: Taxonomy, engine: str = "jvm") -> Column:
    """Numbers of all taxonomy keywords in the text: the only part that reads the text."""
    return KeywordIndex.of(tax).hits(_lower(text), engine)


def classification(text: Column | str, tax: Taxonomy, source="source", scenario="scenario",
                   organization="organization", hits: Column | None = None) -> Column:
    """Struct with the complete classification of one record.

    ``hits`` takes keyword numbers found before by :func:`keyword_hits`; all rules then work on
    those few numbers.
    """
    index = KeywordIndex.of(tax)
    ctx = F.struct((keyword_hits(text, tax) if hits is None else hits).alias("hits"), _lower(source).alias("source"),
                   _lower(scenario).alias("scenario"), _lower(organization).alias("organization"))

    def full(x: Column) -> Column:
        voted = F.struct(x["hits"].alias("hits"), x["source"].alias("source"), _audience(x, tax, index).alias("audience"))
        return let(voted, lambda v: let(F.struct(
            v["audience"].alias("audience"), _best_subcategory(v, tax, index).alias("best"),
            _domains(v["hits"], tax.domains, index).alias("domains"),
            _impact(v["hits"], tax.impact_types, index).alias("impact"),
            _legacy(v["hits"], tax, index).alias("legacy")), _assemble))

    none = F.lit(None).cast("string")
    empty = F.struct(
        F.lit(tax.default_category).alias("category"),
        *[F.lit(EMPTY_RESULT[k]).alias(k) for k in (
            "enhanced_category", "subcategory", "audience", "priority", "feature_area", "impact_type")],
        F.lit(0.0).alias("confidence"),
        F.array().cast("array<struct<domain:string,domain_id:string,confidence:double,score:int,"
                       "matched_keywords:array<string>,color:string>>").alias("domains"),
        none.alias("primary_domain"))
    return F.when(is_blank(col(text)), empty).otherwise(let(ctx, full))


def _assemble(r: Column) -> Column:
    best, hit = r["best"], r["best"]["score"] > 0
    share = F.least(best["hits"] / F.greatest(best["size"] * F.lit(0.2), F.lit(1.0)), F.lit(1.0))
    context = F.when(r["audience"] == "Unknown", F.lit(0.2)).otherwise(F.lit(0.5))
    return F.struct(
        r["legacy"].alias("category"),
        F.when(hit, best["category"]).otherwise(F.lit("Other")).alias("enhanced_category"),
        F.when(hit, best["subcategory"]).otherwise(F.lit("Uncategorized")).alias("subcategory"),
        r["audience"].alias("audience"),
        F.when(hit, best["priority"]).otherwise(F.lit("medium")).alias("priority"),
        F.when(hit, best["feature_area"]).otherwise(F.lit("General")).alias("feature_area"),
        r["impact"].alias("impact_type"),
        F.when(hit, F.round((share + context) / 2, 2)).otherwise(F.lit(0.0)).alias("confidence"),
        r["domains"].alias("domains"),
        F.get(r["domains"], F.lit(0))["domain"].alias("primary_domain"))


CLASSIFIED = ["category", "enhanced_category", "subcategory", "audience", "priority", "feature_area",
              "impact_type", "confidence", "domains", "primary_domain"]


def classify(df: DataFrame, tax: Taxonomy, text: Column | str = "feedback", source="source",
             scenario="scenario", organization="organization", engine: str = "jvm") -> DataFrame:
    """Add (or replace) the ten classification columns."""
    staged = df.withColumn("_hits", keyword_hits(text, tax, engine))
    staged = with_once(staged, "_class", classification(text, tax, source, scenario, organization, F.col("_hits")))
    return staged.withColumns({c: F.col(f"_class.{c}") for c in CLASSIFIED}).drop("_class", "_hits")


def legacy_category(text: Column | str, tax: Taxonomy) -> Column:
    index = KeywordIndex([w for g in tax.legacy_categories for w in g.keywords])
    return let(index.hits(_lower(text), "jvm"), lambda h: _legacy(h, tax, index))


def impact_type(text: Column | str, tax: Taxonomy) -> Column:
    index = KeywordIndex([w for g in tax.impact_types for w in g.keywords])
    return let(index.hits(_lower(text), "jvm"), lambda h: _impact(h, tax.impact_types, index))


def domains(text: Column | str, tax: Taxonomy) -> Column:
    """Domains with at least one keyword, by confidence and then taxonomy order."""
    index = KeywordIndex([w for g in tax.domains for w in g.keywords])
    return let(index.hits(_lower(text), "jvm"), lambda h: _domains(h, tax.domains, index))


def audience(text: Column | str, tax: Taxonomy, source="source", scenario="scenario",
             organization="organization") -> Column:
    index = KeywordIndex.of(tax)
    ctx = F.struct(index.hits(_lower(text), "jvm").alias("hits"), _lower(source).alias("source"),
                   _lower(scenario).alias("scenario"), _lower(organization).alias("organization"))
    return F.when(is_blank(col(text)), F.lit("Customer")).otherwise(let(ctx, lambda x: _audience(x, tax, index)))


def standard_audience(c: Column | str) -> Column:
    """Two audiences in stored rows: partners count as developers, everything else as customers."""
    c = col(c)
    return F.when(c.isin("Developer", "ISV", "Platform"), F.lit("Developer")).otherwise(F.lit("Customer"))


def _priority_lookup(c: Column | str, index: int) -> Column:
    table = F.create_map(*[F.lit(x) for p, v in PRIORITIES.items() for x in (p, v[index])])
    return F.coalesce(F.try_element_at(table, F.lower(col(c))), F.lit(PRIORITIES["medium"][index]))


def priority_weight(c: Column | str) -> Column:
    return _priority_lookup(c, 0)


def sla_days(c: Column | str) -> Column:
    return _priority_lookup(c, 1)


def priority_rank(c: Column | str) -> Column:
    """Sort rank: critical first, unknown last; a missing priority ranks like low."""
    lowered = F.lower(F.coalesce(col(c), F.lit("low")))
    names = literal_strings(["critical", "high", "medium", "low"])
    position = F.array_position(names, lowered)
    return F.when(position > 0, position - 1).otherwise(F.lit(4)).cast("int")


def confidence_level(c: Column | str) -> Column:
    value = F.coalesce(col(c), F.lit(0.0))
    return F.coalesce(*[F.when(value >= at, F.lit(name)) for name, at in CONFIDENCE_LEVELS], F.lit("low"))
