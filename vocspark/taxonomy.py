"""Taxonomies are data: small JSON files turned into frozen Python values and Spark literals.

Order is part of the value, because every tie in the classifier is won by the entry listed first.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# A taxonomy travels inside the query plan, so its size is bounded and checked.
MAX_PLAN_KEYWORDS = 20_000


class TaxonomyError(ValueError):
    """A taxonomy file or mapping breaks one of the layout rules."""


@dataclass(frozen=True)
class Group:
    """One keyword list with a name: a domain, an impact type, or a legacy category."""

    id: str
    name: str
    keywords: tuple[str, ...]
    color: str = ""


@dataclass(frozen=True)
class Subcategory:
    id: str
    name: str
    category: str
    audience: str
    priority: str
    feature_area: str
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class AudienceRules:
    """Point rules for the audience vote, besides the audience keyword lists; the terms are examples."""

    portal_terms: tuple[str, ...] = ("sandbox console", "api console")
    partner_terms: tuple[str, ...] = ("reseller", "white label", "our tenants")
    saas_terms: tuple[str, ...] = ("hosted service", "subscription product")
    vendor_orgs: tuple[str, ...] = ("vendor", "reseller")
    # Organizations and sources as the mappings of this package write them, in lower case.
    developer_orgs: tuple[str, ...] = ("github", "ado", "azure devops")
    developer_sources: tuple[str, ...] = (
        "github", "github discussions", "azure devops", "ado", "azure devops child tasks")
    customer_sources: tuple[str, ...] = ("reddit",)
    mixed_sources: tuple[str, ...] = ("community forum", "community forum search")
    developer_bonus_sources: tuple[str, ...] = ("github",)
    customer_bonus_sources: tuple[str, ...] = ("reddit", "community forum")


@dataclass(frozen=True)
class Taxonomy:
    subcategories: tuple[Subcategory, ...]
    impact_types: tuple[Group, ...]
    domains: tuple[Group, ...]
    legacy_categories: tuple[Group, ...]
    audiences: Mapping[str, tuple[str, ...]]
    tracked_keywords: tuple[str, ...] = ()
    default_category: str = "Other / Uncategorized"
    rules: AudienceRules = field(default_factory=AudienceRules)

    def __post_init__(self) -> None:
        total = sum(len(g.keywords) for g in (*self.subcategories, *self.impact_types,
                                               *self.domains, *self.legacy_categories))
        total += sum(map(len, self.audiences.values())) + len(self.tracked_keywords)
        if total > MAX_PLAN_KEYWORDS:
            raise TaxonomyError(f"{total} keywords exceed the bound of {MAX_PLAN_KEYWORDS}")

    def with_keywords(self, keywords: Sequence[str]) -> Taxonomy:
        return replace(self, tracked_keywords=clean_keywords(keywords, "tracked keywords"))


def clean_keywords(values: object, where: str) -> tuple[str, ...]:
    """Trim keywords and drop blanks; a blank keyword would be contained in every text."""
    if not isinstance(values, (list, tuple)):
        raise TaxonomyError(f"{where}: keywords must be a list")
    kept = []
    for value in values:
        if not isinstance(value, str):
            raise TaxonomyError(f"{where}: keyword {value!r} is not text")
        if value.strip():
            kept.append(value.strip())
    return tuple(kept)


def parse_categories(tree: Mapping) -> tuple[Subcategory, ...]:
    """Flatten ``{id: {name, audience, subcategories: {id: {name, keywords, …}}}}`` in order."""
    flat = []
    for cat_id, cat in _entries(tree, "categories"):
        if "name" not in cat or not isinstance(cat.get("subcategories"), Mapping):
            raise TaxonomyError(f"category {cat_id}: needs a name and a mapping of subcategories")
        for sub_id, sub in _entries(cat["subcategories"], cat_id):
            if "name" not in sub:
                raise TaxonomyError(f"subcategory {cat_id}.{sub_id}: needs a name")
            flat.append(Subcategory(
                id=sub_id, name=sub["name"], category=cat["name"], audience=cat.get("audience", "All"),
                priority=sub.get("priority", "medium"), feature_area=sub.get("feature_area", "General"),
                keywords=clean_keywords(sub.get("keywords"), f"{cat_id}.{sub_id}")))
    return tuple(flat)


def parse_groups(tree: Mapping, where: str = "groups") -> tuple[Group, ...]:
    """Flatten ``{id: {name, keywords, color?}}`` in order."""
    groups = []
    for gid, body in _entries(tree, where):
        if "name" not in body:
            raise TaxonomyError(f"{where} {gid}: needs a name")
        groups.append(Group(gid, body["name"], clean_keywords(body.get("keywords"), gid),
                            body.get("color", "")))
    return tuple(groups)


def _entries(tree: object, where: str):
    if not isinstance(tree, Mapping):
        raise TaxonomyError(f"{where}: must be a mapping")
    for key, body in tree.items():
        if not isinstance(body, Mapping):
            raise TaxonomyError(f"{where} {key}: must be a mapping")
        yield key, body


def read_json_or(path: str, kind: type, fallback):
    """Content of a small JSON settings file; missing, empty, malformed or mistyped → fallback."""
    if not os.path.exists(path):
        return fallback
    try:
        with open(path, encoding="utf-8") as handle:
            content = handle.read()
        value = json.loads(content) if content.strip() else None
    except (OSError, ValueError):
        return fallback
    return value if isinstance(value, kind) else fallback


def load_taxonomy(folder: str, base: Taxonomy | None = None) -> Taxonomy:
    """Overlay the JSON files found in ``folder`` on a base taxonomy.

    Files: ``categories.json``, ``impact_types.json``, ``domains.json``, ``legacy_categories.json``,
    ``audiences.json`` (mapping of lists), ``audience_rules.json`` and ``keywords.json`` (list).
    """
    base = base or default_taxonomy()

    def tree(name: str):
        return read_json_or(os.path.join(folder, name), dict, None)

    changes: dict = {}
    if (cats := tree("categories.json")) is not None:
        changes["subcategories"] = parse_categories(cats)
    for attr in ("impact_types", "domains", "legacy_categories"):
        if (groups := tree(f"{attr}.json")) is not None:
            changes[attr] = parse_groups(groups, attr)
    if (aud := tree("audiences.json")) is not None:
        changes["audiences"] = {k: clean_keywords(v, k) for k, v in aud.items()}
    if (rules := tree("audience_rules.json")) is not None:
        changes["rules"] = AudienceRules(**{k: clean_keywords(v, k) for k, v in rules.items()})
    keywords = read_json_or(os.path.join(folder, "keywords.json"), list, None)
    if keywords is not None:
        changes["tracked_keywords"] = clean_keywords(keywords, "keywords.json")
    return replace(base, **changes)


def default_taxonomy() -> Taxonomy:
    """The small taxonomy shipped next to this module; users bring their own files."""
    path = os.path.join(os.path.dirname(__file__), "default_taxonomy.json")
    with open(path, encoding="utf-8") as handle:
        tree = json.load(handle)
    return Taxonomy(
        subcategories=parse_categories(tree["categories"]),
        impact_types=parse_groups(tree["impact_types"]),
        domains=parse_groups(tree["domains"]),
        legacy_categories=parse_groups(tree["legacy_categories"]),
        audiences={k: clean_keywords(v, k) for k, v in tree["audiences"].items()},
        tracked_keywords=clean_keywords(tree["keywords"], "keywords"),
    )


def sql_literal(value) -> str:
    """A Python value (text, number, truth value, list, mapping as struct) as a SQL constant."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(sql_literal, value)) + ")"
    if isinstance(value, Mapping):
        return "named_struct(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in value.items()) + ")"
    return repr(value)


def constant(value) -> Column:
    """A constant column from one parsed expression; a call per element would dominate planning."""
    return F.expr(sql_literal(value))


def literal_strings(values: Sequence[str]) -> Column:
    """A constant array<string>; typed also when empty."""
    return F.expr(f"cast({sql_literal(list(values))} AS array<string>)")
