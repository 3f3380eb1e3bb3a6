"""Facet filters, free-text search, sort orders and paging."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.classify import priority_rank
from vocspark.schema import DEFAULT_STATE

UNCATEGORIZED = "Uncategorized"
PAGE_SIZE = 50

# facet of the spec → column of the feedback table
FACET_COLUMNS = {
    "sources": "source", "audiences": "audience", "priorities": "priority", "states": "state",
    "domains": "primary_domain", "sentiments": "sentiment", "enhanced_categories": "enhanced_category",
    "subcategories": "subcategory", "impact_types": "impact_type", "categories": "category",
}
SEARCH_COLUMNS = ("feedback", "title", "enhanced_category")


def parse_list(value: str | None) -> tuple[str, ...]:
    """'All' and blank mean no filter; otherwise a comma list, trimmed, without blanks."""
    if not value or value.strip() in ("", "All"):
        return ()
    return tuple(part.strip() for part in value.split(",") if part.strip())


@dataclass(frozen=True)
class FilterSpec:
    """Values wanted per facet (empty = any), a search text, and the stored-only switch."""

    sources: tuple[str, ...] = ()
    audiences: tuple[str, ...] = ()
    priorities: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    sentiments: tuple[str, ...] = ()
    enhanced_categories: tuple[str, ...] = ()
    subcategories: tuple[str, ...] = ()
    impact_types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    search: str = ""
    stored_only: bool = False

    @classmethod
    def parse(cls, params: Mapping[str, str], single: Mapping[str, str] | None = None) -> FilterSpec:
        """Multi-select parameters; the single-select form counts only when no facet is selected."""
        facets = {name: parse_list(params.get(name)) for name in FACET_COLUMNS}
        if single and not any(facets.values()):
            facets = {name: tuple(v for v in [(single.get(name) or "").strip()] if v not in ("", "All"))
                      for name in FACET_COLUMNS}
        return cls(search=(params.get("search") or "").strip(),
                   stored_only=str(params.get("stored_only", "")).lower() == "true", **facets)

    def applied(self) -> dict:
        """The filters that restrict anything, for display next to the result."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name)}

    def predicate(self, columns) -> Column:
        parts = []
        for name, column in FACET_COLUMNS.items():
            wanted = list(getattr(self, name))
            if not wanted:
                continue
            if name == "domains":
                parts.append(domain_filter(F.col(column), wanted))
            elif name == "states":
                parts.append(F.coalesce(F.col(column), F.lit(DEFAULT_STATE)).isin(wanted))
            else:
                parts.append(F.col(column).isin(wanted))
        if self.search:
            parts.append(search(self.search, [c for c in SEARCH_COLUMNS if c in columns]))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, df: DataFrame, stored_ids: DataFrame | None = None) -> DataFrame:
        out = df.filter(self.predicate(df.columns))
        if self.stored_only:
            if stored_ids is None:
                raise ValueError("stored_only needs the stored identifiers")
            out = out.join(stored_ids.select("feedback_id"), "feedback_id", "left_semi")
        return out


def domain_filter(column: Column, wanted: list[str]) -> Column:
    """'Uncategorized' stands for rows without a domain and joins the other wanted domains."""
    if UNCATEGORIZED not in wanted:
        return column.isin(wanted)
    others = [w for w in wanted if w != UNCATEGORIZED]
    return column.isNull() | column.isin([*others, "", "None"])


def search(text: str, columns) -> Column:
    """Case-insensitive substring in any of the columns; null never matches."""
    tests = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def uncurated(column: str = "user_modified") -> Column:
    return ~F.coalesce(F.col(column), F.lit(False))


def keyword_gate(df: DataFrame, column: str = "matched_keywords") -> DataFrame:
    """Rows with at least one matched keyword."""
    return df.filter(F.coalesce(F.size(column), F.lit(0)) > 0)


def sort_keys(sort_by: str, created: str = "created", key: str = "feedback_id") -> list[Column]:
    """Sort columns, always ending in the key so pages never overlap."""
    orders = {
        "newest": [F.col(created).desc_nulls_last()],
        "oldest": [F.col(created).asc_nulls_last()],
        "priority": [priority_rank("priority").asc()],
    }
    return [*orders[sort_by], F.col(key).asc()]


def page(df: DataFrame, number: int, per_page: int = PAGE_SIZE, sort_by: str = "newest",
         created: str = "created", key: str = "feedback_id") -> DataFrame:
    """One page; planned as a bounded top-k per task, not as a sort of the whole table."""
    return df.orderBy(*sort_keys(sort_by, created, key)).offset((number - 1) * per_page).limit(per_page)


def page_summary(df: DataFrame, number: int, per_page: int = PAGE_SIZE) -> DataFrame:
    """One row: total_count, page, per_page, has_more."""
    return df.agg(F.count(F.lit(1)).alias("total_count")).select(
        "total_count", F.lit(number).cast("long").alias("page"), F.lit(per_page).cast("long").alias("per_page"),
        (F.col("total_count") > number * per_page).alias("has_more"))
