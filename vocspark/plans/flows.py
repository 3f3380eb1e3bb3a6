"""The user-level flows: enrich collected records, answer a view request, sync with stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.classify import classify, standard_audience
from vocspark.functions.common import blank_to_null
from vocspark.functions.dates import iso_timestamp
from vocspark.functions.gist import GistProfile, gist
from vocspark.functions.ids import feedback_id_from_record
from vocspark.functions.sentiment import DEFAULT_LEXICON, Lexicon, with_sentiment
from vocspark.operators.dedup import backfill_keywords, insert_counters, insert_keys, limit_per_source
from vocspark.operators.filters import FilterSpec, page, page_summary
from vocspark.operators.search_index import SearchIndex
from vocspark.operators.state import initial_states, overlay_states, sync_domains
from vocspark.operators.stats import facet_options
from vocspark.schema import FEEDBACK_SCHEMA
from vocspark.session import cut_lineage
from vocspark.sinks.tables import add_missing_columns
from vocspark.sources.records import union_sources
from vocspark.taxonomy import Taxonomy


def enrich(records: DataFrame, tax: Taxonomy, now: Column, lexicon: Lexicon = DEFAULT_LEXICON,
           profile: GistProfile | None = None) -> DataFrame:
    """Collected records → complete feedback rows, in one narrow stage.

    An impact type set by the source stays, because sources know labels the text does not show.
    Sources whose title is no opinion name the text to judge in ``sentiment_text``.  Without ``profile`` the domains are the topics of the gist.
    """
    had_impact = "impact_type" in records.columns
    rows = records.withColumnRenamed("impact_type", "_impact") if had_impact else records
    rows = classify(rows, tax)
    if had_impact:
        rows = rows.withColumn("impact_type", F.coalesce("_impact", "impact_type")).drop("_impact")
    judged = F.coalesce("sentiment_text", "feedback") if "sentiment_text" in rows.columns else F.col("feedback")
    rows = with_sentiment(rows, judged, lexicon).drop("sentiment_text")
    rows = rows.withColumn("feedback_gist", gist("feedback", profile or GistProfile.of_taxonomy(tax)))
    rows = add_missing_columns(rows, FEEDBACK_SCHEMA)
    content = "content" if "content" in rows.columns else "feedback"
    rows = rows.withColumns({
        "feedback_id": feedback_id_from_record(content=content),
        "created_ts": iso_timestamp("created"),
        "primary_category": F.coalesce("primary_category", "category")})
    return initial_states(rows, now)


@dataclass(frozen=True)
class ViewResult:
    """A page of rows, its one-row summary, and the option lists of the unfiltered table."""

    rows: DataFrame
    summary: DataFrame
    facets: DataFrame
    filters: dict


def filtered_view(feedback: DataFrame, spec: FilterSpec, number: int = 1, per_page: int = 50,
                  sort_by: str = "newest", stored_ids: DataFrame | None = None, index: SearchIndex | None = None) -> ViewResult:
    """Filter, sort and page; the three results are separate lazy plans over one table.

    ``index`` is a search index of the rows of ``feedback``; with it a search text reads the blocks of its hits only.
    """
    hits = spec.apply(index.search(spec.search) if index is not None and spec.search else feedback, stored_ids)
    return ViewResult(page(hits, number, per_page, sort_by), page_summary(hits, number, per_page),
                      facet_options(feedback), spec.applied())


@dataclass(frozen=True)
class SyncResult:
    """Rows to append, the stored rows after back-fill and domain sync, the view, and the counters."""

    new_rows: DataFrame
    stored_after: DataFrame
    current: DataFrame
    counters: DataFrame


def stored_form(df: DataFrame) -> DataFrame:
    """Collected rows as they are stored: filled whole title, standard audience."""
    title = F.coalesce(blank_to_null("title"), blank_to_null("feedback_gist"), blank_to_null("feedback"), F.lit(""))
    return df.withColumns({"title": title, "audience": standard_audience("audience")})


def collect(*frames: DataFrame, limit: int | None = None) -> DataFrame:
    """All sources under one set of columns, optionally the newest ``limit`` rows of each."""
    rows = union_sources(*frames)
    return rows if limit is None else limit_per_source(rows, limit, key="url")


def sync(batch: DataFrame, stored: DataFrame, states: DataFrame, order_col: str,
         original_id: str | None = None, materialize: bool = True) -> SyncResult:
    """Add what is new, back-fill keywords, carry human decisions over.

    The batch is read several times.  ``materialize`` keeps the enrichment behind it from running
    each time; switch it off for a batch that already is a table.
    """
    rows = stored_form(batch)
    rows = cut_lineage(rows) if materialize else rows
    keys = insert_keys(rows, stored, order_col, content="feedback")
    new_rows = rows.join(keys.select(F.col("ord").alias(order_col)), order_col, "left_semi")
    filled = backfill_keywords(stored, rows, order_col)
    both = filled.unionByName(new_rows.drop(order_col), allowMissingColumns=True)
    after = sync_domains(both, states)
    return SyncResult(new_rows, after, overlay_states(after, states),
                      insert_counters(rows, keys, original_id))
