"""Tables written and read back, and the forms of filters, counters and blank values that other queries do not reach."""

from pyspark.sql import functions as F

from bindings import reports, text  # noqa: F401  (their SQL is used here)
from bindings.base import FEEDBACK_SQL, classification_sql, classified, classified_sql, feedback
from bindings.fixture import KEYWORDS, LEXICON, TAXONOMY
from bindings.registry import ORACLES, query, quoted, sql_list
from bindings.triage import STATES_SQL, STORED_SQL, _shown, _with_flags, states, stored
from vocspark.functions import classify as C
from vocspark.functions.sentiment import with_sentiment
from vocspark.operators import recategorize, state, stats
from vocspark.operators.filters import FilterSpec
from vocspark.session import scratch_path
from vocspark.sinks import tables
from vocspark.sources import snapshots


@query("snapshot_round_trip", f"WITH {FEEDBACK_SQL} SELECT feedback_id, nullif(title, '') AS title, nullif(feedback, '') AS feedback, nullif(organization, '') AS organization FROM fb")
def snapshot_round_trip(spark, folder):
    """Two CSV snapshots are written; the newer one is found and read with whole texts."""
    place, rows = scratch_path(spark, "snapshots"), feedback(spark, folder)
    tables.write_snapshot(rows.filter(F.col("doc_id") % 2 == 0), place, "20240101_0000")
    tables.write_snapshot(rows, place, "20240102_0000")
    return snapshots.load_latest_snapshot(spark, place).select("feedback_id", "title", "feedback", "organization")


@query("table_round_trip", f"""WITH {FEEDBACK_SQL}, kw AS (SELECT *, list_filter({sql_list(KEYWORDS)}, lambda k: contains(lower(feedback), lower(k))) AS m FROM fb)
SELECT feedback_id, source, regexp_replace(feedback, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS feedback, array_to_string(m, ',') AS matched FROM kw WHERE len(m) > 0""")
def table_round_trip(spark, folder):
    """A missing table reads as empty; two appends in partitions keep the rows with keywords, and the layout comes back."""
    place = scratch_path(spark, "table")
    empty = tables.read_or_empty(spark, place)
    rows = feedback(spark, folder).withColumn("matched_keywords", C.matched_keywords("feedback", KEYWORDS))
    for wave in (0, 1):
        tables.write_table(rows.filter(F.col("doc_id") % 2 == wave), place, only_with_keywords=True, partition_by=["source"])
    both = tables.read_or_empty(spark, place).unionByName(empty)
    return both.select("feedback_id", "source", "feedback", F.array_join("matched_keywords", ",").alias("matched"))


@query("filter_sentiment", f"SELECT 'f' || doc_id AS feedback_id, sentiment, sentiment_confidence FROM ({ORACLES['sentiment']}) WHERE sentiment IN ('Negative', 'Neutral')")
def filter_sentiment(spark, folder):
    rows = with_sentiment(feedback(spark, folder), "feedback", LEXICON)
    return FilterSpec.parse({"sentiments": "Negative, Neutral"}).apply(rows).select("feedback_id", "sentiment", "sentiment_confidence")


@query("facet_options_all", f"{ORACLES['facet_options']} UNION SELECT 'sentiment', sentiment FROM ({ORACLES['sentiment']})")
def facet_options_all(spark, folder):
    """The option lists of all facets, sentiment included."""
    rows = classified(spark, folder).withColumn("state", F.when(F.col("doc_id") % 3 == 0, "PARKED"))
    return stats.facet_options(with_sentiment(rows, "feedback", LEXICON))


@query("states_blank_ids", f"""WITH {STATES_SQL}, {STORED_SQL}, sb AS (SELECT * REPLACE (CASE WHEN length(feedback_id) % 2 = 0 THEN feedback_id ELSE '  ' END AS feedback_id) FROM st)
SELECT feedback_id, sb.state, sb.notes, coalesce(sb.primary_domain, fd.primary_domain) AS primary_domain, coalesce(sb.category, fd.category) AS category,
 coalesce(sb.subcategory, fd.subcategory) AS subcategory, coalesce(sb.feature_area, fd.feature_area) AS feature_area, strftime(sb.last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated,
 sb.updated_by FROM sb LEFT JOIN fd USING (feedback_id)""")
def states_blank_ids(spark, folder):
    """State rows whose identifier was lost stay when asked for, and meet no feedback."""
    kept = F.when(F.length("feedback_id") % 2 == 0, F.col("feedback_id")).otherwise("  ")
    rows = states(spark, folder).withColumn("feedback_id", kept)
    return _shown(state.states_with_fallback(rows, stored(spark, folder), keep_blank_ids=True))


@query("preserving_counters", f"SELECT count(*) AS updated, count(*) FILTER (WHERE overrides_kept) AS preserved FROM ({ORACLES['recategorize_preserving']})")
def preserving_counters(spark, folder):
    out = recategorize.recategorize_preserving(_with_flags(spark, folder), states(spark, folder), TAXONOMY, F.lit("2024-06-01").cast("timestamp"))
    return recategorize.preserving_counters(out)


BLANK = ["enhanced_category", "subcategory", "audience", "priority", "feature_area", "impact_type"]


@query("blank_text_classes", f"""WITH {FEEDBACK_SQL}, bl AS (SELECT * REPLACE (CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE feedback END AS feedback) FROM fb), {classification_sql('bl')}
SELECT doc_id, {', '.join(f"CASE WHEN doc_id % 4 < 2 THEN {quoted(C.EMPTY_RESULT[c])} ELSE {c} END AS {c}" for c in BLANK)},
 CASE WHEN doc_id % 4 < 2 THEN {quoted(TAXONOMY.default_category)} ELSE category END AS category, CASE WHEN doc_id % 4 < 2 THEN 0 ELSE confidence END AS confidence FROM cl""")
def blank_text_classes(spark, folder):
    """Half of the texts are lost, as empty or as null; the classes of the others stay."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "").when(k != 1, F.col("feedback"))
    return C.classify(feedback(spark, folder).withColumn("feedback", text), TAXONOMY).select("doc_id", *BLANK, "category", "confidence")
