"""Statistics, option lists, filters, sort orders and pages."""

from pyspark.sql import functions as F

from bindings.base import FEEDBACK_SQL, classified, classified_sql, feedback
from bindings.fixture import TAXONOMY
from bindings.registry import query, quoted
from vocspark.functions.text import STOP_WORDS
from vocspark.operators import filters, stats
from vocspark.schema import PRIORITIES, STATES
from vocspark.sources.tables import read_table

RANK_SQL = "CASE lower(priority) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
WEIGHT_SQL = "CASE lower(priority) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END"


def _facets_sql(names):
    parts = [f"SELECT '{n}' AS facet, coalesce(nullif({n}, ''), '{stats.FACET_DEFAULTS[n]}') AS value FROM v" for n in names]
    return f"SELECT facet, value, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query("facet_counts", classified_sql(_facets_sql(stats.FACET_DEFAULTS)))
def facet_counts(spark, folder):
    return stats.facet_counts(classified(spark, folder))


@query("trend_counts", classified_sql(_facets_sql(stats.TREND_FACETS)))
def trend_counts(spark, folder):
    return stats.trend_counts(classified(spark, folder))


@query("audience_category_matrix", classified_sql("SELECT audience, enhanced_category, count(*) AS n FROM v GROUP BY ALL"))
def audience_category_matrix(spark, folder):
    return stats.cross_counts(classified(spark, folder), "audience", "enhanced_category")


@query("domain_audience_matrix", classified_sql(
    "SELECT coalesce(primary_domain, 'General') AS primary_domain, audience, count(*) AS n FROM v GROUP BY ALL"))
def domain_audience_matrix(spark, folder):
    return stats.cross_counts(classified(spark, folder), "primary_domain", "audience")


ORDER_PRIORITY_SQL = """o AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low'
 WHEN '3-MEDIUM' THEN 'medium' END AS priority FROM orders)"""


def _orders(spark, folder):
    """``orders`` as tickets with a priority, a state and a date."""
    o = read_table(spark, folder, "orders")
    p = F.col("o_orderpriority")
    return o.withColumns({
        "priority": F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "5-LOW", "low").when(p == "3-MEDIUM", "medium"),
        "state": F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "NEW"),
        "created_ts": F.col("o_orderdate"), "feedback_id": F.col("o_orderkey")})


@query("priority_distribution", f"""WITH {ORDER_PRIORITY_SQL}
SELECT coalesce(priority, 'medium') AS priority, count(*) AS n, CAST(round(CAST(count(*) * 100 / sum(count(*)) OVER () AS DECIMAL(18, 10)), 1) AS DOUBLE) AS percentage
FROM o GROUP BY 1""")
def priority_distribution(spark, folder):
    return stats.priority_distribution(_orders(spark, folder))


@query("confidence_buckets", classified_sql(
    "SELECT CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM v GROUP BY 1"))
def confidence_buckets(spark, folder):
    return stats.confidence_buckets(classified(spark, folder))


@query("top_requests", classified_sql(f""", l AS (
 SELECT 'top_developer_requests' AS list_name, * FROM v WHERE audience = 'Developer' AND priority IN ('high', 'critical') UNION ALL
 SELECT 'top_customer_requests', * FROM v WHERE audience = 'Customer' AND priority IN ('high', 'critical') UNION ALL
 SELECT 'critical_issues', * FROM v WHERE priority = 'critical')
SELECT list_name, row_number() OVER (PARTITION BY list_name ORDER BY {WEIGHT_SQL} DESC, created, feedback_id) AS position, feedback_id,
 title AS feedback_gist, audience, subcategory, priority FROM l QUALIFY position <= 10"""))
def top_requests(spark, folder):
    return (stats.top_requests(classified(spark, folder).withColumn("feedback_gist", F.col("title")))
            .withColumn("position", F.col("position").cast("long")))


@query("facet_options", classified_sql(f"""SELECT DISTINCT facet, value FROM (
 SELECT unnest(['source', 'category', 'enhanced_category', 'subcategory', 'impact_type', 'audience', 'primary_domain']) AS facet,
  unnest([source, category, enhanced_category, subcategory, impact_type, audience, primary_domain]) AS value FROM v
 UNION ALL SELECT 'state', unnest({list(STATES)}) UNION ALL SELECT 'priority', unnest({list(PRIORITIES)})
 UNION ALL SELECT 'state', CASE WHEN doc_id % 3 = 0 THEN 'PARKED' ELSE 'NEW' END FROM v) WHERE value <> ''"""))
def facet_options(spark, folder):
    rows = classified(spark, folder).withColumn("state", F.when(F.col("doc_id") % 3 == 0, "PARKED"))
    return stats.facet_options(rows, [f for f in stats.OPTION_FACETS if f != "sentiment"])


@query("subcategories_by_area", classified_sql(
    "SELECT feature_area, string_agg(DISTINCT subcategory, ',' ORDER BY subcategory) AS subcategories FROM v GROUP BY 1"))
def subcategories_by_area(spark, folder):
    return (stats.subcategories_by_area(classified(spark, folder))
            .withColumn("subcategories", F.array_join("subcategories", ",")))


@query("domain_counts", classified_sql("SELECT coalesce(primary_domain, 'General') AS primary_domain, count(*) AS n FROM v GROUP BY 1"))
def domain_counts(spark, folder):
    return stats.domain_counts(classified(spark, folder))


@query("top_keywords", f"""WITH w AS (SELECT unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 AND NOT list_contains({list(STOP_WORDS)}, word) GROUP BY 1 ORDER BY n DESC, word LIMIT 20""")
def top_keywords(spark, folder):
    return stats.top_keywords(feedback(spark, folder))


@query("source_counts", f"WITH {FEEDBACK_SQL} SELECT coalesce(source, 'TOTAL') AS source, count(*) AS n FROM fb GROUP BY ROLLUP (source)")
def source_counts(spark, folder):
    return stats.source_counts(feedback(spark, folder).select("source"))


SPEC = filters.FilterSpec.parse({"sources": "Reddit, Community Forum,GitHub", "priorities": "high,critical,medium",
                                 "audiences": "Customer,ISV", "enhanced_categories": "All"})
FILTER_SQL = """source IN ('Reddit', 'Community Forum', 'GitHub') AND priority IN ('high', 'critical', 'medium')
 AND audience IN ('Customer', 'ISV')"""
PAGE = ["feedback_id", "source", "audience", "priority", "created"]


@query("filtered_page", classified_sql(
    f"SELECT {', '.join(PAGE)} FROM v WHERE {FILTER_SQL} ORDER BY created DESC, feedback_id LIMIT 50 OFFSET 50"))
def filtered_page(spark, folder):
    return filters.page(SPEC.apply(classified(spark, folder)).select(*PAGE), 2)


@query("filtered_page_summary", classified_sql(
    f"SELECT count(*) AS total_count, CAST(2 AS BIGINT) AS page, CAST(50 AS BIGINT) AS per_page, count(*) > 100 AS has_more FROM v WHERE {FILTER_SQL}"))
def filtered_page_summary(spark, folder):
    return filters.page_summary(SPEC.apply(classified(spark, folder)), 2)


@query("search_page", classified_sql("""SELECT feedback_id, enhanced_category, created FROM v
 WHERE contains(lower(feedback), 'thort') OR contains(lower(enhanced_category), 'thort') ORDER BY created, feedback_id LIMIT 50"""))
def search_page(spark, folder):
    hits = filters.FilterSpec(search="THORT").apply(classified(spark, folder))
    return filters.page(hits.select("feedback_id", "enhanced_category", "created"), 1, sort_by="oldest")


@query("uncategorized_filter", classified_sql(
    "SELECT feedback_id, primary_domain FROM v WHERE primary_domain IS NULL OR primary_domain IN ('', 'None', 'Rules')"))
def uncategorized_filter(spark, folder):
    spec = filters.FilterSpec(domains=("Uncategorized", "Rules"))
    return spec.apply(classified(spark, folder)).select("feedback_id", "primary_domain")


@query("sort_priority", f"""WITH {ORDER_PRIORITY_SQL} SELECT o_orderkey AS feedback_id, priority FROM o
 ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, o_orderkey LIMIT 50 OFFSET 100""")
def sort_priority(spark, folder):
    return filters.page(_orders(spark, folder), 3, sort_by="priority").select("feedback_id", "priority")


@query("state_default_filter", """SELECT o_orderkey AS feedback_id FROM orders WHERE o_orderstatus <> 'F'""")
def state_default_filter(spark, folder):
    return filters.FilterSpec(states=("NEW",)).apply(_orders(spark, folder)).select("feedback_id")


@query("sla_due", f"""WITH {ORDER_PRIORITY_SQL}, d AS (SELECT *, CAST(o_orderdate AS DATE) + CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 7
  WHEN 'low' THEN 30 ELSE 14 END AS due FROM o)
SELECT coalesce(priority, 'none') AS priority, count(*) FILTER (WHERE o_orderstatus <> 'F' AND due < DATE '1998-01-01') AS overdue, CAST(max(due) AS VARCHAR) AS last_due FROM d GROUP BY 1""")
def sla_due(spark, folder):
    rows = stats.with_due_date(_orders(spark, folder), F.lit("1998-01-01").cast("date"))
    return rows.groupBy(F.coalesce("priority", F.lit("none")).alias("priority")).agg(
        F.count_if("overdue").alias("overdue"), F.max("due_date").cast("string").alias("last_due"))


@query("weekly_trend", classified_sql(
    "SELECT CAST(CAST(date_trunc('week', created_ts) AS DATE) AS VARCHAR) AS week, audience, count(*) AS n FROM v GROUP BY ALL"))
def weekly_trend(spark, folder):
    return stats.weekly_trend(classified(spark, folder), "audience")


_SUB, _IMPACT = TAXONOMY.subcategories[0], TAXONOMY.impact_types[0]


@query("filter_classes", classified_sql(f"""SELECT feedback_id FROM v WHERE enhanced_category = {quoted(_SUB.category)}
 AND subcategory IN ({quoted(_SUB.name)}, 'Uncategorized') AND impact_type IN ({quoted(_IMPACT.id)}, 'FEEDBACK')"""))
def filter_classes(spark, folder):
    """Facets of the classification: enhanced category, subcategory and impact."""
    spec = filters.FilterSpec.parse({"enhanced_categories": _SUB.category, "subcategories": f"{_SUB.name},Uncategorized",
                                     "impact_types": f"{_IMPACT.id},FEEDBACK"})
    return spec.apply(classified(spark, folder)).select("feedback_id")


@query("filter_single", classified_sql(f"SELECT feedback_id FROM v WHERE subcategory = {quoted(_SUB.name)} AND priority = {quoted(_SUB.priority)}"))
def filter_single(spark, folder):
    """The single-select form counts when no facet is selected."""
    spec = filters.FilterSpec.parse({"sources": "All"}, {"subcategories": _SUB.name, "priorities": _SUB.priority, "audiences": "All"})
    return spec.apply(classified(spark, folder)).select("feedback_id")
