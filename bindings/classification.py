"""Keyword matching and classification."""

from pyspark.sql import functions as F

from bindings.base import FEEDBACK_SQL, any_of, classified, classified_sql, feedback
from bindings.fixture import KEYWORDS, TAXONOMY
from bindings.registry import query, sql_list
from vocspark.functions import classify as C
from vocspark.operators import stats


@query("keyword_match", f"""SELECT doc_id, array_to_string(list_filter({sql_list(KEYWORDS)}, lambda k: contains(lower(text), lower(k))), ',') AS matched
FROM documents""")
def keyword_match(spark, folder):
    return feedback(spark, folder).select(
        "doc_id", F.array_join(C.matched_keywords("feedback", KEYWORDS), ",").alias("matched"))


@query("legacy_category", classified_sql("SELECT doc_id, category FROM v"))
def legacy_category(spark, folder):
    return feedback(spark, folder).select("doc_id", C.legacy_category("feedback", TAXONOMY).alias("category"))


@query("impact_type", classified_sql("SELECT doc_id, impact_type FROM v"))
def impact_type(spark, folder):
    return feedback(spark, folder).select("doc_id", C.impact_type("feedback", TAXONOMY).alias("impact_type"))


@query("audience", classified_sql("SELECT doc_id, audience FROM v"))
def audience(spark, folder):
    return feedback(spark, folder).select("doc_id", C.audience("feedback", TAXONOMY).alias("audience"))


@query("categorize", classified_sql(
    "SELECT doc_id, enhanced_category, subcategory, audience, priority, feature_area, confidence FROM v"))
def categorize(spark, folder):
    return classified(spark, folder).select(
        "doc_id", "enhanced_category", "subcategory", "audience", "priority", "feature_area", "confidence")


@query("domains", classified_sql("SELECT doc_id, domains, primary_domain FROM v"))
def domains(spark, folder):
    rows = feedback(spark, folder).select("doc_id", C.domains("feedback", TAXONOMY).alias("d"))
    line = F.transform("d", lambda x: F.concat_ws(
        ":", x["domain"], F.round(x["confidence"] * 100).cast("int"), x["score"], F.array_join(x["matched_keywords"], ",")))
    return rows.select("doc_id", F.array_join(line, "|").alias("domains"),
                       F.get("d", F.lit(0))["domain"].alias("primary_domain"))


@query("source_domain_counts", classified_sql(
    """SELECT source, coalesce(primary_domain, 'General') AS primary_domain, count(*) AS n,
       count(*) FILTER (WHERE category = 'Other / Uncategorized') AS uncategorized FROM v GROUP BY ALL"""))
def source_domain_counts(spark, folder):
    """Flagship: classify everything, count per source and main domain."""
    return classified(spark, folder).groupBy("source", stats.facet_value("primary_domain").alias("primary_domain")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("category") == TAXONOMY.default_category).alias("uncategorized"))


def _rule_sql(text, rules, default):
    return "CASE " + " ".join(f"WHEN {any_of(text, ws)} THEN '{name}'" for name, ws in rules) + f" ELSE '{default}' END"


@query("impact_rules", f"""WITH {FEEDBACK_SQL}, t AS (SELECT doc_id, lower(feedback) || ' ' || (['please test it', 'it is broken', 'an idea', 'qa task', 'how to'])[doc_id % 5 + 1] AS t,
 ([['Bug'], ['Enhancement', 'x'], [], ['Support']])[doc_id % 4 + 1] AS labels FROM fb)
SELECT doc_id, {_rule_sql('t', C.POST_IMPACT_RULES, 'Feedback')} AS post_impact, {_rule_sql('t', C.TASK_IMPACT_RULES, 'Task')} AS task_impact,
 CASE WHEN list_contains(labels, 'Bug') THEN 'Bug' WHEN list_contains(labels, 'Enhancement') THEN 'Feature Request'
  WHEN list_contains(labels, 'Support') THEN 'Question' ELSE {_rule_sql('t', C.ISSUE_IMPACT_RULES, 'Feedback')} END AS issue_impact FROM t""")
def impact_rules(spark, folder):
    endings = F.array(*[F.lit(x) for x in ("please test it", "it is broken", "an idea", "qa task", "how to")])
    labels = F.array(*[F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in (
        ["Bug"], ["Enhancement", "x"], [], ["Support"])])
    rows = feedback(spark, folder).withColumns({
        "t": F.concat_ws(" ", "feedback", F.get(endings, (F.col("doc_id") % 5).cast("int"))),
        "labels": F.get(labels, (F.col("doc_id") % 4).cast("int"))})
    return rows.select("doc_id", C.post_impact("t").alias("post_impact"), C.task_impact("t").alias("task_impact"),
                       C.issue_impact("t", "labels").alias("issue_impact"))


@query("standard_audience", classified_sql(
    "SELECT CASE WHEN audience IN ('Developer', 'ISV', 'Platform') THEN 'Developer' ELSE 'Customer' END AS audience, count(*) AS n FROM v GROUP BY 1"))
def standard_audience(spark, folder):
    return (classified(spark, folder).groupBy(C.standard_audience("audience").alias("audience"))
            .agg(F.count(F.lit(1)).alias("n")))
