"""Raw source records, derived from the driver tables, and their mappings to feedback."""

from pyspark.sql import functions as F

from bindings.base import FEEDBACK_SQL, feedback
from bindings.classification import _rule_sql
from bindings.fixture import GIST, KEYWORDS, LEXICON, TAXONOMY
from bindings.registry import query, sql_list
from bindings.text import clean_sql
from vocspark.functions import classify as C
from vocspark.plans import flows
from vocspark.sources import forum_html, records
from vocspark.sources.tables import read_table, spread_small

MATCHED_SQL = f"array_to_string(list_filter({sql_list(KEYWORDS)}, lambda k: contains(lower(feedback), lower(k))), ',')"


def _text_array(*values):
    return F.array(*[F.lit(v) for v in values])


def raw_posts(spark, folder):
    d = F.col("doc_id")
    parts = [("text", F.lit("A")), ("emoji", F.lit("B")), ("text", F.lit("")), ("text", F.col("source"))]
    rich = F.array(*[F.struct(F.lit(kind).alias("e"), value.alias("t")) for kind, value in parts])
    return feedback(spark, folder).select(
        "title", F.col("feedback").alias("selftext"), F.concat(F.lit("/r/x/"), d.cast("string")).alias("permalink"),
        F.when(d % 7 != 0, F.col("customer")).alias("author"), (F.lit(1704067200.0) + d * 3600 + (d % 2) * 0.5).alias("created_utc"),
        F.when(d % 3 == 1, F.concat(F.lit("plain "), "source")).alias("link_flair_text"),
        F.when(d % 3 == 0, rich).alias("link_flair_richtext"))


@query("posts_source", f"""WITH {FEEDBACK_SQL}, p AS (SELECT doc_id, title || chr(10) || chr(10) || feedback AS feedback, lower(title || ' ' || feedback) AS t, customer, source FROM fb)
SELECT 'https://www.reddit.com/r/x/' || doc_id AS url, {MATCHED_SQL} AS matched, {_rule_sql('t', C.POST_IMPACT_RULES, 'Feedback')} AS impact_type,
 CASE WHEN doc_id % 7 = 0 THEN 'N/A' ELSE customer END AS customer, CASE doc_id % 3 WHEN 0 THEN 'A, ' || source WHEN 1 THEN 'plain ' || source ELSE '' END AS tag,
 strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id % 2 = 1 THEN '.500000' ELSE '' END AS created FROM p WHERE matched <> ''""")
def posts_source(spark, folder):
    return records.posts(raw_posts(spark, folder), KEYWORDS, "x").select(
        "url", F.array_join("matched_keywords", ",").alias("matched"), "impact_type", "customer", "tag", "created")


def raw_issues(spark, folder):
    d = F.col("doc_id")
    labels = F.array(_text_array("Bug", ""), _text_array("Enhancement"), F.array().cast("array<string>"), _text_array("question", "x"))
    return feedback(spark, folder).select(
        F.when(d % 2 == 0, "acme").otherwise("other").alias("owner"), F.concat(F.lit("repo"), (d % 3).cast("string")).alias("repo"),
        d.alias("number"), "title", F.when(d % 9 != 0, F.col("feedback")).alias("body"),
        F.when(d % 8 != 0, F.struct(F.col("customer").alias("login"))).alias("user"), F.col("created").alias("created_at"),
        F.concat(F.lit("https://h/"), d.cast("string")).alias("html_url"), F.when(d % 3 == 0, "closed").otherwise("open").alias("state"),
        F.transform(F.get(labels, (d % 4).cast("int")), lambda n: F.struct(n.alias("name"))).alias("labels"),
        F.when(d % 7 == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request"))


ISSUE_SQL = f"""{FEEDBACK_SQL}, i AS (SELECT *, lower(feedback) AS t FROM (SELECT * REPLACE (title || chr(10) || chr(10) || CASE WHEN doc_id % 9 = 0 THEN '' ELSE feedback END AS feedback) FROM fb))"""


@query("issues_normalise", f"""WITH {ISSUE_SQL} SELECT 'https://h/' || doc_id AS url, {MATCHED_SQL} AS matched,
 CASE doc_id % 4 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Feature Request' WHEN 3 THEN 'Question' ELSE {_rule_sql('t', C.ISSUE_IMPACT_RULES, 'Feedback')} END AS impact_type,
 CASE WHEN doc_id % 8 = 0 THEN 'Anonymous' ELSE customer END AS customer, (['Bug', 'Enhancement', '', 'question, x'])[doc_id % 4 + 1] AS tag,
 'GitHub/' || CASE WHEN doc_id % 2 = 0 THEN 'acme' ELSE 'other' END AS organization, CASE WHEN doc_id % 3 = 0 THEN 'Closed' ELSE 'New' END AS status, created
 FROM i WHERE doc_id % 7 <> 0""")
def issues_normalise(spark, folder):
    return records.issues(raw_issues(spark, folder), KEYWORDS).select(
        "url", F.array_join("matched_keywords", ",").alias("matched"), "impact_type", "customer", "tag", "organization", "status", "created")


def raw_discussions(spark, folder):
    d = F.col("doc_id")
    return raw_issues(spark, folder).drop("state", "labels", "pull_request").withColumn(
        "category", F.when(F.col("number") % 5 != 0, F.struct(F.concat(F.lit("cat"), (F.col("number") % 3).cast("string")).alias("name")))).drop("number")


@query("discussions_source", f"""WITH {ISSUE_SQL} SELECT 'https://h/' || doc_id AS url, CASE WHEN doc_id % 5 = 0 THEN 'General' ELSE 'cat' || (doc_id % 3) END AS area,
 {_rule_sql('t', C.POST_IMPACT_RULES, 'Feedback')} AS impact_type, CASE WHEN doc_id % 8 = 0 THEN 'Anonymous' ELSE customer END AS customer, length(feedback) AS n FROM i""")
def discussions_source(spark, folder):
    return records.discussions(raw_discussions(spark, folder), KEYWORDS).select(
        "url", "area", "impact_type", "customer", F.length("feedback").cast("long").alias("n"))


@query("repository_fan_in", f"WITH {ISSUE_SQL} SELECT doc_id AS number FROM i WHERE doc_id % 2 = 0 AND doc_id % 3 IN (0, 2)")
def repository_fan_in(spark, folder):
    config = spark.createDataFrame(
        [("acme", "repo0", True), ("acme", "repo1", False), ("acme", "repo2", True), ("", "repo0", True), ("other", None, True)],
        "owner string, repo string, enabled boolean")
    return records.wanted_repositories(raw_issues(spark, folder), config).select("number")


def raw_work_items(spark, folder):
    d = F.col("doc_id")
    user = F.when(d % 3 == 0, F.to_json(F.struct(F.col("customer").alias("displayName")))).when(d % 3 == 1, F.col("customer"))
    html = F.concat(F.lit("<div><p>"), "feedback", F.lit("</p> <br> </div>"))
    return feedback(spark, folder).select(
        F.col("doc_id").alias("id"), F.map_filter(F.create_map(
            F.lit("System.Title"), F.col("title"), F.lit("System.WorkItemType"), F.when(d % 4 != 0, "Task"),
            F.lit("System.Description"), F.when(d % 5 == 0, html), F.lit("System.History"), F.when(d % 5 == 1, F.col("feedback")),
            F.lit("System.State"), F.when(d % 6 != 0, "Active"), F.lit("System.CreatedBy"), user,
            F.lit("System.CreatedDate"), F.col("created")), lambda _, v: v.isNotNull()).alias("fields"),
        F.lit(None).cast("array<struct<rel:string,url:string>>").alias("relations"))


ITEM_SQL = f"""{FEEDBACK_SQL}, w AS (SELECT doc_id AS id, title, CASE WHEN doc_id % 4 <> 0 THEN 'Task' ELSE 'Unknown' END AS type, CASE WHEN doc_id % 6 <> 0 THEN 'Active' ELSE 'Unknown' END AS state,
 CASE WHEN doc_id % 3 < 2 THEN customer ELSE 'Unassigned' END AS created_by, created,
 trim(regexp_replace(regexp_replace(CASE doc_id % 5 WHEN 0 THEN '<div><p>' || feedback || '</p> <br> </div>' WHEN 1 THEN feedback ELSE '' END, '<[^>]+>', '', 'g'),
  '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'), ' ') AS d FROM fb),
wi AS (SELECT id, title, type, state, created_by, created, CASE WHEN d = '' THEN 'No description available' ELSE d END AS description,
 CASE WHEN d = '' THEN 'No description available' WHEN length(d) > 500 THEN left(d, 500) || '...' ELSE d END AS preview FROM w)"""


@query("workitems_flatten", f"WITH {ITEM_SQL} SELECT id, type, title, description, preview, state, created_by, created FROM wi")
def workitems_flatten(spark, folder):
    return records.work_items(raw_work_items(spark, folder)).select(
        "id", "type", "title", "description", "preview", "state", "created_by", "created")


@query("workitem_feedback", f"""WITH {ITEM_SQL}, c AS (SELECT id, {clean_sql('title')} AS ct, CASE WHEN description = 'No description available' THEN '' ELSE {clean_sql('description')} END AS cd FROM wi)
SELECT '[ADO-' || id || '] ' || ct AS title, ct || CASE WHEN cd <> '' THEN chr(10) || chr(10) || cd ELSE '' END AS feedback FROM c""")
def workitem_feedback(spark, folder):
    return records.work_item_feedback(records.work_items(raw_work_items(spark, folder))).select("title", "feedback")


@query("child_links", """SELECT l_orderkey AS parent_id, l_partkey AS child_id FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_partkey % 4 <> 0""")
def child_links(spark, folder):
    line = F.col("l_linenumber")
    link = F.struct(
        F.when(line % 3 == 1, records.CHILD_LINK).when(line % 3 == 2, "Custom.Child-Of").otherwise("Related").alias("rel"),
        F.concat(F.lit("https://h/items/"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 4 == 0, "x").otherwise("")).alias("url"))
    parents = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.array(link).alias("relations"))
    return records.child_ids(parents)


@query("recent_items", """SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created FROM orders
 WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 365 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""")
def recent_items(spark, folder):
    items = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("created"))
    return records.recent_items(items, F.lit("1998-06-01").cast("timestamp"), 200)


@query("child_tasks", f"""WITH {ITEM_SQL}, l AS (SELECT * FROM wi QUALIFY row_number() OVER (PARTITION BY title ORDER BY CAST(created AS TIMESTAMP) DESC, id) = 1),
c AS (SELECT created, {clean_sql('title')} || chr(10) || chr(10) || {clean_sql('description')} AS feedback FROM l)
SELECT created, feedback, {_rule_sql('lower(feedback)', C.TASK_IMPACT_RULES, 'Task')} AS impact_type FROM c""")
def child_tasks(spark, folder):
    items = records.work_items(raw_work_items(spark, folder))
    return records.task_feedback(items, 1).select("created", "feedback", "impact_type")


@query("union_sources", f"""WITH {ISSUE_SQL}, p AS (SELECT title || chr(10) || chr(10) || feedback AS feedback FROM fb)
SELECT 'GitHub Issues' AS source, count(*) AS n, count(*) AS titles FROM i WHERE doc_id % 7 <> 0
UNION ALL SELECT 'GitHub Discussions', count(*), 0 FROM i
UNION ALL SELECT 'Reddit', count(*), 0 FROM p WHERE {MATCHED_SQL} <> ''""")
def union_sources(spark, folder):
    both = records.union_sources(
        records.issues(raw_issues(spark, folder), KEYWORDS), records.discussions(raw_discussions(spark, folder), KEYWORDS),
        records.posts(raw_posts(spark, folder), KEYWORDS, "x"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("title").alias("titles"))


PAGE_SPEC = forum_html.PageSpec(
    block="body", title="article h1", author="div.byline", date="span.date", time="span.time", body="article p",
    label="nav li a", title_href="nav li a")


def page_blocks(spark, folder):
    pages = spread_small(read_table(spark, folder, "pages"))
    return forum_html.extract_blocks(pages, "page_id", spec=PAGE_SPEC)


@query("forum_blocks")
def forum_blocks(spark, folder):
    return page_blocks(spark, folder).select(
        "page_key", "position", "title", "href", "body", F.array_join("labels", "|").alias("labels"))


@query("forum_source")
def forum_source(spark, folder):
    return forum_html.forum_feedback(
        page_blocks(spark, folder), KEYWORDS, F.lit("2024-06-15 12:30:00").cast("timestamp"), "https://forum.example.org").select(
        "feedback", "url", "impact_type", "customer", "tag", "created")


@query("collect_flow")
def collect_flow(spark, folder):
    """Three sources through the complete enrichment."""
    rows = records.union_sources(
        records.issues(raw_issues(spark, folder), KEYWORDS), records.posts(raw_posts(spark, folder), KEYWORDS, "x"),
        records.work_item_feedback(records.work_items(raw_work_items(spark, folder)), KEYWORDS))
    full = flows.enrich(rows, TAXONOMY, F.lit("2024-06-01").cast("timestamp"), LEXICON, GIST)
    return full.select("feedback_id", "source", "feedback_gist", "category", "enhanced_category", "audience",
                       "impact_type", "confidence", "primary_domain", "sentiment", "state")
