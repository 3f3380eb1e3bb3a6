"""Mappings from landed JSON records to feedback columns.

Each mapper is a projection with at most a filter, so the unions of all sources stay one narrow
stage.  Fetching is not done here: the inputs are records some other job has landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.classify import issue_impact, matched_keywords, post_impact, task_impact
from vocspark.functions.common import blank_to_null, collapse_space, first_filled, truncate, with_once
from vocspark.functions.dates import epoch_to_iso
from vocspark.functions.text import clean_text
from vocspark.operators.dedup import latest_per_title
from vocspark.schema import DEFAULT_STATUS

POST_SCHEMA = ("title string, selftext string, permalink string, author string, created_utc double, "
               "link_flair_text string, link_flair_richtext array<struct<e:string,t:string>>")
DISCUSSION_SCHEMA = ("owner string, repo string, title string, body string, user struct<login:string>, "
                     "created_at string, html_url string, category struct<name:string>")
ISSUE_SCHEMA = ("owner string, repo string, number long, title string, body string, user struct<login:string>, "
                "created_at string, html_url string, state string, labels array<struct<name:string>>, "
                "pull_request struct<url:string>")
WORK_ITEM_SCHEMA = ("id long, fields map<string,string>, relations array<struct<rel:string,url:string>>")

# Description fields in the order they are tried, texts for missing parts.
DESCRIPTION_FIELDS = ["System.Description", "Microsoft.VSTS.Common.AcceptanceCriteria",
                      "Microsoft.VSTS.Common.ReproSteps", "System.History", "Microsoft.VSTS.TCM.Steps"]
CHILD_LINK = "System.LinkTypes.Hierarchy-Forward"
NO_DESCRIPTION = "No description available"
# Length of the preview column; the description itself is never cut.
PREVIEW_CHARS = 500


def _text(title, body) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def flair_text(rich="link_flair_richtext", plain="link_flair_text") -> Column:
    """Text parts of a rich flair joined by commas; without a rich flair the plain one."""
    parts = F.transform(F.filter(F.col(rich), lambda f: (f["e"] == "text") & (f["t"] != "")), lambda f: f["t"])
    return F.when(F.size(rich) > 0, F.array_join(parts, ", ")).otherwise(F.coalesce(plain, F.lit("")))


def posts(raw: DataFrame, keywords, community: str, site: str = "https://www.reddit.com", area: str = "General") -> DataFrame:
    """Forum posts with at least one tracked keyword, which is searched for once a post."""
    text = _text("title", "selftext")
    rows = with_once(raw.withColumn("feedback", text), "matched_keywords", matched_keywords("feedback", keywords))
    return rows.filter(F.size("matched_keywords") > 0).select(
        "feedback", "matched_keywords", F.concat(F.lit(site), "permalink").alias("url"),
        F.lit(area).alias("area"), F.lit("Reddit").alias("source"),
        post_impact(F.concat_ws(" ", "title", "selftext")).alias("impact_type"),
        F.lit("Customer").alias("scenario"), F.coalesce(blank_to_null("author"), F.lit("N/A")).alias("customer"),
        flair_text().alias("tag"), epoch_to_iso("created_utc").alias("created"),
        F.lit(f"Reddit/{community}").alias("organization"), F.lit(DEFAULT_STATUS).alias("status"),
        F.to_json(F.struct(*raw.columns)).alias("raw"))


def discussions(raw: DataFrame, keywords, area: str = "General") -> DataFrame:
    """Discussions of code repositories; all are kept, with or without a tracked keyword."""
    rows = raw.withColumn("feedback", _text("title", "body"))
    return rows.select(
        "feedback", matched_keywords("feedback", keywords).alias("matched_keywords"), F.col("html_url").alias("url"),
        F.coalesce("category.name", F.lit(area)).alias("area"), F.lit("GitHub Discussions").alias("source"),
        post_impact("feedback").alias("impact_type"), F.lit("Partner").alias("scenario"),
        F.coalesce("user.login", F.lit("Anonymous")).alias("customer"), F.lit("").alias("tag"),
        F.col("created_at").alias("created"), F.concat(F.lit("GitHub/"), "owner").alias("organization"),
        F.lit(DEFAULT_STATUS).alias("status"), F.to_json(F.struct(*raw.columns)).alias("raw"))


def issues(raw: DataFrame, keywords) -> DataFrame:
    """Issues without pull requests; labels become the tag, closed ones keep that status."""
    names = F.filter(F.transform("labels", lambda x: x["name"]), lambda n: n.isNotNull() & (n != ""))
    rows = raw.filter(F.col("pull_request").isNull()).withColumn("feedback", _text("title", "body"))
    rows = rows.withColumn("_labels", F.coalesce(names, F.array().cast("array<string>")))
    return rows.select(
        "title", "feedback", F.col("feedback").alias("content"),
        matched_keywords("feedback", keywords).alias("matched_keywords"), F.col("html_url").alias("url"),
        F.lit("Issues").alias("area"), F.lit("GitHub Issues").alias("source"),
        issue_impact("feedback", "_labels").alias("impact_type"), F.lit("Partner").alias("scenario"),
        F.coalesce("user.login", F.lit("Anonymous")).alias("customer"), F.array_join("_labels", ", ").alias("tag"),
        F.col("created_at").alias("created"), F.concat(F.lit("GitHub/"), "owner").alias("organization"),
        F.when(F.col("state") == "closed", "Closed").otherwise(DEFAULT_STATUS).alias("status"),
        F.to_json(F.struct(*raw.columns)).alias("raw"))


def wanted_repositories(raw: DataFrame, config: DataFrame, default: tuple[str, str] | None = None) -> DataFrame:
    """Records of enabled, completely configured repositories; a default applies to an empty list.

    The list is a settings table; its size decides at run time how the semi join is done.
    """
    complete = config.filter(F.col("enabled") & blank_to_null("owner").isNotNull() & blank_to_null("repo").isNotNull())
    wanted = complete.select("owner", "repo").distinct()
    if default is not None and config.isEmpty():
        wanted = raw.sparkSession.createDataFrame([default], "owner string, repo string")
    return raw.join(wanted, ["owner", "repo"], "left_semi")


def _field(name: str, missing: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(missing))


def user_name(value: Column) -> Column:
    """Display name of a user written as JSON object or plain text."""
    shown = F.from_json(value, "displayName string")["displayName"]
    return (F.when(value.isNull() | (value == ""), "Unassigned")
            .when(F.startswith(value, F.lit("{")), F.coalesce(shown, F.lit("Unknown"))).otherwise(value))


def work_items(raw: DataFrame, site: str = "", preview_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Flatten the field map of work items, with the whole tag-free description and a short ``preview`` for display."""
    described = first_filled(*[F.try_element_at("fields", F.lit(f)) for f in DESCRIPTION_FIELDS])
    flat = collapse_space(F.regexp_replace(described, "<[^>]+>", ""))
    return raw.select(
        "id", _field("System.WorkItemType", "Unknown").alias("type"), _field("System.Title", "No Title").alias("title"),
        first_filled(flat, F.lit(NO_DESCRIPTION)).alias("description"),
        first_filled(truncate(flat, preview_chars), F.lit(NO_DESCRIPTION)).alias("preview"),
        _field("System.State", "Unknown").alias("state"),
        user_name(F.try_element_at("fields", F.lit("System.AssignedTo"))).alias("assigned_to"),
        user_name(F.try_element_at("fields", F.lit("System.CreatedBy"))).alias("created_by"),
        _field("System.CreatedDate", "").alias("created"), _field("System.AreaPath", "").alias("area_path"),
        F.concat(F.lit(f"{site}/_workitems/edit/"), F.col("id").cast("string")).alias("url"))


def child_ids(parents: DataFrame) -> DataFrame:
    """(parent_id, child_id) from the child links of each parent."""
    links = parents.select(F.col("id").alias("parent_id"), F.explode("relations").alias("r"))
    last = F.element_at(F.split(F.col("r.url"), "/"), -1)
    is_child = (F.col("r.rel") == CHILD_LINK) | F.contains(F.lower(F.coalesce(F.col("r.rel"), F.lit(""))), F.lit("child"))
    return links.filter(is_child & last.rlike(r"^\d+$")).select("parent_id", last.cast("long").alias("child_id"))


def recent_items(items: DataFrame, as_of: Column, limit: int, created: str = "created", days: int = 365) -> DataFrame:
    """Newest items of the ``days`` before ``as_of``."""
    at = F.col(created).try_cast("timestamp")
    since = as_of - F.expr(f"INTERVAL {days} DAYS")
    return items.filter(at >= since).orderBy(at.desc(), F.col("id").asc()).limit(limit)


def children_or_recent(items: DataFrame, parent_id: int, as_of: Column, limit: int) -> DataFrame:
    """All linked children of one parent; if it has none, at most ``limit`` recent items."""
    ids = child_ids(items.filter(F.col("id") == parent_id)).select(F.col("child_id").alias("id")).distinct()
    if ids.isEmpty():
        flat = items.withColumn("created", F.try_element_at("fields", F.lit("System.CreatedDate")))
        return recent_items(flat, as_of, limit).drop("created")
    return items.join(ids, "id", "left_semi").orderBy("id")


def work_item_feedback(items: DataFrame, keywords=(), project: str = "core") -> DataFrame:
    """Flattened work items as feedback."""
    described = F.when(F.col("description") == NO_DESCRIPTION, F.lit("")).otherwise(F.col("description"))
    rows = items.withColumns({"_title": clean_text("title"), "_body": clean_text(described)})
    rows = rows.withColumn("feedback", F.concat_ws("\n\n", "_title", blank_to_null("_body")))
    return rows.select(
        F.concat(F.lit("[ADO-"), F.col("id").cast("string"), F.lit("] "), F.col("_title")).alias("title"),
        "feedback", F.col("feedback").alias("content"), first_filled("_body", "_title").alias("sentiment_text"),
        matched_keywords("feedback", keywords).alias("matched_keywords"), "url", F.lit("Azure DevOps").alias("source"),
        F.lit("Internal").alias("scenario"), F.lit(f"ADO/{project}").alias("organization"),
        F.col("created_by").alias("customer"), "created", F.lit(DEFAULT_STATUS).alias("status"),
        F.col("id").cast("string").alias("ado_id"), F.col("type").alias("ado_type"),
        F.col("state").alias("ado_state"), F.col("assigned_to").alias("ado_assigned_to"))


def task_feedback(items: DataFrame, parent_id: int, order_col: str = "id", keywords=(), project: str = "core") -> DataFrame:
    """Child tasks, the newest per title, as feedback."""
    rows = latest_per_title(items, order_col).withColumns(
        {"_title": clean_text("title"), "_body": clean_text("description")})
    rows = rows.withColumn("feedback", _text("_title", "_body"))
    return rows.select(
        "feedback", F.col("_body").alias("sentiment_text"),
        matched_keywords("feedback", keywords).alias("matched_keywords"), "url", F.lit("Development Tasks").alias("area"), F.lit("Azure DevOps").alias("source"),
        task_impact("feedback").alias("impact_type"), F.lit("Internal").alias("scenario"),
        F.lit("Development Team").alias("customer"), F.lit(f"ChildOf:{parent_id}").alias("tag"), "created",
        F.lit(f"ADO/{project}").alias("organization"), F.lit(DEFAULT_STATUS).alias("status"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources under one set of columns; what a source does not know is null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
