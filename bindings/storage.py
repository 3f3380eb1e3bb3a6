"""Duplicates, stored identifiers, layouts."""

from pyspark.sql import functions as F

from bindings.base import FEEDBACK_SQL, feedback
from bindings.fixture import KEYWORDS
from bindings.registry import query, sql_list
from bindings.text import WS, norm_sql
from bindings.triage import STATES_SQL, STORED_SQL, states, stored
from vocspark.functions.common import with_once
from vocspark.functions.classify import matched_keywords
from vocspark.functions.ids import feedback_id
from vocspark.operators import dedup, filters
from vocspark.plans import flows
from vocspark.sinks import tables
from vocspark.sources.tables import read_table


def batch(spark, folder):
    """All documents as a batch to insert; the identifier is made from the text alone."""
    rows = feedback(spark, folder).withColumns({
        "feedback_id": feedback_id(F.lit(""), "feedback", F.lit("")), "content": F.col("feedback"),
        "matched_keywords": matched_keywords("feedback", KEYWORDS)})
    rows = rows.withColumn("original_id", F.when(F.col("doc_id") % 3 == 0, F.col("feedback_id")))
    return rows.select("doc_id", "feedback_id", "original_id", "title", "content", "matched_keywords")


def stored_batch(spark, folder):
    """The labelled documents are stored already; toxic ones carry keywords."""
    marks = read_table(spark, folder, "labels").select("doc_id", "toxic")
    return batch(spark, folder).join(marks, "doc_id").withColumn(
        "matched_keywords", F.when(F.col("toxic") == 1, F.array(F.lit("old"))))


ID_SQL = f"regexp_replace(left(sha256({norm_sql('feedback')}), 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
SIG_SQL = f"regexp_replace(lower(title), '^{WS}+|{WS}+$', '', 'g') || '|' || regexp_replace(lower(feedback), '^{WS}+|{WS}+$', '', 'g')"
BATCH_SQL = f"""{FEEDBACK_SQL}, ba AS (SELECT doc_id, {ID_SQL} AS feedback_id, {SIG_SQL} AS sig, feedback,
 array_to_string(list_filter({sql_list(KEYWORDS)}, lambda k: contains(lower(feedback), lower(k))), ',') AS kw FROM fb),
sb AS (SELECT ba.*, toxic FROM ba JOIN labels USING (doc_id)),
cand AS (SELECT * FROM ba WHERE feedback_id NOT IN (SELECT feedback_id FROM sb) AND sig NOT IN (SELECT sig FROM sb)),
fold AS (SELECT list_reduce(list({{'ids': [feedback_id], 'sigs': [sig], 'ords': [doc_id]}} ORDER BY doc_id), lambda a, x:
  CASE WHEN list_has_any(a.ids, x.ids) OR list_has_any(a.sigs, x.sigs) THEN a
  ELSE {{'ids': list_concat(a.ids, x.ids), 'sigs': list_concat(a.sigs, x.sigs), 'ords': list_concat(a.ords, x.ords)}} END) AS r FROM cand),
acc AS (SELECT unnest(r.ords) AS doc_id FROM fold)"""


@query("dedup_insert", f"WITH {BATCH_SQL} SELECT doc_id, feedback_id FROM ba JOIN acc USING (doc_id)")
def dedup_insert(spark, folder):
    return dedup.rows_to_insert(batch(spark, folder), stored_batch(spark, folder), "doc_id").select("doc_id", "feedback_id")


@query("dedup_counters", f"""WITH {BATCH_SQL}, a AS (SELECT count(*) AS n FROM acc) SELECT a.n AS new_items, count(*) - a.n AS existing_items, count(*) AS total_items,
 count(*) FILTER (WHERE doc_id % 3 <> 0) AS id_regenerated FROM ba, a GROUP BY a.n""")
def dedup_counters(spark, folder):
    rows = batch(spark, folder)
    keys = dedup.insert_keys(rows, stored_batch(spark, folder), "doc_id")
    return dedup.insert_counters(rows, keys, "original_id")


@query("keyword_backfill", f"""WITH {BATCH_SQL}, fresh AS (SELECT feedback_id, arg_min(kw, doc_id) AS kw FROM ba WHERE kw <> '' GROUP BY 1)
SELECT doc_id, CASE WHEN toxic = 1 THEN 'old' ELSE fresh.kw END AS matched_keywords FROM sb LEFT JOIN fresh USING (feedback_id)""")
def keyword_backfill(spark, folder):
    out = dedup.backfill_keywords(stored_batch(spark, folder), batch(spark, folder), "doc_id")
    return out.select("doc_id", F.array_join("matched_keywords", ",").alias("matched_keywords"))


@query("latest_per_title", """WITH i AS (SELECT o_orderkey AS id, 'T' || (o_custkey % 200) AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS created FROM orders)
SELECT id, title, created FROM i QUALIFY row_number() OVER (PARTITION BY title ORDER BY TRY_CAST(created AS TIMESTAMP) DESC NULLS LAST, id) = 1""")
def latest_per_title(spark, folder):
    items = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("T"), (F.col("o_custkey") % 200).cast("string")).alias("title"),
        F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.to_date("o_orderdate").cast("string")).alias("created"))
    return dedup.latest_per_title(items, "id")


@query("per_source_limit", f"""WITH {FEEDBACK_SQL} SELECT feedback_id, source, created FROM fb
 QUALIFY row_number() OVER (PARTITION BY source ORDER BY created DESC, feedback_id) <= 40""")
def per_source_limit(spark, folder):
    return dedup.limit_per_source(feedback(spark, folder).select("feedback_id", "source", "created"), 40)


@query("stored_ids", f"WITH {STATES_SQL} SELECT DISTINCT feedback_id FROM (SELECT feedback_id FROM st UNION ALL SELECT updated_by FROM st UNION ALL SELECT notes FROM st) WHERE trim(feedback_id) <> ''")
def stored_ids(spark, folder):
    s = states(spark, folder)
    mixed = s.select("feedback_id").union(s.select("updated_by")).union(s.select("notes"))
    return dedup.stored_ids(mixed)


@query("stored_only", f"WITH {STATES_SQL}, {STORED_SQL} SELECT feedback_id, category FROM fd WHERE feedback_id IN (SELECT feedback_id FROM st)")
def stored_only(spark, folder):
    spec = filters.FilterSpec(stored_only=True)
    return spec.apply(stored(spark, folder), dedup.stored_ids(states(spark, folder))).select("feedback_id", "category")


@query("keyword_gate", f"""SELECT doc_id FROM documents WHERE len(list_filter({sql_list(KEYWORDS)}, lambda k: contains(lower(text), lower(k)))) > 0""")
def keyword_gate(spark, folder):
    rows = with_once(feedback(spark, folder), "matched_keywords", matched_keywords("feedback", KEYWORDS))
    return filters.keyword_gate(rows).select("doc_id")


@query("canonical_projection", f"WITH {FEEDBACK_SQL} SELECT feedback_id, title, source, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS DOUBLE) AS confidence, created FROM fb")
def canonical_projection(spark, folder):
    return tables.project(feedback(spark, folder)).select("feedback_id", "title", "source", "tag", "confidence", "created")


@query("add_missing_columns", f"WITH {STATES_SQL} SELECT feedback_id, state, CAST(NULL AS VARCHAR) AS category, updated_by FROM st")
def add_missing_columns(spark, folder):
    from vocspark.schema import STATE_SCHEMA
    old = states(spark, folder).select("feedback_id", "state", "updated_by")
    return tables.add_missing_columns(old, STATE_SCHEMA).select("feedback_id", "state", "category", "updated_by")


SYNC_SIG_SQL = f"""regexp_replace(lower(CASE WHEN title = '' THEN feedback ELSE title END), '^{WS}+|{WS}+$', '', 'g') || '|' ||
 regexp_replace(lower(feedback), '^{WS}+|{WS}+$', '', 'g')"""
STORED_SIG_SQL = SYNC_SIG_SQL.replace("CASE WHEN title = '' THEN feedback ELSE title END", "title")


@query("sync_flow", f"""WITH {FEEDBACK_SQL}, {STATES_SQL}, old AS (SELECT fb.* FROM fb JOIN labels USING (doc_id)),
cand AS (SELECT fb.*, {SYNC_SIG_SQL} AS sig FROM fb WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
fresh AS (SELECT * FROM cand WHERE sig NOT IN (SELECT {STORED_SIG_SQL} FROM old) QUALIFY row_number() OVER (PARTITION BY sig ORDER BY doc_id) = 1),
al AS (SELECT feedback_id, title, 'ISV' AS audience FROM old UNION ALL
 SELECT feedback_id, CASE WHEN title = '' THEN feedback ELSE title END, 'Developer' FROM fresh)
SELECT al.feedback_id, title, audience, coalesce(nullif(state, ''), 'NEW') AS state, nullif(primary_domain, '') AS primary_domain, updated_by FROM al LEFT JOIN st USING (feedback_id)""")
def sync_flow(spark, folder):
    """The whole sync: insert what is new, back-fill, carry domains over."""
    rows = feedback(spark, folder).withColumns({
        "feedback_id": F.col("feedback_id"), "feedback_gist": F.lit(""), "audience": F.lit("ISV"),
        "primary_domain": F.lit(None).cast("string"), "notes": F.lit(None).cast("string"), "state": F.lit("NEW"),
        "updated_by": F.lit(None).cast("string"), "last_updated": F.lit(None).cast("timestamp"),
        "matched_keywords": matched_keywords("feedback", KEYWORDS)})
    marks = read_table(spark, folder, "labels").select("doc_id")
    old = rows.join(marks, "doc_id", "left_semi").drop("doc_id")
    result = flows.sync(rows, old, states(spark, folder), "doc_id")
    return result.current.select("feedback_id", "title", "audience", "state", "primary_domain", "updated_by")
