"""Change logs, state tables, edits, recategorize."""

from pyspark.sql import functions as F

from bindings.base import FEEDBACK_SQL, classification_sql, feedback
from bindings.fixture import TAXONOMY
from bindings.registry import query
from vocspark.operators import recategorize, state, stats
from vocspark.sources.tables import read_table

TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "'%Y-%m-%d %H:%M:%S'"
K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"


def changes(spark, folder):
    """``events`` as a log of partial state changes; some lack an id, a state, an actor."""
    e = read_table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("ord"),
        F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit("f"), F.col("user_id").cast("string"))).alias("feedback_id"),
        F.when(kind == "view", "NEW").when(kind == "click", "TRIAGED").when(kind == "purchase", "CLOSED")
        .when(kind == "signup", "IRRELEVANT").alias("state"),
        F.when(k % 3 != 0, F.concat(F.lit("n"), k.cast("string"))).alias("notes"),
        F.when(k % 5 == 0, F.concat(F.lit("Dom"), (k % 7).cast("string"))).when(k % 11 == 0, "").alias("domain"),
        F.when(k % 4 == 0, None).when(k % 9 == 0, "").otherwise(F.concat(F.lit("u"), (k % 10).cast("string"))).alias("updated_by"),
        F.col("ts").cast("timestamp").alias("at"))


CHANGES_SQL = f"""chg AS (SELECT event_id AS ord, CASE WHEN event_id % 50 = 0 THEN '' ELSE 'f' || user_id END AS feedback_id,
 CASE event_type WHEN 'view' THEN 'NEW' WHEN 'click' THEN 'TRIAGED' WHEN 'purchase' THEN 'CLOSED' WHEN 'signup' THEN 'IRRELEVANT' END AS state,
 CASE WHEN {K} % 3 <> 0 THEN 'n' || {K} END AS notes, CASE WHEN {K} % 5 = 0 THEN 'Dom' || ({K} % 7) WHEN {K} % 11 = 0 THEN '' END AS domain,
 CASE WHEN {K} % 4 = 0 THEN NULL WHEN {K} % 9 = 0 THEN '' ELSE 'u' || ({K} % 10) END AS updated_by, ts AS "at" FROM events)"""


def states(spark, folder):
    """``labels`` as the stored state table, with null and blank overrides."""
    d = F.col("doc_id")
    return read_table(spark, folder, "labels").select(
        F.concat(F.lit("f"), d.cast("string")).alias("feedback_id"), F.when(F.col("quality") == 1, "TRIAGED").alias("state"),
        F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("notes"),
        F.when(d % 3 == 0, "").when(d % 3 == 1, "Login").alias("primary_domain"),
        F.when(d % 4 == 0, "Cat A").when(d % 4 == 1, "").alias("category"), F.when(d % 5 == 0, "Sub B").alias("subcategory"),
        F.when(d % 6 == 0, "Area C").when(d % 6 == 1, "").alias("feature_area"),
        F.timestamp_seconds(F.lit(1704067200) + d * 60).alias("last_updated"), F.lit("curator").alias("updated_by"))


STATES_SQL = """st AS (SELECT 'f' || doc_id AS feedback_id, CASE WHEN quality = 1 THEN 'TRIAGED' END AS state, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS notes,
 CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Login' END AS primary_domain, CASE doc_id % 4 WHEN 0 THEN 'Cat A' WHEN 1 THEN '' END AS category,
 CASE WHEN doc_id % 5 = 0 THEN 'Sub B' END AS subcategory, CASE doc_id % 6 WHEN 0 THEN 'Area C' WHEN 1 THEN '' END AS feature_area,
 TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS last_updated, 'curator' AS updated_by FROM labels)"""


def stored(spark, folder):
    """``documents`` as stored feedback rows with simple classes."""
    d = F.col("doc_id")
    quality = read_table(spark, folder, "labels").select("doc_id", F.when(F.col("quality") == 0, True).alias("user_modified"))
    return read_table(spark, folder, "documents").select("doc_id").join(quality, "doc_id", "left").select(
        F.concat(F.lit("f"), d.cast("string")).alias("feedback_id"),
        F.when(d % 4 == 0, "Login").when(d % 4 == 1, "").when(d % 4 == 2, "Rules").alias("primary_domain"),
        F.concat(F.lit("C"), (d % 3).cast("string")).alias("category"), F.concat(F.lit("E"), (d % 3).cast("string")).alias("enhanced_category"),
        F.concat(F.lit("S"), (d % 3).cast("string")).alias("subcategory"), F.concat(F.lit("A"), (d % 2).cast("string")).alias("feature_area"),
        F.lit("Customer").alias("audience"), F.when(d % 2 == 0, "NEW").alias("state"), F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("timestamp").alias("last_updated"), F.lit(None).cast("string").alias("updated_by"), "user_modified")


STORED_SQL = """fd AS (SELECT 'f' || doc_id AS feedback_id, CASE doc_id % 4 WHEN 0 THEN 'Login' WHEN 1 THEN '' WHEN 2 THEN 'Rules' END AS primary_domain,
 'C' || (doc_id % 3) AS category, 'E' || (doc_id % 3) AS enhanced_category, 'S' || (doc_id % 3) AS subcategory, 'A' || (doc_id % 2) AS feature_area,
 'Customer' AS audience, CASE WHEN doc_id % 2 = 0 THEN 'NEW' END AS state, CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS TIMESTAMP) AS last_updated,
 CAST(NULL AS VARCHAR) AS updated_by, CASE WHEN quality = 0 THEN true END AS user_modified FROM documents LEFT JOIN labels USING (doc_id))"""

NET_SQL = f"""{CHANGES_SQL}, net AS (SELECT feedback_id, arg_max(state, ord) FILTER (WHERE state IS NOT NULL) AS state,
 arg_max(notes, ord) FILTER (WHERE notes IS NOT NULL) AS notes, arg_max(domain, ord) FILTER (WHERE domain IS NOT NULL) AS domain,
 arg_max(coalesce(nullif(updated_by, ''), 'unknown_user'), ord) AS updated_by, arg_max("at", ord) AS last_updated FROM chg WHERE feedback_id <> '' GROUP BY 1)"""
SHOWN = ["feedback_id", "state", "notes", "primary_domain", "category", "subcategory", "feature_area", "last_updated", "updated_by"]


def _shown(df):
    return df.select(*[F.date_format(c, TS).alias(c) if c == "last_updated" else c for c in SHOWN])


SHOWN_SQL = ", ".join(f"strftime({c}, {SQL_TS}) AS {c}" if c == "last_updated" else c for c in SHOWN)


@query("state_current", f"WITH {NET_SQL} SELECT feedback_id, state, notes, domain, updated_by, strftime(last_updated, {SQL_TS}) AS last_updated FROM net")
def state_current(spark, folder):
    return state.collapse_changes(changes(spark, folder)).withColumn("last_updated", F.date_format("last_updated", TS))


UPSERT_SQL = f"""{NET_SQL}, {STATES_SQL}, up AS (SELECT feedback_id, CASE WHEN net.state IS NOT NULL THEN net.state WHEN st.updated_by IS NULL THEN 'NEW' ELSE st.state END AS state,
 coalesce(net.notes, st.notes) AS notes, coalesce(net.domain, st.primary_domain) AS primary_domain, category, subcategory, feature_area,
 coalesce(net.last_updated, st.last_updated) AS last_updated, coalesce(net.updated_by, st.updated_by) AS updated_by FROM st FULL JOIN net USING (feedback_id))"""


@query("state_upsert", f"WITH {UPSERT_SQL} SELECT {SHOWN_SQL} FROM up")
def state_upsert(spark, folder):
    return _shown(state.upsert_states(states(spark, folder), changes(spark, folder)))


@query("domain_write_through", f"""WITH {CHANGES_SQL}, {STORED_SQL}, n AS (SELECT feedback_id, arg_max(domain, ord) AS domain FROM chg WHERE domain <> '' AND feedback_id <> '' GROUP BY 1)
SELECT feedback_id, coalesce(n.domain, primary_domain) AS primary_domain FROM fd LEFT JOIN n USING (feedback_id)""")
def domain_write_through(spark, folder):
    return state.write_domains_through(stored(spark, folder), changes(spark, folder)).select("feedback_id", "primary_domain")


@query("states_with_fallback", f"""WITH {STATES_SQL}, {STORED_SQL} SELECT feedback_id, st.state, st.notes, coalesce(st.primary_domain, fd.primary_domain) AS primary_domain,
 coalesce(st.category, fd.category) AS category, coalesce(st.subcategory, fd.subcategory) AS subcategory, coalesce(st.feature_area, fd.feature_area) AS feature_area,
 strftime(st.last_updated, {SQL_TS}) AS last_updated, st.updated_by FROM st LEFT JOIN fd USING (feedback_id)""")
def states_with_fallback(spark, folder):
    return _shown(state.newest_states_first(state.states_with_fallback(states(spark, folder), stored(spark, folder))))


@query("state_overlay", f"""WITH {STATES_SQL}, {STORED_SQL} SELECT feedback_id, coalesce(nullif(st.state, ''), fd.state) AS state, coalesce(nullif(st.primary_domain, ''), fd.primary_domain) AS primary_domain,
 coalesce(nullif(st.notes, ''), fd.notes) AS notes, coalesce(st.updated_by, fd.updated_by) AS updated_by FROM fd LEFT JOIN st USING (feedback_id)""")
def state_overlay(spark, folder):
    return state.overlay_states(stored(spark, folder), states(spark, folder)).select(
        "feedback_id", "state", "primary_domain", "notes", "updated_by")


@query("domain_sync", f"""WITH {STATES_SQL}, {STORED_SQL}, j AS (SELECT fd.feedback_id, fd.primary_domain AS old, nullif(st.primary_domain, '') AS new FROM fd LEFT JOIN st USING (feedback_id))
SELECT feedback_id, coalesce(new, old) AS primary_domain, new IS NOT NULL AND new IS DISTINCT FROM old AS domain_synced FROM j""")
def domain_sync(spark, folder):
    return state.sync_domains(stored(spark, folder), states(spark, folder)).select("feedback_id", "primary_domain", "domain_synced")


@query("state_history", f"""WITH {CHANGES_SQL}, h AS (SELECT *, lag(state) OVER (PARTITION BY feedback_id ORDER BY "at", ord) AS old FROM chg WHERE state IS NOT NULL),
m AS (SELECT *, lead("at") OVER (PARTITION BY feedback_id ORDER BY "at", ord) AS nxt FROM h WHERE old IS DISTINCT FROM state)
SELECT feedback_id, old AS old_state, state AS new_state, notes, updated_by, strftime("at", {SQL_TS}) AS "at", strftime(nxt, {SQL_TS}) AS next_at FROM m""")
def state_history(spark, folder):
    return state.state_history(changes(spark, folder)).withColumns(
        {"at": F.date_format("at", TS), "next_at": F.date_format("next_at", TS)})


@query("state_analytics", f"""WITH {CHANGES_SQL}, h AS (SELECT *, lag(state) OVER (PARTITION BY feedback_id ORDER BY "at", ord) AS old FROM chg WHERE state IS NOT NULL),
m AS (SELECT *, lead("at") OVER (PARTITION BY feedback_id ORDER BY "at", ord) AS nxt FROM h WHERE old IS DISTINCT FROM state)
SELECT state, count(*) AS entries, count(nxt) AS left_again, round(CAST(CAST(sum(epoch_us(nxt) - epoch_us("at")) AS BIGINT) AS DOUBLE) / count(nxt) / 1000000) AS mean_seconds FROM m GROUP BY 1""")
def state_analytics(spark, folder):
    return stats.state_analytics(state.state_history(changes(spark, folder)))


@query("user_activity", f"""WITH {CHANGES_SQL} SELECT updated_by, count(*) AS n, count(DISTINCT state) AS states, strftime(max("at"), {SQL_TS}) AS last_at FROM chg GROUP BY 1""")
def user_activity(spark, folder):
    return stats.user_activity(changes(spark, folder)).withColumn("last_at", F.date_format("last_at", TS))


FIELDS = ["primary_domain", "category", "subcategory", "feature_area", "state", "notes", "audience", "title", "primary_domain"]


def edits(spark, folder):
    e = read_table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*[F.lit(f) for f in FIELDS])
    return e.select(F.col("event_id").alias("ord"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("feedback_id"),
                    F.get(names, (F.col("event_id") % 9).cast("int")).alias("field"),
                    F.when(k % 6 != 0, F.concat(F.lit("v"), k.cast("string"))).alias("value"), F.col("ts").cast("timestamp").alias("at"),
                    F.concat(F.lit("u"), (k % 10).cast("string")).alias("by"))


def _edit(f):
    return f"CASE WHEN t_{f} THEN e_{f} ELSE {f} END AS {f}"


EDITS_SQL = f"""ed AS (SELECT event_id AS ord, 'f' || user_id AS feedback_id, ({FIELDS})[event_id % 9 + 1] AS field, CASE WHEN {K} % 6 <> 0 THEN 'v' || {K} END AS value,
 ts AS "at", 'u' || ({K} % 10) AS "by" FROM events),
en AS (SELECT feedback_id, {', '.join(f"arg_max_null(value, ord) FILTER (WHERE field = '{f}') AS e_{f}, coalesce(bool_or(field = '{f}'), false) AS t_{f}" for f in state.EDITABLE_FIELDS)},
 arg_max("at", ord) FILTER (WHERE field <> 'audience') AS e_at, arg_max("by", ord) FILTER (WHERE field <> 'audience') AS e_by, bool_or(field <> 'audience') AS t_states
 FROM ed WHERE field <> 'title' GROUP BY 1)"""


@query("field_edits_feedback", f"""WITH {EDITS_SQL}, {STORED_SQL} SELECT feedback_id, {', '.join(_edit(f) for f in state.SHARED_FIELDS + ['audience'])}
FROM fd LEFT JOIN en USING (feedback_id)""")
def field_edits_feedback(spark, folder):
    new, _ = state.apply_field_edits(stored(spark, folder), states(spark, folder), edits(spark, folder))
    return new.select("feedback_id", *state.SHARED_FIELDS, "audience")


@query("field_edits_states", f"""WITH {EDITS_SQL}, {STATES_SQL}, q AS (SELECT feedback_id, {', '.join(_edit(f) for f in ['state', 'notes', *state.SHARED_FIELDS])},
 coalesce(e_at, last_updated) AS last_updated, coalesce(e_by, updated_by) AS updated_by FROM st FULL JOIN (SELECT * FROM en WHERE t_states) USING (feedback_id)) SELECT {SHOWN_SQL} FROM q""")
def field_edits_states(spark, folder):
    _, new = state.apply_field_edits(stored(spark, folder), states(spark, folder), edits(spark, folder))
    return _shown(new)


def category_edits(spark, folder):
    d = F.col("doc_id")
    return read_table(spark, folder, "labels").select(
        F.concat(F.lit("f"), (d * 2).cast("string")).alias("feedback_id"),
        F.when(d % 5 == 0, "  ").otherwise(F.concat(F.lit(" Cat "), (d % 3).cast("string"))).alias("category_name"),
        F.when(d % 4 != 0, "Sub ").alias("subcategory_name"), F.lit("Area").alias("feature_area"),
        F.when(d % 3 == 0, "").when(d % 3 == 1, "Code").alias("domain_code"))


CATEGORY_EDITS_SQL = """ce AS (SELECT 'f' || (doc_id * 2) AS feedback_id, nullif(trim(CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE ' Cat ' || (doc_id % 3) END), '') AS c,
 CASE WHEN doc_id % 4 <> 0 THEN 'Sub' END AS s, 'Area' AS a, CASE WHEN doc_id % 3 = 1 THEN 'Code' END AS d, doc_id % 3 < 2 AS has_d, true AS hit FROM labels)"""


@query("category_edits_feedback", f"""WITH {CATEGORY_EDITS_SQL}, {STORED_SQL} SELECT feedback_id, CASE WHEN hit THEN c ELSE category END AS category, CASE WHEN hit THEN c ELSE enhanced_category END AS enhanced_category,
 CASE WHEN hit THEN s ELSE subcategory END AS subcategory, CASE WHEN hit THEN a ELSE feature_area END AS feature_area, CASE WHEN has_d THEN d ELSE primary_domain END AS primary_domain,
 CASE WHEN hit THEN true ELSE user_modified END AS user_modified FROM fd LEFT JOIN ce USING (feedback_id)""")
def category_edits_feedback(spark, folder):
    new, _ = state.apply_category_edits(stored(spark, folder), states(spark, folder), category_edits(spark, folder), F.lit(None).cast("timestamp"))
    return new.select("feedback_id", "category", "enhanced_category", "subcategory", "feature_area", "primary_domain", "user_modified")


@query("category_edits_states", f"""WITH {CATEGORY_EDITS_SQL}, {STATES_SQL}, q AS (SELECT feedback_id, state, notes, CASE WHEN has_d THEN d ELSE primary_domain END AS primary_domain, CASE WHEN hit THEN c ELSE category END AS category,
 CASE WHEN hit THEN s ELSE subcategory END AS subcategory, CASE WHEN hit THEN a ELSE feature_area END AS feature_area,
 CASE WHEN hit THEN TIMESTAMP '2024-05-05' ELSE last_updated END AS last_updated, CASE WHEN hit THEN 'user' ELSE updated_by END AS updated_by FROM st FULL JOIN ce USING (feedback_id)) SELECT {SHOWN_SQL} FROM q""")
def category_edits_states(spark, folder):
    at = F.lit("2024-05-05").cast("timestamp")
    _, new = state.apply_category_edits(stored(spark, folder), states(spark, folder), category_edits(spark, folder), at)
    return _shown(new)


@query("change_validation", f"""WITH {CHANGES_SQL} SELECT CASE WHEN feedback_id = '' THEN 'missing feedback_id' WHEN state = 'BOGUS' THEN 'unknown state'
 WHEN domain <> '' AND domain NOT IN ('Dom0', 'Dom1', 'Dom2') THEN 'unknown domain' END AS reason, count(*) AS n
 FROM (SELECT * REPLACE (CASE WHEN ord % 13 = 0 THEN 'BOGUS' ELSE state END AS state) FROM chg) GROUP BY 1""")
def change_validation(spark, folder):
    log = changes(spark, folder).withColumn("state", F.when(F.col("ord") % 13 == 0, "BOGUS").otherwise(F.col("state")))
    return state.check_changes(log, ["Dom0", "Dom1", "Dom2"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("initial_states", f"""WITH {STORED_SQL} SELECT feedback_id, coalesce(state, 'NEW') AS state, CASE WHEN state IS NULL THEN '' ELSE notes END AS notes,
 CASE WHEN state IS NULL THEN 'System' ELSE updated_by END AS updated_by FROM fd""")
def initial_states(spark, folder):
    return state.initial_states(stored(spark, folder), F.lit("2024-01-01").cast("timestamp")).select(
        "feedback_id", "state", "notes", "updated_by")


@query("domain_query", f"WITH {STATES_SQL} SELECT feedback_id, state, primary_domain FROM st WHERE contains(primary_domain, 'Login') OR contains(primary_domain, 'LOGIN')")
def domain_query(spark, folder):
    return state.in_domain(states(spark, folder), "Login", "LOGIN").select("feedback_id", "state", "primary_domain")


@query("fetch_state", f"WITH {STATES_SQL} SELECT {SHOWN_SQL} FROM st WHERE feedback_id = 'f4'")
def fetch_state(spark, folder):
    return _shown(state.fetch_state(states(spark, folder), "f4"))


def _with_flags(spark, folder):
    flags = read_table(spark, folder, "labels").select("doc_id", (F.col("quality") == 0).alias("user_modified"))
    return feedback(spark, folder).join(flags, "doc_id", "left")


FRESH = ["category", "enhanced_category", "subcategory", "audience", "priority", "feature_area", "confidence", "primary_domain"]


@query("recategorize_preserving", f"""WITH {FEEDBACK_SQL}, {STATES_SQL}, tt AS (SELECT * REPLACE (title || chr(10) || chr(10) || feedback AS feedback) FROM fb),
{classification_sql('tt')}, fl AS (SELECT doc_id FROM labels WHERE quality = 0)
SELECT doc_id, coalesce(nullif(st.category, ''), cl.category) AS category, enhanced_category, coalesce(nullif(st.subcategory, ''), cl.subcategory) AS subcategory, audience, priority,
 coalesce(nullif(st.feature_area, ''), cl.feature_area) AS feature_area, confidence, coalesce(nullif(st.primary_domain, ''), cl.primary_domain) AS primary_domain,
 coalesce(nullif(st.category, ''), nullif(st.subcategory, ''), nullif(st.feature_area, ''), nullif(st.primary_domain, '')) IS NOT NULL AS overrides_kept
FROM cl LEFT JOIN st ON st.feedback_id = 'f' || doc_id WHERE doc_id NOT IN (SELECT doc_id FROM fl)""")
def recategorize_preserving(spark, folder):
    return recategorize.recategorize_preserving(
        _with_flags(spark, folder), states(spark, folder), TAXONOMY, F.lit("2024-06-01").cast("timestamp")).select(
        "doc_id", *FRESH, "overrides_kept")


@query("recategorize_skip_curated", f"""WITH {FEEDBACK_SQL}, {classification_sql()}
SELECT doc_id, CASE WHEN quality = 0 THEN 'kept' ELSE enhanced_category END AS enhanced_category, CASE WHEN quality = 0 THEN 'kept' ELSE subcategory END AS subcategory,
 CASE WHEN quality = 0 THEN 'kept' ELSE impact_type END AS impact_type, CASE WHEN quality = 0 THEN 0 ELSE confidence END AS confidence, quality IS DISTINCT FROM 0 AS renewed
FROM cl LEFT JOIN labels USING (doc_id)""")
def recategorize_skip_curated(spark, folder):
    rows = _with_flags(spark, folder).withColumns({
        **{c: F.lit("kept") for c in recategorize.AUTO_FIELDS if c != "confidence"}, "confidence": F.lit(0.0),
        "recategorized_at": F.lit(None).cast("timestamp")})
    out = recategorize.recategorize_all(rows, TAXONOMY, F.lit("2024-06-01").cast("timestamp"))
    return out.select("doc_id", "enhanced_category", "subcategory", "impact_type", "confidence",
                      F.col("recategorized_at").isNotNull().alias("renewed"))


@query("recategorize_counters", f"""WITH {FEEDBACK_SQL} SELECT count(*) FILTER (WHERE quality IS DISTINCT FROM 0) AS recategorized, count(*) FILTER (WHERE quality = 0) AS skipped_user_modified,
 count(*) AS total_processed FROM fb LEFT JOIN labels USING (doc_id)""")
def recategorize_counters(spark, folder):
    return recategorize.skip_counters(_with_flags(spark, folder))


@query("table_write_back", f"""WITH {NET_SQL}, {STORED_SQL} SELECT feedback_id, coalesce(net.state, fd.state) AS state, coalesce(net.notes, fd.notes) AS notes,
 coalesce(net.domain, fd.primary_domain) AS primary_domain, coalesce(net.updated_by, fd.updated_by) AS updated_by FROM fd LEFT JOIN net USING (feedback_id)""")
def table_write_back(spark, folder):
    return state.write_back(stored(spark, folder), changes(spark, folder)).select(
        "feedback_id", "state", "notes", "primary_domain", "updated_by")


@query("state_lookup", f"""WITH {CHANGES_SQL}, n AS (SELECT * REPLACE (CASE WHEN ord % 13 = 0 THEN 'BOGUS' ELSE state END AS state) FROM chg)
SELECT state, CASE state WHEN 'NEW' THEN 'New' WHEN 'TRIAGED' THEN 'Triaged' WHEN 'CLOSED' THEN 'Closed' WHEN 'IRRELEVANT' THEN 'Irrelevant' END AS state_name, count(*) AS n FROM n GROUP BY 1""")
def state_lookup(spark, folder):
    log = changes(spark, folder).withColumn("state", F.when(F.col("ord") % 13 == 0, "BOGUS").otherwise(F.col("state")))
    return state.with_state_info(log).groupBy("state", "state_name").agg(F.count(F.lit(1)).alias("n"))


@query("domain_names", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Login' WHEN 1 THEN 'Looks' WHEN 2 THEN 'Rules' WHEN 3 THEN 'First Steps' WHEN 4 THEN 'OTHER' END AS name FROM documents""")
def domain_names(spark, folder):
    codes = F.array(*[F.lit(c) for c in ("LOGIN", "LOOKS", "RULES", "START", "OTHER")])
    code = F.get(codes, (F.col("doc_id") % 6).cast("int"))
    return read_table(spark, folder, "documents").select("doc_id", state.domain_name(code, TAXONOMY).alias("name"))
