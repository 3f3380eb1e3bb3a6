"""Human triage: change logs, upserts, overlays, edits and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.functions.common import blank_to_null
from vocspark.schema import DEFAULT_STATE, STATE_DESCRIPTIONS, STATES, SYSTEM_ACTOR
from vocspark.taxonomy import Taxonomy, constant

UNKNOWN_ACTOR = "unknown_user"
SHARED_FIELDS = ["primary_domain", "category", "subcategory", "feature_area"]
STATE_ONLY_FIELDS = ["state", "notes"]
FEEDBACK_ONLY_FIELDS = ["audience"]
EDITABLE_FIELDS = SHARED_FIELDS + STATE_ONLY_FIELDS + FEEDBACK_ONLY_FIELDS
AUDIENCES = ("Developer", "Customer")


def _last_supplied(column: str, order_col: str) -> Column:
    """Last non-null value in order; combines before the shuffle, unlike a window."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order_col)))


def collapse_changes(changes: DataFrame, order_col: str = "ord", actor: str | None = None) -> DataFrame:
    """One row per feedback_id with the net effect of its changes in order.

    Null means "not supplied".  Rows without an id are dropped.  The actor is that of the last
    change, or ``actor`` when the session knows who is working.
    """
    who = F.lit(actor) if actor else F.coalesce(blank_to_null("updated_by"), F.lit(UNKNOWN_ACTOR))
    return (changes.filter(blank_to_null("feedback_id").isNotNull())
            .withColumn("_who", who).groupBy("feedback_id").agg(
                _last_supplied("state", order_col).alias("state"),
                _last_supplied("notes", order_col).alias("notes"),
                _last_supplied("domain", order_col).alias("domain"),
                F.max_by("_who", order_col).alias("updated_by"),
                F.max_by("at", order_col).alias("last_updated")))


def upsert_states(current: DataFrame, changes: DataFrame, order_col: str = "ord",
                  actor: str | None = None) -> DataFrame:
    """State table after the changes: supplied values replace, missing rows start in the default state."""
    c = collapse_changes(changes, order_col, actor).alias("c")
    s = current.alias("s")
    return s.join(c, "feedback_id", "full_outer").select(
        "feedback_id",
        F.coalesce("c.state", F.when(F.col("s.feedback_id").isNull(), F.lit(DEFAULT_STATE)).otherwise(F.col("s.state"))).alias("state"),
        F.coalesce("c.notes", "s.notes").alias("notes"),
        F.coalesce("c.domain", "s.primary_domain").alias("primary_domain"),
        "s.category", "s.subcategory", "s.feature_area",
        F.coalesce("c.last_updated", "s.last_updated").alias("last_updated"),
        F.coalesce("c.updated_by", "s.updated_by").alias("updated_by"))


def write_domains_through(feedback: DataFrame, changes: DataFrame, order_col: str = "ord") -> DataFrame:
    """Set the domain of a changed item on the feedback table too; blank domains change nothing."""
    last = (changes.filter(blank_to_null("feedback_id").isNotNull() & blank_to_null("domain").isNotNull())
            .groupBy("feedback_id").agg(F.max_by("domain", order_col).alias("_domain")))
    return (feedback.join(last, "feedback_id", "left")
            .withColumn("primary_domain", F.coalesce("_domain", "primary_domain")).drop("_domain"))


def write_back(table: DataFrame, changes: DataFrame, order_col: str = "ord", actor: str | None = None) -> DataFrame:
    """A feedback table that carries its own state columns, after the changes.

    Only rows already in the table change; one join serves any number of changes.
    """
    net = collapse_changes(changes, order_col, actor)
    net = net.select("feedback_id", *[F.col(c).alias(f"c_{c}") for c in net.columns if c != "feedback_id"])
    pairs = {"state": "c_state", "notes": "c_notes", "primary_domain": "c_domain", "updated_by": "c_updated_by",
             "last_updated": "c_last_updated"}
    joined = table.join(net, "feedback_id", "left")
    return joined.withColumns({c: F.coalesce(new, c) for c, new in pairs.items()}).drop(*pairs.values())


def with_state_info(df: DataFrame, column: str = "state") -> DataFrame:
    """Display name, description and default flag of the state; an unknown state has none."""
    entry = F.get(F.filter(constant([
        {"key": k, "name": n, "text": STATE_DESCRIPTIONS[k], "is_default": k == DEFAULT_STATE} for k, n in STATES.items()]),
        lambda e: e["key"] == F.col(column)), F.lit(0))
    return df.withColumns({"state_name": entry["name"], "state_description": entry["text"],
                           "state_is_default": entry["is_default"]})


def domain_name(code: Column | str, tax: Taxonomy) -> Column:
    """Display name of a domain code; text that is no code stays as it is."""
    code = F.col(code) if isinstance(code, str) else code
    table = constant([{"id": g.id, "name": g.name} for g in tax.domains])
    return F.coalesce(F.get(F.filter(table, lambda d: d["id"] == code), F.lit(0))["name"], code)


def states_with_fallback(states: DataFrame, feedback: DataFrame, keep_blank_ids: bool = False) -> DataFrame:
    """State rows; classification left open there is taken from the feedback row."""
    f = feedback.select("feedback_id", *[F.col(c).alias(f"f_{c}") for c in SHARED_FIELDS])
    rows = states if keep_blank_ids else states.filter(F.trim("feedback_id") != "")
    return rows.join(f, "feedback_id", "left").select(
        "feedback_id", "state", "notes",
        *[F.coalesce(c, f"f_{c}").alias(c) for c in SHARED_FIELDS], "last_updated", "updated_by")


def newest_states_first(states: DataFrame) -> DataFrame:
    return states.orderBy(F.col("last_updated").desc_nulls_last(), F.col("feedback_id").asc())


def overlay_states(feedback: DataFrame, states: DataFrame) -> DataFrame:
    """Feedback with every filled state value laid over its own."""
    text = ["state", "primary_domain", "notes", "updated_by"]
    s = states.select("feedback_id", *[F.col(c).alias(f"s_{c}") for c in [*text, "last_updated"]])
    joined = feedback.join(s, "feedback_id", "left")
    values = {c: F.coalesce(blank_to_null(f"s_{c}"), F.col(c)) for c in text}
    values["last_updated"] = F.coalesce("s_last_updated", "last_updated")
    return joined.withColumns(values).drop(*[f"s_{c}" for c in [*text, "last_updated"]])


def sync_domains(feedback: DataFrame, states: DataFrame) -> DataFrame:
    """Copy filled, different state domains to the feedback rows; ``domain_synced`` marks them."""
    s = states.select("feedback_id", blank_to_null("primary_domain").alias("_domain"))
    differs = F.col("_domain").isNotNull() & ~F.col("_domain").eqNullSafe(F.col("primary_domain"))
    return (feedback.join(s, "feedback_id", "left").withColumn("domain_synced", F.coalesce(differs, F.lit(False)))
            .withColumn("primary_domain", F.when(F.col("domain_synced"), F.col("_domain")).otherwise(F.col("primary_domain")))
            .drop("_domain"))


def apply_field_edits(feedback: DataFrame, states: DataFrame, edits: DataFrame,
                      order_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Apply (feedback_id, field, value, at, by) edits, each routed to the table(s) that own the field."""
    known = edits.filter(F.col("field").isin(EDITABLE_FIELDS) & blank_to_null("feedback_id").isNotNull())
    in_states = F.col("field").isin(SHARED_FIELDS + STATE_ONLY_FIELDS)
    when_state = F.when(in_states, F.col(order_col))
    net = known.groupBy("feedback_id").agg(
        *[F.max_by("value", F.when(F.col("field") == f, F.col(order_col))).alias(f"e_{f}") for f in EDITABLE_FIELDS],
        *[F.max(F.col("field") == f).alias(f"t_{f}") for f in EDITABLE_FIELDS],
        F.max_by("at", when_state).alias("e_at"), F.max_by("by", when_state).alias("e_by"),
        F.max(in_states).alias("t_states"))

    def edited(f: str) -> Column:
        return F.when(F.col(f"t_{f}"), F.col(f"e_{f}")).otherwise(F.col(f)).alias(f)

    helper = [c for c in net.columns if c != "feedback_id"]
    new_feedback = feedback.join(net, "feedback_id", "left")
    new_feedback = new_feedback.withColumns(
        {f: edited(f) for f in SHARED_FIELDS + FEEDBACK_ONLY_FIELDS}).drop(*helper)
    new_states = states.join(net.filter("t_states"), "feedback_id", "full_outer").select(
        "feedback_id", *[edited(f) for f in STATE_ONLY_FIELDS + SHARED_FIELDS],
        F.coalesce("e_at", "last_updated").alias("last_updated"), F.coalesce("e_by", "updated_by").alias("updated_by"))
    return new_feedback, new_states


def apply_category_edits(feedback: DataFrame, states: DataFrame, edits: DataFrame, at: Column,
                         by: str = "user", order_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Set category, subcategory and area (blank = none) and mark the item as curated.

    Of several edits of one feedback_id the last by ``order_col`` counts; edits without an id are ignored.
    A null ``domain_code`` leaves the domain alone, a blank one clears it.
    """
    edits = edits.filter(F.col("feedback_id").isNotNull())
    order = F.col(order_col) if order_col in edits.columns else F.lit(0)
    fields = F.struct("category_name", "subcategory_name", "feature_area", "domain_code")
    edits = edits.groupBy("feedback_id").agg(F.max(F.struct(order.alias("o"), F.to_json(fields).alias("tie"), fields.alias("f"))).alias("m")).select(
        "feedback_id", "m.f.*")
    e = edits.select(
        "feedback_id", *[blank_to_null(F.trim(src)).alias(f"e_{dst}") for src, dst in (
            ("category_name", "category"), ("subcategory_name", "subcategory"), ("feature_area", "feature_area"),
            ("domain_code", "primary_domain"))],
        F.col("domain_code").isNotNull().alias("e_has_domain"), F.lit(True).alias("e_hit"))
    helper = [c for c in e.columns if c != "feedback_id"]

    def edited(c: str) -> Column:
        touched = F.col("e_has_domain") if c == "primary_domain" else F.col("e_hit")
        return F.when(touched, F.col(f"e_{c}")).otherwise(F.col(c))

    f = feedback.join(e, "feedback_id", "left")
    f = f.withColumns({
        **{c: edited(c) for c in SHARED_FIELDS},
        "enhanced_category": F.when(F.col("e_hit"), F.col("e_category")).otherwise(F.col("enhanced_category")),
        "user_modified": F.coalesce(F.col("e_hit"), F.col("user_modified"))}).drop(*helper)
    s = states.join(e, "feedback_id", "full_outer").select(
        "feedback_id", "state", "notes", *[edited(c).alias(c) for c in SHARED_FIELDS],
        F.when(F.col("e_hit"), at).otherwise(F.col("last_updated")).alias("last_updated"),
        F.when(F.col("e_hit"), F.lit(by)).otherwise(F.col("updated_by")).alias("updated_by"))
    return f, s


def check_changes(changes: DataFrame, domains: Sequence[str] = ()) -> DataFrame:
    """Add ``reason``: null for an acceptable change, else why it is rejected."""
    reason = F.when(blank_to_null("feedback_id").isNull(), "missing feedback_id")
    reason = reason.when(F.col("state").isNotNull() & ~F.col("state").isin(list(STATES)), "unknown state")
    if domains:
        reason = reason.when(blank_to_null("domain").isNotNull() & ~F.col("domain").isin(list(domains)), "unknown domain")
    if "audience" in changes.columns:
        reason = reason.when(F.col("audience").isNotNull() & ~F.col("audience").isin(*AUDIENCES), "unknown audience")
    return changes.withColumn("reason", reason)


def split_changes(changes: DataFrame, domains: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    checked = check_changes(changes, domains)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def initial_states(df: DataFrame, now: Column) -> DataFrame:
    """Give items without a state the default one; items already in work are left alone."""
    fresh = blank_to_null("state").isNull()
    return df.withColumns({
        "notes": F.when(fresh, F.lit("")).otherwise(F.col("notes")),
        "last_updated": F.when(fresh, now).otherwise(F.col("last_updated")),
        "updated_by": F.when(fresh, F.lit(SYSTEM_ACTOR)).otherwise(F.col("updated_by")),
        "state": F.when(fresh, F.lit(DEFAULT_STATE)).otherwise(F.col("state"))})


def state_history(changes: DataFrame, order_col: str = "ord", slice_unit: str = "hour") -> DataFrame:
    """(feedback_id, old_state, new_state, notes, updated_by, at, next_at), one row per real transition.

    An item with very many changes must not become one task.  Its time line is cut into slices;
    the neighbours of a row are found inside its slice, and only across slice edges from a small
    table with the first and last row of every slice.
    """
    base = (changes.filter(F.col("state").isNotNull())
            .withColumn("_slice", F.date_trunc(slice_unit, "at")))
    base = base.select("feedback_id", "_slice", F.col(order_col).alias("_ord"), "at", "state", "notes", "updated_by")
    moved = _with_previous(base, "state")
    moved = moved.filter(~F.col("_prev").eqNullSafe(F.col("state"))).withColumnRenamed("_prev", "old_state")
    out = _with_next(moved, "at")
    return out.select("feedback_id", "old_state", F.col("state").alias("new_state"), "notes", "updated_by",
                      "at", F.col("_next").alias("next_at"))


def _with_previous(df: DataFrame, column: str) -> DataFrame:
    return _neighbour(df, column, "_prev", forward=False)


def _with_next(df: DataFrame, column: str) -> DataFrame:
    return _neighbour(df, column, "_next", forward=True)


def _neighbour(df: DataFrame, column: str, name: str, forward: bool) -> DataFrame:
    position = F.struct("at", "_ord")
    inside = Window.partitionBy("feedback_id", "_slice").orderBy("at", "_ord")
    across = Window.partitionBy("feedback_id").orderBy("_slice")
    step, pick = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
    edges = (df.groupBy("feedback_id", "_slice").agg(pick(column, position).alias("_edge"))
             .withColumn("_outside", step("_edge").over(across)).drop("_edge"))
    near = df.withColumn("_near", step(column).over(inside)).withColumn(
        "_at_edge", step(F.lit(1)).over(inside).isNull())
    # Changes without a time or an id have a slice of their own, first in order; a plain equality would lose them.
    edges = edges.select(F.col("feedback_id").alias("_edge_id"), F.col("_slice").alias("_edge_slice"), "_outside")
    same = F.col("feedback_id").eqNullSafe(F.col("_edge_id")) & F.col("_slice").eqNullSafe(F.col("_edge_slice"))
    return (near.join(edges, same).drop("_edge_id", "_edge_slice")
            .withColumn(name, F.when(F.col("_at_edge"), F.col("_outside")).otherwise(F.col("_near")))
            .drop("_near", "_at_edge", "_outside"))


def fetch_state(states: DataFrame, feedback_id: str) -> DataFrame:
    return states.filter(F.col("feedback_id") == feedback_id)


def in_domain(states: DataFrame, *labels: str) -> DataFrame:
    """State rows whose domain contains one of the labels or codes."""
    hit = F.lit(False)
    for label in labels:
        hit = hit | F.contains(F.col("primary_domain"), F.lit(label))
    return states.filter(hit)
