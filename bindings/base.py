"""The driver tables seen as feedback, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.fixture import (
    AUDIENCES, CATEGORIES, DOMAINS, IMPACTS, LEGACY, ORGANIZATIONS, RULES, SCENARIOS, SOURCES, TAXONOMY)
from bindings.registry import sql_list, sql_values
from vocspark.functions.classify import classify
from vocspark.sources.tables import read_table, spread_small
from vocspark.taxonomy import literal_strings


def pick(values, number) -> F.Column:
    return F.get(literal_strings(values), (number % len(values)).cast("int"))


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as collected feedback."""
    d = read_table(spark, folder, "documents").select("doc_id", "text")
    n = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int"))
    rows = d.select(
        n, F.concat(F.lit("f"), n.cast("string")).alias("feedback_id"), F.col("text").alias("feedback"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        pick(SOURCES, n).alias("source"), pick(SCENARIOS, n).alias("scenario"),
        pick(ORGANIZATIONS, n).alias("organization"), F.concat(F.lit("user"), (n % 97).cast("string")).alias("customer"),
        F.concat(day.cast("string"), F.lit("T08:00:00")).alias("created"), day.cast("timestamp").alias("created_ts"))
    return spread_small(rows)


FEEDBACK_SQL = f"""fb AS (SELECT doc_id, 'f' || doc_id AS feedback_id, text AS feedback, split_part(text, chr(10), 1) AS title,
  ({sql_list(SOURCES)})[doc_id % 6 + 1] AS source, ({sql_list(SCENARIOS)})[doc_id % 4 + 1] AS scenario,
  ({sql_list(ORGANIZATIONS)})[doc_id % 5 + 1] AS organization, 'user' || (doc_id % 97) AS customer,
  CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) || 'T08:00:00' AS created,
  CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS TIMESTAMP) AS created_ts
  FROM documents)"""


def classified(spark: SparkSession, folder: str) -> DataFrame:
    return classify(feedback(spark, folder), TAXONOMY)


def _group_rows(tree):
    return [(i, key, body["name"], kw) for i, (key, body) in enumerate(tree.items()) for kw in body["keywords"]]


def _sub_rows():
    rows = []
    for cat in CATEGORIES.values():
        for sub in cat["subcategories"].values():
            number = len({r[0] for r in rows})
            rows += [(number, cat["name"], sub["name"], cat["audience"], sub["priority"], sub["feature_area"], kw)
                     for kw in sub["keywords"]]
    return rows


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def in_list(text: str, words) -> str:
    return f"list_contains({sql_list(words)}, {text})"


KEYWORD_TABLES = f"""sub_kw(ord, cat, sub, aud, pri, area, kw) AS ({sql_values(_sub_rows())}),
imp_kw(ord, id, name, kw) AS ({sql_values(_group_rows(IMPACTS))}),
dom_kw(ord, id, name, kw) AS ({sql_values(_group_rows(DOMAINS))}),
leg_kw(ord, id, name, kw) AS ({sql_values(_group_rows(LEGACY))}),
aud_kw(aud, kw) AS ({sql_values([(a, k) for a, ks in AUDIENCES.items() for k in ks])})"""


def classification_sql(source: str = "fb", text: str = "feedback") -> str:
    """CTEs that end in ``cl``: one row per doc_id of ``source`` with its classes."""
    r = RULES
    return f"""{KEYWORD_TABLES},
tx AS (SELECT doc_id, lower(coalesce({text}, '')) AS t, lower(source) AS s, lower(scenario) AS c, lower(organization) AS o FROM {source}),
ah AS (SELECT doc_id, count(*) FILTER (WHERE aud = 'Developer' AND contains(t, lower(kw))) AS d,
  count(*) FILTER (WHERE aud = 'Customer' AND contains(t, lower(kw))) AS u,
  count(*) FILTER (WHERE aud = 'ISV' AND contains(t, lower(kw))) AS i FROM tx, aud_kw GROUP BY doc_id),
votes AS (SELECT tx.*,
  d + CASE WHEN {any_of('t', r.portal_terms)} THEN 5 ELSE 0 END + CASE WHEN {in_list('s', r.developer_sources)} THEN 3 ELSE 0 END
    + CASE WHEN c = 'partner' AND NOT {any_of('t', r.partner_terms)} THEN 2 WHEN c = 'internal' THEN 2 ELSE 0 END
    + CASE WHEN {any_of('o', r.vendor_orgs)} THEN 0 WHEN {any_of('o', r.developer_orgs)} THEN 2 ELSE 0 END AS dev,
  u + CASE WHEN {in_list('s', r.developer_sources)} THEN 0 WHEN {in_list('s', r.customer_sources)} THEN 1
      WHEN {in_list('s', r.mixed_sources)} THEN 0.5 ELSE 0 END + CASE WHEN c = 'customer' THEN 2 ELSE 0 END AS cus,
  i + CASE WHEN c = 'partner' AND {any_of('t', r.partner_terms)} THEN 3 ELSE 0 END
    + CASE WHEN {any_of('o', r.vendor_orgs)} THEN 2 ELSE 0 END + CASE WHEN {any_of('t', r.saas_terms)} THEN 3 ELSE 0 END AS isv
  FROM tx JOIN ah USING (doc_id)),
au AS (SELECT *, CASE WHEN greatest(dev, cus, isv) = 0 THEN 'Customer' WHEN dev >= cus AND dev >= isv THEN 'Developer'
  WHEN cus >= isv THEN 'Customer' ELSE 'ISV' END AS audience FROM votes),
sh AS (SELECT doc_id, ord, cat, sub, aud, pri, area, count(*) AS n, count(*) FILTER (WHERE contains(t, lower(kw))) AS h
  FROM tx, sub_kw GROUP BY ALL),
sb AS (SELECT sh.*, h + CASE WHEN aud IN (audience, 'All') THEN 2 ELSE 0 END
    + CASE WHEN (audience = 'Developer' AND {in_list('s', r.developer_bonus_sources)})
             OR (audience = 'Customer' AND {in_list('s', r.customer_bonus_sources)}) THEN 1 ELSE 0 END AS score
  FROM sh JOIN au USING (doc_id)),
bs AS (SELECT * FROM sb QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1),
im AS (SELECT doc_id, id, ord, count(*) FILTER (WHERE contains(t, lower(kw))) AS h FROM tx, imp_kw GROUP BY ALL),
bi AS (SELECT doc_id, CASE WHEN h > 0 THEN id ELSE 'FEEDBACK' END AS impact_type FROM im
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, ord) = 1),
lg AS (SELECT doc_id, arg_min(name, ord) AS category FROM tx, leg_kw WHERE contains(t, lower(kw)) GROUP BY doc_id),
dm AS (SELECT doc_id, ord, id, name, count(*) AS n, count(*) FILTER (WHERE contains(t, lower(kw))) AS h,
  string_agg(kw, ',' ORDER BY list_position({sql_list([k for b in DOMAINS.values() for k in b['keywords']])}, kw))
    FILTER (WHERE contains(t, lower(kw))) AS kws FROM tx, dom_kw GROUP BY ALL),
df AS (SELECT *, CAST(round(CAST(h / n AS DECIMAL(18, 10)), 2) AS DOUBLE) AS conf FROM dm WHERE h > 0),
dp AS (SELECT doc_id, string_agg(name || ':' || CAST(round(conf * 100) AS INTEGER) || ':' || h || ':' || kws, '|' ORDER BY conf DESC, ord) AS domains,
  arg_min(name, (-conf, ord)) AS primary_domain FROM df GROUP BY doc_id),
cl AS (SELECT doc_id, coalesce(category, 'Other / Uncategorized') AS category,
  CASE WHEN score > 0 THEN cat ELSE 'Other' END AS enhanced_category, CASE WHEN score > 0 THEN sub ELSE 'Uncategorized' END AS subcategory,
  audience, CASE WHEN score > 0 THEN pri ELSE 'medium' END AS priority, CASE WHEN score > 0 THEN area ELSE 'General' END AS feature_area,
  impact_type, CASE WHEN score > 0 THEN CAST(round(CAST((least(h / greatest(n * 0.2, 1), 1) + 0.5) / 2 AS DECIMAL(18, 10)), 2) AS DOUBLE) ELSE 0 END AS confidence,
  coalesce(domains, '') AS domains, primary_domain
  FROM au JOIN bs USING (doc_id) JOIN bi USING (doc_id) LEFT JOIN lg USING (doc_id) LEFT JOIN dp USING (doc_id))"""


def classified_sql(tail: str) -> str:
    """SQL over ``v``: the feedback columns next to their classes."""
    return f"""WITH {FEEDBACK_SQL}, {classification_sql()},
v AS (SELECT fb.*, cl.* EXCLUDE (doc_id) FROM fb JOIN cl USING (doc_id)) {tail}"""
