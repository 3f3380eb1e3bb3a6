"""Text functions: cleaning, identifiers, gist, sentiment, dates, tokens."""

from pyspark.sql import functions as F

from bindings.base import FEEDBACK_SQL, feedback
from bindings.fixture import GIST, LEXICON
from bindings.registry import query, quoted, sql_list, sql_values
from vocspark.functions import actor, classify, common, dates, ids, sentiment, text
from vocspark.functions.gist import CHATTY_OPENINGS, FILLER_WORDS, NO_TITLE_OPENINGS, gist
from vocspark.sinks import tables
from vocspark.sources.tables import read_table, spread_small

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
IN = WS[1:-1]
# The cleaning rules in the form of the linear-time engine: no look-behind, no possessive runs.
# The cleaning patterns of the library in the words of DuckDB's regular expressions.
_MARKUP_SQL = [
    (rf"[a-zA-Z0-9.#\-_,{IN}]*\{{[^}}]*\}}", ""), (r"p\.MsoNormal[^}]*\}?", ""), (r"li\.MsoNormal[^}]*\}?", ""),
    (r"div\.MsoNormal[^}]*\}?", ""), (r"span\.EmailStyle\p{Nd}+[^}]*\}?", ""), (r"\.MsoChpDefault[^}]*\}?", ""),
    (r"div\.WordSection\p{Nd}+[^}]*\}?", ""),
    (rf"(?i)[a-z]+:{WS}*p\.[a-z]+,?{WS}*li\.[a-z]+,?{WS}*div\.[a-z]+{WS}*\{{?", ""),
    (rf"[a-zA-Z]+\.[a-zA-Z]+(?:{WS}*,{WS}*[a-zA-Z]+\.[a-zA-Z]+)*{WS}*\{{?", ""),
    (r"[a-zA-Z\-]+:[^;]{1,50};", ""), (r"margin:[^;]+;?", ""), (r"font-[^;]+;?", ""), (r"color:[^;]+;?", ""),
    (rf"p\.x?_?MsoNormal,?{WS}*li\.x?_?MsoNormal,?{WS}*div\.x?_?MsoNormal", ""),
    (rf"p\.x_MsoNormal,?{WS}*li\.x_MsoN[^,{IN}]*", ""), (rf"[a-zA-Z._]+MsoNormal[^,{IN}]*,?{WS}*", ""),
    (r"&[a-zA-Z0-9#]+;", " "), (r"<[^>]+>", ""), (r"font-family:[^;]+;", ""), (r"font-size:[^;]+;", ""),
    (r"margin:[^;]+;", ""), (r"color:[^;]+;", ""), (rf"[a-zA-Z]+:{WS}*[^;{{}}{IN}]+[;{{}}{IN}]*", ""),
    (r"\{[^}]*\}", ""), (rf"[a-zA-Z]+\.[a-zA-Z]+[,{IN}]*", ""), (rf"[a-zA-Z\-]+:{WS}*[^;]+;", ""), (WS + "+", " ")]
_MAIL_SQL = [
    (rf"(?i)(^|[^\p{{L}}\p{{N}}_])Description:{WS}*", r"\1"), (r"(?is)^(From|To|Sent|Subject|Cc):.*", ""),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email-removed]"), (rf"(?i)\[EXTERNAL\]{WS}*", ""),
    (r"(?is)(Best regards|Thanks|-----Original Message-----).*", ""), (WS + "+", " ")]


def clean_sql(expr):
    for pattern, repl in _MARKUP_SQL:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(repl)}, 'g')"
    expr = f"trim({expr}, ' ')"
    for pattern, repl in _MAIL_SQL:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(repl)}, 'g')"
    return f"trim(regexp_replace(trim({expr}, ' '), '[.,;:!?]{{3,}}', '...', 'g'), ' ')"


@query("clean_text", f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages")
def clean_text(spark, folder):
    return spread_small(read_table(spark, folder, "pages")).select("page_id", text.clean_text("html").alias("cleaned"))


@query("clean_documents", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_documents(spark, folder):
    return feedback(spark, folder).select("doc_id", text.clean_text("feedback").alias("cleaned"))


def norm_sql(expr):
    collapsed = f"trim(regexp_replace(lower({expr}), '{WS}+', ' ', 'g'), ' ')"
    return f"regexp_replace({collapsed}, '[^\\p{{L}}\\p{{N}}_{IN}]', '', 'g')"


def id_sql(title, content, size=None):
    part = norm_sql(content) if size is None else f"left({norm_sql(content)}, {size})"
    digest = f"""sha256(concat_ws('|', nullif({norm_sql(title)}, ''), nullif({part}, ''),
 nullif(lower(source), ''), nullif(lower(customer), ''), nullif(left(created, 10), '')))"""
    return f"regexp_replace(left({digest}, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def _identified(spark, folder, lengths):
    rows = feedback(spark, folder).withColumns({"title": F.lit(""), "content": F.lit(None).cast("string")})
    return rows.select("doc_id", ids.feedback_id_from_record(lengths=lengths).alias("feedback_id"))


@query("feedback_id", f"WITH {FEEDBACK_SQL} SELECT doc_id, {id_sql('feedback', 'feedback')} AS feedback_id FROM fb")
def feedback_id(spark, folder):
    return _identified(spark, folder, ids.WHOLE)


@query("feedback_id_short", f"WITH {FEEDBACK_SQL} SELECT doc_id, {id_sql('left(feedback, 100)', 'feedback', 500)} AS feedback_id FROM fb")
def feedback_id_short(spark, folder):
    return _identified(spark, folder, ids.SHORT)


def signature_sql(title, content):
    return f"regexp_replace(lower({title}), '^{WS}+|{WS}+$', '', 'g') || '|' || regexp_replace(lower({content}), '^{WS}+|{WS}+$', '', 'g')"


@query("content_signature", f"WITH {FEEDBACK_SQL} SELECT doc_id, {signature_sql('title', 'feedback')} AS signature FROM fb")
def content_signature(spark, folder):
    return feedback(spark, folder).select("doc_id", ids.content_signature("title", "feedback").alias("signature"))


@query("content_signature_short", f"""WITH {FEEDBACK_SQL} SELECT doc_id, {signature_sql('left(title, 100)', 'left(feedback, 200)')} AS signature FROM fb""")
def content_signature_short(spark, folder):
    return feedback(spark, folder).select("doc_id", ids.content_signature("title", "feedback", ids.SHORT).alias("signature"))


def _tables_for_sentiment():
    entries = [(w, round(p * 1000), round(s * 1000)) for w, (p, s) in LEXICON.entries.items()]
    boost = [(w, round(f * 100)) for w, f in LEXICON.boosters.items()]
    return f"lex(w, p, s) AS ({sql_values(entries)}), bst(w, f) AS ({sql_values(boost)})"


@query("sentiment", f"""WITH {_tables_for_sentiment()},
tk AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS l FROM documents),
ps AS (SELECT doc_id, unnest(l) AS w, unnest(list_concat([NULL], l)[1:length(l)]) AS prev FROM tk),
sc AS (SELECT ps.doc_id, CAST(sum(lex.p * CASE WHEN prev IN {tuple(LEXICON.negators)} THEN -50 ELSE coalesce(bst.f, 100) END) AS BIGINT) AS p,
 CAST(sum(lex.s) AS BIGINT) AS s, count(*) AS n FROM ps JOIN lex ON lex.w = ps.w LEFT JOIN bst ON bst.w = ps.prev GROUP BY 1),
rs AS (SELECT doc_id, greatest(least(coalesce(round(p / (n * 100)) / 1000, 0.0), 1.0), -1.0) AS score, coalesce(round(s / n) / 1000, 0.0) AS subj
 FROM documents LEFT JOIN sc USING (doc_id))
SELECT doc_id, score AS sentiment_score, subj AS subjectivity, CASE WHEN score > 0.1 THEN 'Positive' WHEN score < -0.1 THEN 'Negative' ELSE 'Neutral' END AS sentiment,
 CASE WHEN abs(score) >= 0.5 THEN 'High' WHEN abs(score) >= 0.2 THEN 'Medium' ELSE 'Low' END AS sentiment_confidence FROM rs""")
def sentiment_scores(spark, folder):
    return feedback(spark, folder).select("doc_id", sentiment.sentiment("feedback", LEXICON).alias("r")).select("doc_id", "r.*")


STRIP = f"'^{WS}+|{WS}+$'"


def _contained(text, words):
    return " + ".join(f"CASE WHEN contains({text}, {quoted(w)}) THEN 1 ELSE 0 END" for w in words)


def _starts(text, openings):
    return "(" + " OR ".join(f"starts_with({text}, {quoted(o)})" for o in openings) + ")"


def _sentence_score():
    """Points of a sentence ``x``: two per keyword of a topic found in the whole text, one per bonus term."""
    topics = " + ".join(f"CASE WHEN list_contains(topics, {quoted(n)}) THEN {_contained('lower(x)', ws)} ELSE 0 END" for n, ws in GIST.groups.items())
    chatty = f"CASE WHEN {_starts('lower(x)', CHATTY_OPENINGS)} THEN 2 ELSE 0 END"
    return f"CASE WHEN length(x) > 150 THEN 0 ELSE 2 * ({topics}) + {_contained('lower(x)', GIST.bonus_terms)} - {chatty} END"


def _titled(words):
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || w[2:]), ' ')"


GIST_SQL = f"""WITH a AS (SELECT doc_id, regexp_replace(text, {STRIP}, '', 'g') AS t FROM documents),
b AS (SELECT doc_id, t, lower(t) AS low, regexp_replace(regexp_extract(t, '^([^.\\n!?]+)[.\\n!?]', 1), {STRIP}, '', 'g') AS head,
 list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'contains(lower(t), {quoted(w)})' for w in ws)} THEN {quoted(n)} END" for n, ws in GIST.groups.items())}], lambda x: x IS NOT NULL) AS topics,
 list_filter(list_transform(string_split_regex(t, '[.!?]+'), lambda x: regexp_replace(x, {STRIP}, '', 'g')), lambda x: length(x) > 10)[1:3] AS sentences,
 string_split(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ') AS tokens FROM a),
c AS (SELECT *, list_transform(sentences, lambda x: {_sentence_score()}) AS scores FROM b),
d AS (SELECT *, list_max(scores) AS top, list_position(scores, list_max(scores)) AS best,
 {' || '.join(f"coalesce((SELECT list(w ORDER BY p) FROM (SELECT w, min(i) AS p FROM (SELECT unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i) WHERE list_contains({sql_list(terms)}, w) GROUP BY w)), [])" for terms in GIST.key_terms)} AS terms,
 list_filter(string_split_regex(t, '{WS}+'), lambda w: length(regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) > 2
  AND NOT list_contains({sql_list(FILLER_WORDS)}, regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_]', '', 'g')))[1:12] AS kept FROM c),
e AS (SELECT *, CASE WHEN len(topics) = 1 THEN {_titled("string_split(replace(topics[1], '-', ' '), ' ')")} || ' - ' || {_titled('terms[1:3]')}
  ELSE {_titled('terms[1:4]')} || ' - ' || array_to_string(list_transform(topics[1:2], lambda n: array_to_string(list_transform(string_split(n, '-'), lambda w: upper(w[1]) || w[2:]), '-')), ' & ') END AS line,
 array_to_string(kept, ' ') AS words FROM d)
SELECT doc_id, CASE WHEN t = '' THEN 'Empty feedback' WHEN length(head) > 10 AND length(head) < 150 AND NOT {_starts('lower(head)', NO_TITLE_OPENINGS)} THEN head
 WHEN top > 0 THEN sentences[best] WHEN len(topics) > 0 AND len(terms) > 0 AND length(line) <= 150 THEN line
 WHEN words <> '' THEN CASE WHEN length(words) > 150 THEN left(words, 147) || '...' ELSE words END
 WHEN length(t) > 150 THEN left(t, 147) || '...' ELSE t END AS gist FROM e"""


@query("gist", GIST_SQL)
def gists(spark, folder):
    return feedback(spark, folder).select("doc_id", gist("feedback", GIST).alias("gist"))


NOISY_SQL = "text || chr(7) || chr(9) || chr(127) || chr(31) || chr(13)"


@query("sanitize_text", rf"SELECT doc_id, regexp_replace({NOISY_SQL}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS clean FROM documents")
def sanitize_text(spark, folder):
    noisy = F.concat("feedback", F.lit("\x07\t\x7f\x1f\r"))
    return text.sanitize_frame(feedback(spark, folder).select("doc_id", noisy.alias("clean")))


@query("nan_to_null", """SELECT event_type, count(*) AS n, count(CASE WHEN event_id % 7 <> 0 THEN value END) AS filled,
 CAST(round(CAST(sum(CASE WHEN event_id % 7 <> 0 THEN CAST(value AS DECIMAL(18, 2)) END) AS DOUBLE), 2) AS DOUBLE) AS total FROM events GROUP BY 1""")
def nan_to_null(spark, folder):
    rows = read_table(spark, folder, "events").withColumn(
        "value", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return text.nan_to_null(rows).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"),
        F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


AS_OF = "2024-06-15 12:30:00"


@query("parse_dates", f"""WITH e AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%m-%d-%Y %I:%M %p') WHEN 1 THEN strftime(ts, '%m-%d-%Y')
  WHEN 2 THEN strftime(ts, '%b %d, %Y %I:%M %p') WHEN 3 THEN 'Yesterday at ' || strftime(ts, '%I:%M %p') WHEN 4 THEN 'today at noon'
  WHEN 5 THEN (event_id % 50) || ' minutes ago' WHEN 6 THEN (event_id % 30) || ' days ago' ELSE 'some day' END AS raw, ts FROM events)
SELECT event_id, raw, strftime(CASE event_id % 8 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('minute', ts)
  WHEN 3 THEN TIMESTAMP '2024-06-14 00:00:00' + (date_trunc('minute', ts) - date_trunc('day', ts)) WHEN 4 THEN TIMESTAMP '2024-06-15 00:00:00'
  WHEN 5 THEN TIMESTAMP '{AS_OF}' - to_minutes(event_id % 50) WHEN 6 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(event_id % 30 AS INTEGER))
  ELSE TIMESTAMP '{AS_OF}' END, '%Y-%m-%d %H:%M:%S') AS parsed FROM e""")
def parse_dates(spark, folder):
    k = F.col("event_id") % 8
    n = F.col("event_id")

    def spelled(fmt):
        return F.date_format("ts", fmt)

    raw = (F.when(k == 0, spelled("MM-dd-yyyy hh:mm a")).when(k == 1, spelled("MM-dd-yyyy"))
           .when(k == 2, spelled("MMM dd, yyyy hh:mm a")).when(k == 3, F.concat(F.lit("Yesterday at "), spelled("hh:mm a")))
           .when(k == 4, "today at noon").when(k == 5, F.concat((n % 50).cast("string"), F.lit(" minutes ago")))
           .when(k == 6, F.concat((n % 30).cast("string"), F.lit(" days ago"))).otherwise("some day"))
    rows = read_table(spark, folder, "events").select("event_id", raw.alias("raw"))
    at = dates.forum_timestamp("raw", F.lit(AS_OF).cast("timestamp"))
    return rows.select("event_id", "raw", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("date_fragments", r"""WITH e AS (SELECT event_id, 'on ' || strftime(ts, '%m-%d-%Y') || '!' AS d, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%I:%M %p') || '.' END AS t FROM events)
SELECT event_id, concat_ws(' ', nullif(trim(regexp_extract(d, '([\d\-]+)', 1)), ''), nullif(trim(regexp_extract(t, '([\d\s:/APMampm]+)', 1)), '')) AS fragment FROM e""")
def date_fragments(spark, folder):
    rows = read_table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("on "), F.date_format("ts", "MM-dd-yyyy"), F.lit("!")).alias("d"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.date_format("ts", "hh:mm a"), F.lit("."))).alias("t"))
    return rows.select("event_id", dates.date_time_fragments("d", "t").alias("fragment"))


@query("created_conversion", """SELECT event_id, strftime(CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S') AS created
 FROM events""")
def created_conversion(spark, folder):
    k = F.col("event_id") % 3
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+02:00"))).otherwise("soon")
    rows = read_table(spark, folder, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.date_format(dates.iso_timestamp("raw"), "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("token_actor", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'u' || user_id || '@x.org' WHEN 1 THEN 'name ' || user_id || 'ü' ELSE 'Unknown User' END AS actor FROM events""")
def token_actor(spark, folder):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 3
    payload = (F.when(k == 0, F.format_string('{"upn":"","email":"u%s@x.org","name":"n"}', u))
               .when(k == 1, F.format_string('{"name":"name %sü"}', u)).otherwise('{"iss":"z"}'))
    encoded = F.rtrim(F.translate(F.base64(F.encode(payload, "UTF-8")), "+/", "-_"), F.lit("="))
    rows = read_table(spark, folder, "events").select("event_id", F.concat(F.lit("Bearer aa."), encoded, F.lit(".bb")).alias("token"))
    return rows.select("event_id", actor.actor_from_token("token").alias("actor"))


@query("keyword_json", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[]' ELSE '["' || lang || '","' || source || '"]' END AS stored, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS n FROM documents""")
def keyword_json(spark, folder):
    rows = read_table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.array("lang", "source")).alias("k"))
    stored = rows.select("doc_id", tables.keywords_to_text("k").alias("stored"))
    return stored.withColumn("n", F.size(tables.keywords_from_text("stored")))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS cut FROM documents")
def truncate_text(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", common.truncate("text", 500).alias("cut"))


@query("priority_weight", """SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '5-LOW' THEN 1 ELSE 2 END AS weight, count(*) AS n
 FROM orders GROUP BY ALL""")
def priority_weight(spark, folder):
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "Critical").when(p == "2-HIGH", "high").when(p == "5-LOW", "LOW").when(p == "3-MEDIUM", "medium").otherwise("?")
    return (read_table(spark, folder, "orders").groupBy("o_orderpriority", classify.priority_weight(name).alias("weight"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("word_tokens", f"""SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ') AS form,
 len(list_distinct(list_intersect(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), ' '), {sql_list(['the', 'une', 'und', 'los', 'that'])}))) AS shared FROM documents""")
def word_tokens(spark, folder):
    rows = feedback(spark, folder).select("doc_id", text.compare_form("feedback").alias("form"))
    known = F.array(*[F.lit(w) for w in ("the", "une", "und", "los", "that")])
    return rows.withColumn("shared", F.size(F.array_intersect(F.split("form", " "), known)).cast("long"))
