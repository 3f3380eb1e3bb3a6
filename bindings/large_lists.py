"""Keyword and sentiment lists that are tables: all of them come from the words of the documents, so they grow with the data."""

from pyspark.sql import functions as F

from bindings.base import feedback
from bindings.fixture import LEXICON
from bindings.registry import query
from bindings.text import _tables_for_sentiment
from vocspark.functions.text import words
from vocspark.operators import keyword_join as K
from vocspark.operators.lexicon_join import LexiconTable, sentiment_by_table
from vocspark.session import scratch_path

# Keywords are six code points from inside a longer word, so that most of them stand in words of other documents too.
KEYWORD_PAIRS_SQL = r"""WITH tx AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text <> ''),
kw AS (SELECT DISTINCT substring(w, 2, 6) AS keyword FROM (SELECT unnest(string_split(regexp_replace(t, '[^\p{L}]+', ' ', 'g'), ' ')) AS w FROM tx) WHERE length(w) >= 8),
ch AS (SELECT doc_id, string_split(t, '') AS c FROM tx),
sl AS (SELECT doc_id, unnest(c) AS a, unnest(c[2:]) AS b, unnest(c[3:]) AS d, unnest(c[4:]) AS e, unnest(c[5:]) AS f, unnest(c[6:]) AS h FROM ch),
gr AS (SELECT DISTINCT doc_id, a || b || d || e || f || h AS g FROM sl),
pr AS (SELECT doc_id, keyword FROM gr JOIN kw ON g = keyword)"""


def large_keywords(spark, folder):
    """The keyword table, written once because it is read several times."""
    place = scratch_path(spark, "keywords")
    split = F.split(F.regexp_replace(F.lower("feedback"), r"[^\p{L}]+", " "), " ")
    found = feedback(spark, folder).select(F.explode(split).alias("w")).filter(F.length("w") >= 8)
    found.select(F.substring("w", 2, 6).alias("keyword")).distinct().write.parquet(place)
    return spark.read.parquet(place)


@query("keyword_join", f"""{KEYWORD_PAIRS_SQL}, dc AS (SELECT doc_id, count(*) AS n_keywords, min(keyword) AS first_keyword, max(keyword) AS last_keyword FROM pr GROUP BY 1)
SELECT doc_id, coalesce(n_keywords, 0) AS n_keywords, first_keyword, last_keyword FROM documents LEFT JOIN dc USING (doc_id)""")
def keyword_join(spark, folder):
    """How many keywords of a list as large as the vocabulary every document contains."""
    docs = feedback(spark, folder).select("doc_id", "feedback")
    pairs = K.keyword_pairs(docs, "doc_id", "feedback", large_keywords(spark, folder))
    counts = pairs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_keywords"), F.min("keyword").alias("first_keyword"), F.max("keyword").alias("last_keyword"))
    return docs.select("doc_id").join(counts, "doc_id", "left").withColumn("n_keywords", F.coalesce("n_keywords", F.lit(0).cast("long")))


@query("keyword_join_groups", f"""{KEYWORD_PAIRS_SQL}, hs AS (SELECT doc_id, right(keyword, 1) AS group_name, count(*) AS hits FROM pr GROUP BY ALL)
SELECT doc_id, group_name, hits FROM hs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, unicode(group_name)) = 1""")
def keyword_join_groups(spark, folder):
    """The large list as a taxonomy, a group for each last letter: the group of which a document contains most keywords."""
    keywords = large_keywords(spark, folder)
    last = F.right("keyword", F.lit(1))
    listed, sets = K.numbered_groups(keywords.select("keyword", last.alias("group"), F.ascii(last).alias("ord")))
    pairs = K.keyword_pairs(feedback(spark, folder).select("doc_id", "feedback"), "doc_id", "feedback", listed, carry="set", named=False)
    best = K.best_groups(pairs, "doc_id", sets)
    return best.withColumnRenamed("group", "group_name")


@query("sentiment_table", f"""WITH {_tables_for_sentiment()},
tk AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS l FROM documents),
ps AS (SELECT doc_id, unnest(l) AS w, unnest(list_concat([NULL], l)[1:length(l)]) AS prev FROM tk),
big AS (SELECT DISTINCT w, (length(w) * 37 + unicode(w) * 11) % 2001 - 1000 AS p, length(w) * 83 % 1001 AS s FROM ps WHERE unicode(w) % 3 <> 0),
sc AS (SELECT ps.doc_id, CAST(sum(big.p * CASE WHEN prev IN {tuple(LEXICON.negators)} THEN -50 ELSE coalesce(bst.f, 100) END) AS BIGINT) AS p,
 CAST(sum(big.s) AS BIGINT) AS s, count(*) AS n FROM ps JOIN big ON big.w = ps.w LEFT JOIN bst ON bst.w = ps.prev GROUP BY 1),
rs AS (SELECT doc_id, greatest(least(coalesce(round(p / (n * 100)) / 1000, 0.0), 1.0), -1.0) AS score, coalesce(round(s / n) / 1000, 0.0) AS subj
 FROM documents LEFT JOIN sc USING (doc_id))
SELECT doc_id, score AS sentiment_score, subj AS subjectivity, CASE WHEN score > 0.1 THEN 'Positive' WHEN score < -0.1 THEN 'Negative' ELSE 'Neutral' END AS sentiment,
 CASE WHEN abs(score) >= 0.5 THEN 'High' WHEN abs(score) >= 0.2 THEN 'Medium' ELSE 'Low' END AS sentiment_confidence FROM rs""")
def sentiment_table(spark, folder):
    """Sentiment from a lexicon that holds two thirds of all words of the documents."""
    docs = feedback(spark, folder).select("doc_id", "feedback")
    length, first = F.length("word"), F.ascii("word")
    entries = docs.select(F.explode(words("feedback")).alias("word")).filter(first % 3 != 0).distinct().select(
        "word", (((length * 37 + first * 11) % 2001 - 1000) / 1000).alias("polarity"), ((length * 83 % 1001) / 1000).alias("subjectivity"))
    return sentiment_by_table(docs, "doc_id", "feedback", LexiconTable(entries, LEXICON.negators, LEXICON.boosters))
