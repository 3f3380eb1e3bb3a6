"""Sentiment from a lexicon that is a table of any size.

The rule and the results are those of :func:`vocspark.functions.sentiment.sentiment`, which keeps a small lexicon inside the plan.  Here the words of a
text become narrow rows, each with the factor of the word before it, so negators and boosters need no order later on.  Equal words of a
text are added up before they move; the words then meet the lexicon in a join that deals frequent words over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.common import col
from vocspark.functions.sentiment import NEGATION, sentiment_confidence, sentiment_label
from vocspark.functions.text import words
from vocspark.operators.spread_join import SHARE, spread_join
from vocspark.session import scratch_path
from vocspark.taxonomy import literal_strings


@dataclass(frozen=True)
class LexiconTable:
    """``entries`` has the columns word, polarity (−1…1) and subjectivity (0…1).

    Words count in lower case; null words and null values are left out, and of several entries for a word the one with the largest (polarity, subjectivity) holds.
    Negators and boosters are short lists and stay in the plan.
    """

    entries: DataFrame
    negators: tuple[str, ...] = ("not", "no", "never")
    boosters: Mapping[str, float] = field(default_factory=dict)

    def table(self) -> DataFrame:
        """(word, p, s) with whole thousandths, one row a word."""
        kept = self.entries.select(F.lower("word").alias("word"), "polarity", "subjectivity").dropna()
        # Maxima of numbers are kept in a hash table; that of a struct would sort every entry.
        each = kept.groupBy("word", "polarity").agg(F.max("subjectivity").alias("subjectivity"))
        best = each.groupBy("word").agg(F.max("polarity").alias("p"), F.max_by("subjectivity", "polarity").alias("s"))
        return best.select("word", F.rint(F.col("p") * 1000).cast("long").alias("p"), F.rint(F.col("s") * 1000).cast("long").alias("s"))

    def factor(self, previous: Column) -> Column:
        """What the word before a lexicon word does to its polarity, in hundredths."""
        factor = F.lit(100)
        for word, scale in self.boosters.items():
            factor = F.when(previous == word, round(scale * 100)).otherwise(factor)
        return F.when(F.coalesce(F.array_contains(literal_strings(self.negators), previous), F.lit(False)), round(NEGATION * 100)).otherwise(factor)


def word_factors(df: DataFrame, key: str, text: Column | str, lexicon: LexiconTable) -> DataFrame:
    """(key, word, factor, n): the distinct words of every text, factors and occurrences added up."""
    listed = df.select(F.col(key).alias("key"), F.explode(F.array(words(text))).alias("words"))
    before = F.concat(F.array(F.lit("")), "words")
    paired = listed.select("key", F.explode(F.arrays_zip(F.col("words").alias("word"), before.alias("before"))).alias("t"))
    kept = paired.filter(F.col("t.word").isNotNull())
    return kept.groupBy("key", F.col("t.word").alias("word")).agg(
        F.sum(lexicon.factor(F.col("t.before"))).alias("factor"), F.count(F.lit(1)).alias("n"))


def sentiment_by_table(df: DataFrame, key: str, text: Column | str, lexicon: LexiconTable, share: int = SHARE) -> DataFrame:
    """(key, sentiment_score, subjectivity, sentiment, sentiment_confidence), one row for every row of ``df``.

    ``key`` must be unique and not null.  Texts that are null, empty or without a lexicon word score 0.  The word rows are written once to the shared folder,
    because they are counted before they are joined.
    """
    spark, place = df.sparkSession, scratch_path(df.sparkSession, "lexicon-words")
    word_factors(df, key, col(text), lexicon).write.parquet(place)
    rows = spark.read.parquet(place)
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = spread_join(rows, lexicon.table(), "word", counts, "key", share).groupBy("key").agg(
        F.sum(F.col("p") * F.col("factor")).alias("p"), F.sum(F.col("s") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    scored = df.select(F.col(key).alias("key")).join(found, "key", "left")
    score = F.coalesce(F.round(F.col("p") / (F.col("n") * 100), 0) / 1000, F.lit(0.0))
    bounded = F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0))
    return scored.select(
        F.col("key").alias(key), bounded.alias("sentiment_score"),
        F.coalesce(F.round(F.col("s") / F.col("n"), 0) / 1000, F.lit(0.0)).alias("subjectivity")).withColumns({
            "sentiment": sentiment_label("sentiment_score"), "sentiment_confidence": sentiment_confidence("sentiment_score")})
