"""Lexicon sentiment without a shuffle.

The lexicon sits in the plan as a constant array of small maps, one per hash bucket, so each token
costs one short look-up.  Values are whole thousandths: sums are exact in any order.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.common import col, let
from vocspark.functions.text import words
from vocspark.taxonomy import literal_strings, sql_literal

MAX_LEXICON = 20_000
BUCKETS = 256
# Label and confidence thresholds on the polarity, and the factor of a negation.
LABEL_AT = 0.1
CONFIDENCE_AT = [("High", 0.5), ("Medium", 0.2)]
NEGATION = -0.5


@dataclass(frozen=True)
class Lexicon:
    """``entries``: word → (polarity −1…1, subjectivity 0…1); ``boosters``: word → factor."""

    entries: Mapping[str, tuple[float, float]]
    negators: tuple[str, ...] = ("not", "no", "never")
    boosters: Mapping[str, float] | None = None

    def __post_init__(self) -> None:
        if len(self.entries) > MAX_LEXICON:
            raise ValueError(f"{len(self.entries)} entries exceed the bound of {MAX_LEXICON}")


def lexicon_from_frame(df: DataFrame, **kwargs) -> Lexicon:
    """Lexicon from a table (word, polarity, subjectivity); one row over the bound is an error."""
    rows = df.select("word", "polarity", "subjectivity").limit(MAX_LEXICON + 1).collect()
    return Lexicon({r["word"].lower(): (r["polarity"], r["subjectivity"]) for r in rows}, **kwargs)


DEFAULT_LEXICON = Lexicon(
    entries={
        "good": (0.7, 0.6), "great": (0.8, 0.75), "love": (0.5, 0.6), "useful": (0.3, 0.0),
        "easy": (0.43, 0.83), "fast": (0.2, 0.6), "happy": (0.8, 1.0), "nice": (0.6, 1.0),
        "helpful": (0.4, 0.3), "clear": (0.1, 0.38), "bad": (-0.7, 0.67), "poor": (-0.4, 0.6),
        "slow": (-0.3, 0.4), "broken": (-0.4, 0.4), "terrible": (-1.0, 1.0), "hard": (-0.29, 0.54),
        "annoying": (-0.8, 0.9), "confusing": (-0.3, 0.4), "useless": (-0.5, 0.2), "hate": (-0.8, 0.9),
    },
    boosters={"very": 1.3, "really": 1.2, "extremely": 1.5},
)


def _table(lexicon: Lexicon) -> Column:
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    for word, (polarity, subjectivity) in lexicon.entries.items():
        value = f"struct({round(polarity * 1000)}L AS p, {round(subjectivity * 1000)}L AS s)"
        buckets[zlib.crc32(word.encode()) % BUCKETS].append(f"{sql_literal(word)}, {value}")
    maps = ", ".join(f"cast(map({', '.join(b)}) AS map<string,struct<p:bigint,s:bigint>>)" for b in buckets)
    return F.expr(f"array({maps})")


def sentiment(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Struct (sentiment_score, subjectivity, sentiment, sentiment_confidence).

    The polarity is the mean over lexicon words in the text; a negator right in front of a word
    turns and halves it, a booster scales it; the result stays within −1 and 1.
    """
    table = _table(lexicon)
    negators = literal_strings(lexicon.negators)
    boosters = {w: round(f * 100) for w, f in (lexicon.boosters or {}).items()}
    boost_map = (F.create_map(*[F.lit(x) for kv in boosters.items() for x in kv]) if boosters
                 else F.create_map()).cast("map<string,int>")

    def hits(tokens: Column) -> Column:
        looked_up = F.transform(tokens, lambda w, i: F.struct(
            F.try_element_at(F.get(table, F.pmod(F.crc32(w), F.lit(BUCKETS)).cast("int")), w).alias("e"),
            F.get(tokens, i - 1).alias("prev")))
        return F.transform(F.filter(looked_up, lambda x: x["e"].isNotNull()), lambda x: F.struct(
            (x["e"]["p"] * F.when(F.array_contains(negators, x["prev"]), int(NEGATION * 100)).otherwise(
                F.coalesce(F.try_element_at(boost_map, x["prev"]), F.lit(100)))).alias("p"),
            x["e"]["s"].alias("s")))

    def mean(found: Column, name: str, unit: int) -> Column:
        total = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x[name])
        rounded = F.round(total / (F.size(found) * F.lit(unit)), 0) / 1000
        return F.when(F.size(found) > 0, rounded).otherwise(F.lit(0.0))

    scored = let(words(text), lambda tk: let(hits(tk), lambda found: F.struct(
        F.greatest(F.least(mean(found, "p", 100), F.lit(1.0)), F.lit(-1.0)).alias("p"),
        mean(found, "s", 1).alias("s"))))
    return let(scored, lambda r: F.struct(
        r["p"].alias("sentiment_score"), r["s"].alias("subjectivity"),
        sentiment_label(r["p"]).alias("sentiment"), sentiment_confidence(r["p"]).alias("sentiment_confidence")))


def sentiment_label(polarity: Column | str) -> Column:
    p = col(polarity)
    return F.when(p > LABEL_AT, "Positive").when(p < -LABEL_AT, "Negative").otherwise("Neutral")


def sentiment_confidence(polarity: Column | str) -> Column:
    size = F.abs(col(polarity))
    return F.coalesce(*[F.when(size >= at, F.lit(name)) for name, at in CONFIDENCE_AT], F.lit("Low"))


SENTIMENT_COLUMNS = ["sentiment", "sentiment_score", "sentiment_confidence"]


def with_sentiment(df: DataFrame, text: Column | str = "feedback", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Add the sentiment columns; rows that already carry a score keep theirs."""
    staged = df.withColumn("_sent", sentiment(text, lexicon))
    keep = "sentiment_score" in df.columns
    values = {}
    for name in SENTIMENT_COLUMNS:
        fresh = F.col(f"_sent.{name}")
        if keep and name in df.columns:
            values[name] = F.when(F.col("sentiment_score").isNull(), fresh).otherwise(F.col(name))
        elif keep:
            values[name] = F.when(F.col("sentiment_score").isNull(), fresh)
        else:
            values[name] = fresh
    return staged.withColumns(values).drop("_sent")
