"""One-line gist of a text: title, best sentence, key terms, or leading words."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark.functions.common import NON_WORD, SPACE, col, let, strip_space, truncate
from vocspark.functions.text import title_case
from vocspark.taxonomy import Taxonomy, constant, literal_strings

# Openings that rule out a title, openings that cost points, filler words, limits.
NO_TITLE_OPENINGS = ["hey", "hi", "hello", "i ", "we ", "the ", "a ", "an "]
CHATTY_OPENINGS = ["hey", "hi", "hello", "i am", "we are"]
FILLER_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up",
    "about", "into", "through", "during", "before", "after", "above", "below", "between", "among", "within",
    "without", "against", "hey", "hi", "hello", "i", "we", "you", "they", "it", "this", "that", "these",
    "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must", "can", "cannot",
)
MIN_SENTENCE, MAX_WORDS = 10, 12
# Sentences are looked for in an opening of this many characters, and in the whole text only if it holds too few.
OPENING, SENTENCES = 2_000, 3


@dataclass(frozen=True)
class GistProfile:
    """Vocabulary of the gist: topic groups in order, bonus terms, and ordered lists of key terms; all empty unless given."""

    groups: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    bonus_terms: tuple[str, ...] = ()
    key_terms: tuple[tuple[str, ...], ...] = ()

    @classmethod
    def of_taxonomy(cls, taxonomy: Taxonomy) -> GistProfile:
        """The domains as topics; the key terms are the keywords of the categories, in their order."""
        keywords = dict.fromkeys(k.lower() for s in taxonomy.subcategories for k in s.keywords)
        return cls({g.name.lower(): tuple(k.lower() for k in g.keywords) for g in taxonomy.domains},
                   tuple(k.lower() for k in taxonomy.tracked_keywords), (tuple(keywords),) if keywords else ())


def _starts_with_any(c: Column, prefixes) -> Column:
    return F.exists(literal_strings(prefixes), lambda p: F.startswith(c, p))


def gist(text: Column | str, profile: GistProfile | None = None, max_length: int = 150) -> Column:
    """The first strategy that yields something wins; null and blank texts have fixed answers."""
    profile = profile or GistProfile()
    raw = col(text)
    body = let(strip_space(raw), lambda t: F.when(t == "", F.lit("Empty feedback")).otherwise(F.coalesce(
        _title(t, max_length), *([_from_topics(t, profile, max_length)] if profile.groups else []), _leading_words(t, max_length),
        truncate(t, max_length, max_length - 3))))
    return F.when(raw.isNull() | (raw == ""), F.lit("No content")).otherwise(body)


def _title(t: Column, max_length: int) -> Column:
    """Text in front of the first sentence mark, if it looks like a heading."""
    return let(strip_space(F.regexp_extract(t, r"^([^.\n!?]+)[.\n!?]", 1)), lambda head: F.when(
        (F.length(head) > MIN_SENTENCE) & (F.length(head) < max_length)
        & ~_starts_with_any(F.lower(head), NO_TITLE_OPENINGS), head))


def _from_topics(t: Column, profile: GistProfile, max_length: int) -> Column:
    groups = constant([{"name": name, "keywords": list(words)} for name, words in profile.groups.items()])

    def with_found(x: Column) -> Column:
        found = F.filter(groups, lambda g: F.exists(g["keywords"], lambda k: F.contains(x["lower"], k)))
        return let(found, lambda topics: F.coalesce(
            _best_sentence(x["text"], topics, profile, max_length),
            F.when(F.size(topics) > 0, _key_term_title(x["lower"], topics, profile, max_length))))

    return let(F.struct(t.alias("text"), F.lower(t).alias("lower")), with_found)


def _first_sentences(t: Column) -> Column:
    def long_enough(parts: Column) -> Column:
        return F.slice(F.filter(F.transform(parts, strip_space), lambda s: F.length(s) > MIN_SENTENCE), 1, SENTENCES)

    mark = "[.!?]+"
    # The last part of an opening may go on behind it.
    opening = let(F.split(F.substring(t, 1, OPENING), mark), lambda parts: long_enough(F.slice(parts, 1, F.size(parts) - 1)))
    return let(opening, lambda o: F.when((F.size(o) >= SENTENCES) & (F.length(t) > OPENING), o).otherwise(long_enough(F.split(t, mark))))


def _best_sentence(t: Column, topics: Column, profile: GistProfile, max_length: int) -> Column:
    """Highest positive score among the first three sentences; earlier ones win ties."""
    sentences = _first_sentences(t)
    keywords = F.flatten(F.transform(topics, lambda g: g["keywords"]))
    bonus = literal_strings(profile.bonus_terms)

    def score(s: Column) -> Column:
        return let(F.lower(s), lambda low:
                   2 * F.size(F.filter(keywords, lambda k: F.contains(low, k)))
                   + F.size(F.filter(bonus, lambda k: F.contains(low, k)))
                   - F.when(_starts_with_any(low, CHATTY_OPENINGS), 2).otherwise(0))

    ranked = F.transform(sentences, lambda s, i: F.struct(
        F.when(F.length(s) <= max_length, score(s)).otherwise(0).alias("score"),
        (-i).alias("rank"), s.alias("sentence")))
    return let(F.array_max(ranked), lambda b: F.when(b["score"] > 0, b["sentence"]))


def _key_term_title(lower: Column, topics: Column, profile: GistProfile, max_length: int) -> Column:
    if not profile.key_terms:
        return F.lit(None).cast("string")
    edge = "[\\p{L}\\p{N}_]"
    found = F.concat(*[F.regexp_extract_all(
        lower, F.lit(f"(?<!{edge})({'|'.join(map(re.escape, terms))})(?!{edge})"), F.lit(1))
        for terms in profile.key_terms])

    def build(terms: Column) -> Column:
        def joined(n):
            return title_case(F.array_join(F.slice(terms, 1, n), " "))

        first = title_case(F.replace(F.get(topics, F.lit(0))["name"], F.lit("-"), F.lit(" ")))
        pair = title_case(F.array_join(F.transform(F.slice(topics, 1, 2), lambda g: g["name"]), " & "))
        line = F.when(F.size(topics) == 1, F.concat_ws(" - ", first, joined(3))).otherwise(
            F.concat_ws(" - ", joined(4), pair))
        return F.when(F.size(terms) > 0, let(line, lambda g: F.when(F.length(g) <= max_length, g)))

    return let(F.array_distinct(found), build)


def _leading_words(t: Column, max_length: int) -> Column:
    fillers = literal_strings(FILLER_WORDS)
    kept = F.filter(F.split(t, SPACE + "+"), lambda w: let(
        F.regexp_replace(F.lower(w), NON_WORD, ""),
        lambda bare: (F.length(bare) > 2) & ~F.array_contains(fillers, bare)))
    return let(F.array_join(F.slice(kept, 1, MAX_WORDS), " "),
               lambda line: F.when(line != "", truncate(line, max_length, max_length - 3)))
