"""Text normalisation, cleaning and tokenising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.functions.common import (
    NON_WORD, NON_WORD_NON_SPACE, SPACE, col, collapse_space, contains_any, let)

WS, IN = SPACE, SPACE[1:-1]

# Markup patterns that must act as stated, applied one after the other.
# Each row is (text that must be present for the pattern to matter, pattern, replacement); a list
# names lower-case texts of which one must be present, DOTTED asks for a dot between two letters.
# Runs of letters start at their edge (or where the last match ended) and are possessive where that
# changes nothing, so no pattern reads a long run again from each of its characters.
DOTTED = r"[a-zA-Z]\.[a-zA-Z]"
MARKUP_PATTERNS = [
    ("{", rf"(?<![a-zA-Z0-9.#\-_,{IN}])[a-zA-Z0-9.#\-_,{IN}]*\{{[^}}]*\}}", ""),
    ("MsoNormal", r"p\.MsoNormal[^}]*\}?", ""),
    ("MsoNormal", r"li\.MsoNormal[^}]*\}?", ""),
    ("MsoNormal", r"div\.MsoNormal[^}]*\}?", ""),
    ("EmailStyle", r"span\.EmailStyle\p{Nd}+[^}]*\}?", ""),
    ("MsoChpDefault", r"\.MsoChpDefault[^}]*\}?", ""),
    ("WordSection", r"div\.WordSection\p{Nd}+[^}]*\}?", ""),
    (":", rf"(?i)(?<![a-z])[a-z]++:{WS}*p\.[a-z]+,?{WS}*li\.[a-z]+,?{WS}*div\.[a-z]+{WS}*\{{?", ""),
    (DOTTED, rf"(?<![a-zA-Z])[a-zA-Z]++\.[a-zA-Z]+(?:{WS}*,{WS}*[a-zA-Z]++\.[a-zA-Z]+)*+{WS}*\{{?", ""),
    (":", r"(?<![a-zA-Z\-])[a-zA-Z\-]++:[^;]{1,50};", ""),
    ("margin:", r"margin:[^;]+;?", ""),
    ("font-", r"font-[^;]+;?", ""),
    ("color:", r"color:[^;]+;?", ""),
    ("MsoNormal", rf"p\.x?_?MsoNormal,?{WS}*li\.x?_?MsoNormal,?{WS}*div\.x?_?MsoNormal", ""),
    ("x_MsoN", rf"p\.x_MsoNormal,?{WS}*li\.x_MsoN[^,{IN}]*", ""),
    ("MsoNormal", rf"(?<![a-zA-Z._])[a-zA-Z._]+MsoNormal[^,{IN}]*,?{WS}*", ""),
    ("&", r"&[a-zA-Z0-9#]+;", " "),
    ("<", r"<[^>]+>", ""),
    ("font-family:", r"font-family:[^;]+;", ""),
    ("font-size:", r"font-size:[^;]+;", ""),
    ("margin:", r"margin:[^;]+;", ""),
    ("color:", r"color:[^;]+;", ""),
    (":", rf"(?<![a-zA-Z])[a-zA-Z]++:{WS}*[^;{{}}{IN}]+[;{{}}{IN}]*", ""),
    ("{", r"\{[^}]*\}", ""),
    (DOTTED, rf"(?<![a-zA-Z])[a-zA-Z]++\.[a-zA-Z]+[,{IN}]*", ""),
    (":", rf"(?<![a-zA-Z\-])[a-zA-Z\-]++:{WS}*[^;]+;", ""),
]
# Patterns for mail noise, applied to the text once it is a single line.
MAIL_PATTERNS = [
    (":", rf"(?i)(?<![\p{{L}}\p{{N}}_])Description:{WS}*", ""),
    (":", r"(?is)^(?:From|To|Sent|Subject|Cc):.*", ""),
    ("@", r"(?:(?<![a-zA-Z0-9._%+-])|\G)[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email-removed]"),
    ("[", rf"(?i)\[EXTERNAL\]{WS}*", ""),
    (["best regards", "thanks", "-----original message-----"],
     r"(?is)(?:Best regards|Thanks|-----Original Message-----).*", ""),
]
PUNCTUATION_RUN = r"[.,;:!?]{3,}"
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

# Words that never count as keywords of a request.
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out",
    "day", "get", "has", "him", "his", "how", "its", "may", "new", "now", "old", "see", "two", "who", "boy",
    "did", "don", "way", "with", "have", "this", "will", "your", "from", "they", "know", "want", "been", "good",
    "much", "some", "time", "very", "when", "come", "here", "just", "like", "long", "make", "many", "over",
    "such", "take", "than", "them", "well", "were", "what", "need", "would", "there", "should",
)


def _apply(patterns, c: Column) -> Column:
    for needle, pattern, replacement in patterns:
        c = _guarded(c, needle, pattern, replacement)
    return c


def _guarded(c: Column, needle: str | list[str], pattern: str, replacement: str) -> Column:
    def present(t: Column) -> Column:
        if needle == DOTTED:
            return F.rlike(t, F.lit(DOTTED))
        return let(F.lower(t), lambda low: contains_any(low, needle)) if isinstance(needle, list) else F.contains(t, F.lit(needle))

    return let(c, lambda t: F.when(present(t), F.regexp_replace(t, pattern, replacement)).otherwise(t))


def clean_text(c: Column | str) -> Column:
    """Strip style sheets, tags, entities, mail headers, addresses and sign-offs; null → ''.

    Every pattern is guarded by a substring test, so plain prose pays for a few scans only.
    """
    text = _apply(MARKUP_PATTERNS, F.coalesce(col(c), F.lit("")))
    text = _apply(MAIL_PATTERNS, collapse_space(text))
    text = F.regexp_replace(collapse_space(text), PUNCTUATION_RUN, "...")
    return F.trim(text)


def normalize_for_id(c: Column | str) -> Column:
    """Lower case, white space collapsed, everything but word characters and blanks dropped."""
    return F.regexp_replace(collapse_space(F.lower(F.coalesce(col(c), F.lit("")))), NON_WORD_NON_SPACE, "")


def compare_form(c: Column | str) -> Column:
    """Form used for similarity: lower case words separated by single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), NON_WORD + "+", " "))


def words(c: Column | str) -> Column:
    """Lower-case word tokens, none empty: those of :func:`compare_form`, cut without writing it."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), NON_WORD + "+"), lambda w: w != "")


def request_keywords(c: Column | str, stop_words=STOP_WORDS, min_length: int = 3) -> Column:
    """Tokens of at least ``min_length`` characters that are not stop words, repeats kept."""
    from vocspark.taxonomy import literal_strings
    stops = literal_strings(list(stop_words))
    return F.filter(words(c), lambda w: (F.length(w) >= min_length) & ~F.array_contains(stops, w))


def sanitize(c: Column | str) -> Column:
    """Drop control characters except tab, newline and carriage return."""
    return F.regexp_replace(col(c), CONTROL_CHARS, "")


def sanitize_frame(df: DataFrame) -> DataFrame:
    """:func:`sanitize` on every string and every array of strings."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out[f.name] = sanitize(f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out[f.name] = F.transform(F.col(f.name), sanitize)
    return df.withColumns(out) if out else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column and every array of floats."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType)):
            out[f.name] = F.transform(F.col(f.name), lambda x: F.when(~F.isnan(x), x))
    return df.withColumns(out) if out else df


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")
