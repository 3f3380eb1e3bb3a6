"""Quality rules: a table of thresholds compiled into one Spark projection, no user functions.

Measures of a text (null is empty) are columns; a rule names a measure, what it is divided by and its bounds.  All
rules become one boolean expression, so that a scan with its rules is a single narrow stage.

Empty tables give empty results; repeated rows are judged one by one alike; extra columns are carried, except that a
measure's column replaces one of the same name.  A text without words fails ``min_words``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.common import with_once
from vocspark.llm.common import carrying, SPACE_CLASS, table
from vocspark.llm.registry import query

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "der", "die", "das", "und", "von",
              "mit", "zu", "den", "ist", "de", "la", "le", "les", "et", "en", "que", "un", "une", "dans", "el", "los",
              "las", "y", "por", "con")
SYMBOLS = "#*$%&|<>"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A row fails if measure < low * per or measure > high * per; ``per`` is a measure, or None for 1.

    Ratios are compared as integers: bounds are given in hundredths.
    """
    name: str
    measure: str
    per: str | None = None
    low: int | None = None
    high: int | None = None

    def fails(self) -> Column:
        value = F.col(self.measure) * 100
        per = F.lit(1) if self.per is None else F.col(self.per)
        out = F.lit(False)
        if self.low is not None:
            out = out | (value < per * self.low)
        if self.high is not None:
            out = out | (value > per * self.high)
        return out

    def sql(self) -> str:
        per = self.per or "1"
        parts = [f"100 * {self.measure} < {self.low} * {per}"] * (self.low is not None)
        parts += [f"100 * {self.measure} > {self.high} * {per}"] * (self.high is not None)
        return "(" + " OR ".join(parts) + ")"


BASE_RULES = (
    Rule("min_words", "n_words", low=5000),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=50),
)
METHOD_RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("exclamations", "n_exclamations", "n_words", high=30),
    Rule("capitals", "n_capitals", "word_chars", high=50),
    Rule("stop_words", "n_stop_words", low=200),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=70),
)


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


# Texts of fewer words than this sort hash and position in one number, which needs no objects; longer ones sort pairs.
PACKED_WORDS = 1 << 16


def _repeat_positions(hashes: Column) -> Column:
    """Sorted starts of the 3-word windows that a text has at least twice; ``hashes`` are those of its words.

    Windows are sorted by hash with their position, so a repeat stands next to its equal; n log n at any length.
    """
    def window(x, i):
        return F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2))

    count = F.size(hashes) - 2
    mask = F.lit(PACKED_WORDS - 1).cast("long")
    packed = F.sort_array(F.slice(F.transform(
        hashes, lambda x, i: window(x, i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))), 1, count))
    pairs = F.sort_array(F.slice(F.transform(
        hashes, lambda x, i: F.struct(window(x, i).alias("h"), i.cast("long").alias("i"))), 1, count))

    def from_packed(s):
        return F.transform(F.filter(s, lambda x, k: (x.bitwiseXOR(F.coalesce(F.get(s, k + 1), F.bitwise_not(x))) <= mask)
                                    & (x.bitwiseXOR(F.coalesce(F.get(s, k + 1), F.bitwise_not(x))) >= 0)
                                    | (x.bitwiseXOR(F.coalesce(F.get(s, k - 1), F.bitwise_not(x))) <= mask)
                                    & (x.bitwiseXOR(F.coalesce(F.get(s, k - 1), F.bitwise_not(x))) >= 0)),
                           lambda x: x.bitwiseAND(mask))

    def from_pairs(s):
        return F.transform(F.filter(s, lambda w, k: F.coalesce(w["h"] == F.get(s, k + 1)["h"], F.lit(False))
                                    | F.coalesce(w["h"] == F.get(s, k - 1)["h"], F.lit(False))), lambda w: w["i"])

    def staged(value, body):
        return F.get(F.transform(F.array(value), body), F.lit(0))

    return F.sort_array(F.when(count < 1, F.array().cast("array<bigint>"))
                        .when(count < PACKED_WORDS, staged(packed, from_packed)).otherwise(staged(pairs, from_pairs)))


def _covered(starts: Column) -> Column:
    """Words in windows at the sorted ``starts``: three each, less what the window before has covered."""
    return F.aggregate(F.transform(starts, lambda i, k: F.when(k == 0, F.lit(3).cast("long")).otherwise(
        F.least(F.lit(3).cast("long"), i - F.get(starts, k - 1)))), F.lit(0).cast("long"), lambda a, b: a + b)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the method's own."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SPACE_CLASS + "+"), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD_CHARACTER))
    marks = F.regexp_replace(body, rf"[^{SYMBOLS}!\p{{Lu}}]+", "")
    staged = docs.withColumns({"_words": words, "_lines": lines, "_marks": marks})
    staged = staged.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    staged = staged.withColumn("_repeats", _repeat_positions(F.col("_hashes")))
    symbols, exclamations = _count(F.col("_marks"), SYMBOLS), _count(F.col("_marks"), "!")
    return staged.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": symbols,
        "n_exclamations": exclamations,
        "n_capitals": F.length("_marks") - symbols - exclamations,
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _covered(F.col("_repeats")),
    }).drop("_words", "_lines", "_marks", "_hashes", "_repeats")


def any_fails(rules) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | rule.fails()
    return out


def judge(docs: DataFrame, text: str = "text", base=BASE_RULES, rules=METHOD_RULES) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every row."""
    out = measures(docs, text).withColumn("base_failed", any_fails(base))
    return out.withColumn("kept", ~(F.col("base_failed") | any_fails(rules)))


@carrying
def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the documents that all rules keep."""
    judged = judge(docs.withColumn("_text", F.col("text")), "_text")
    return with_once(judged, "_keep", F.col("kept")).where("_keep").select(*docs.columns)


MEASURES_SQL = f"""m0 AS (SELECT *, coalesce(text, '') AS body FROM {{source}}),
m1 AS (SELECT *, list_filter(string_split_regex(body, '{SPACE_CLASS}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(body, chr(10)), lambda x: regexp_replace(x, '{SPACE_CLASS}', '', 'g') <> '') AS ls FROM m0),
m2 AS (SELECT *, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS win FROM m1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM (SELECT doc_id, unnest(win) AS w, unnest(range(1, len(win) + 1)) AS i FROM m2)) t,
  range(3) r(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT m2.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '{SPACE_CLASS}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(body, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(regexp_replace(body, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations,
  CAST(length(regexp_replace(body, '[^\\p{{{{Lu}}}}]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(len(list_filter(ws, lambda w: list_contains({list(STOP_WORDS)}, lower(w)))) AS BIGINT) AS n_stop_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM m2 LEFT JOIN rw USING (doc_id))"""

_BASE_SQL = " OR ".join(r.sql() for r in BASE_RULES)
_ALL_SQL = " OR ".join(r.sql() for r in BASE_RULES + METHOD_RULES)
QUALITY_SQL = f"""WITH {MEASURES_SQL.format(source='documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_BASE_SQL}) AS base_failed, NOT ({_ALL_SQL}) AS kept FROM m"""


@query("op9_quality_rules", QUALITY_SQL)
def quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept")
