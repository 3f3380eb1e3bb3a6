"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode classes, written out so the JVM's ASCII defaults for \w and \s play no role.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_]"
NON_WORD_NON_SPACE = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain second reference to a column expression lets the optimizer inline it, and inside a
    lambda an inlined ``lower(text)`` would run once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_filled(*cols: Column | str) -> Column:
    """First value that is neither null nor the empty string, else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def collapse_space(c: Column | str) -> Column:
    """Runs of Unicode white space to one blank, none at either end."""
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def strip_space(c: Column | str) -> Column:
    """Trim Unicode white space at both ends, leave the inside alone."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def truncate(c: Column | str, limit: int, keep: int | None = None) -> Column:
    """Texts over ``limit`` become their first ``keep`` characters and an ellipsis."""
    keep = limit if keep is None else keep
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def contains_any(text: Column, words) -> Column:
    """True if any of the literal words occurs in ``text``."""
    from vocspark.taxonomy import literal_strings
    return F.exists(literal_strings(list(words)), lambda w: F.contains(text, w))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated exactly once per row.

    A filter on an ordinary computed column is pushed below the projection and takes a copy of the
    expression along.  As the output of a generator the column stays where it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
