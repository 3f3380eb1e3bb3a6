"""Content-derived identifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark.functions.common import blank_to_null, col, first_filled, let, strip_space
from vocspark.functions.text import normalize_for_id

@dataclass(frozen=True)
class KeyLengths:
    """How many characters of the texts go into keys; None is the whole text.

    ``content`` is for identifiers, ``signature`` for the content part of signatures, ``title`` for both.
    """
    title: int | None = None
    content: int | None = None
    signature: int | None = None


WHOLE = KeyLengths()
# The short keys under which older stored tables were written.
SHORT = KeyLengths(title=100, content=500, signature=200)


def _opening(c: Column, size: int | None) -> Column:
    return c if size is None else F.substring(c, 1, size)


def _id_content(content, size: int | None) -> Column:
    """Normalised content; of a short key the first characters, read from the opening of the text if that suffices."""
    raw = F.coalesce(col(content), F.lit(""))
    if size is None:
        return normalize_for_id(raw)
    opening = normalize_for_id(F.substring(raw, 1, 4 * size))
    return let(opening, lambda n: F.substring(F.when(F.length(n) > size, n).otherwise(normalize_for_id(raw)), 1, size))


def feedback_id(title, content, source, author=None, created=None, lengths: KeyLengths = WHOLE) -> Column:
    """SHA-256 over the filled parts, written as 8-4-4-4-12 hex digits.

    ``created`` is the text as received; its first ten characters are the calendar date in its
    own offset, so no time zone shift can change an identifier.
    """
    def lowered(c):
        return F.lit(None).cast("string") if c is None else F.lower(col(c))

    date = F.lit(None).cast("string") if created is None else F.substring(col(created), 1, 10)
    parts = [normalize_for_id(title), _id_content(content, lengths.content),
             lowered(source), lowered(author), date]
    digest = F.sha2(F.concat_ws("|", *[blank_to_null(p) for p in parts]), 256)
    return F.regexp_replace(F.substring(digest, 1, 32),
                            "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def feedback_id_from_record(title="title", content="content", feedback="feedback", source="source",
                            customer="customer", created="created", lengths: KeyLengths = WHOLE) -> Column:
    """Identifier of a collected record: title, else the feedback."""
    return feedback_id(first_filled(title, _opening(col(feedback), lengths.title)),
                       first_filled(content, feedback), source, customer, created, lengths)


def content_signature(title, content, lengths: KeyLengths = WHOLE) -> Column:
    """Key for duplicates that got another identifier: trimmed lower-case title and content."""
    def part(c, n):
        return strip_space(F.lower(_opening(F.coalesce(col(c), F.lit("")), n)))

    return F.concat(part(title, lengths.title), F.lit("|"), part(content, lengths.signature))
