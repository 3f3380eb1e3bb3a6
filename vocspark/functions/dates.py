"""Dates in many spellings, always relative to a stated ``as_of``, never to the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark.functions.common import blank_to_null, col, let

# Absolute spellings in the order they are tried, each with the shape of its texts.
# A text of another shape is not handed to the parser, where every failure costs an exception.
NUMERIC, CLOCK = r"\d{1,2}-\d{1,2}-\d{4}", r" \d{1,2}:\d{2} [A-Za-z]{2}$"
FORUM_FORMATS = [
    ("M-d-yyyy h:mm a", "^" + NUMERIC + CLOCK),
    ("M-d-yyyy", "^" + NUMERIC + "$"),
    ("MMM d, yyyy h:mm a", r"^[A-Za-z]{3} \d{1,2}, \d{4}" + CLOCK),
    ("d-M-yyyy h:mm a", "^" + NUMERIC + CLOCK),
]


ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def date_time_fragments(date_text: Column | str, time_text: Column | str) -> Column:
    """Digits and dashes of one text, clock characters of the other; null without a date part."""
    date = blank_to_null(F.trim(F.regexp_extract(col(date_text), r"([\d\-]+)", 1)))
    time = blank_to_null(F.trim(F.regexp_extract(F.coalesce(col(time_text), F.lit("")), r"([\d\s:/APMampm]+)", 1)))
    return F.when(date.isNotNull(), F.concat_ws(" ", date, time))


def forum_timestamp(c: Column | str, as_of: Column) -> Column:
    """Absolute formats, then yesterday/today, then "n units ago", else ``as_of``."""
    raw = col(c)

    def parse(low: Column) -> Column:
        day = F.when(F.contains(low, F.lit("yesterday at")), F.date_sub(as_of, 1)).when(
            F.contains(low, F.lit("today at")), F.to_date(as_of))
        # A clock time belongs to the day in the session's zone, so both are read as one local time.
        clock = F.regexp_replace(F.regexp_extract(low, r"(\d{1,2}:\d{2}\s*(?:am|pm))", 1), r"\s*(am|pm)", " $1")
        spoken = F.coalesce(
            F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), clock), F.lit("yyyy-MM-dd h:mm a")), day.cast("timestamp"))
        n = F.regexp_extract(low, r"(\d+)", 1).try_cast("int")
        unit = F.when(F.contains(low, F.lit("minute")), 60).when(F.contains(low, F.lit("hour")), 3600).when(
            F.contains(low, F.lit("day")), 86400)
        ago = F.when(F.contains(low, F.lit("ago")), F.timestamp_micros(F.unix_micros(as_of) - n * unit * F.lit(1_000_000).cast("long")))
        return F.coalesce(spoken, ago)

    absolute = [F.when(F.rlike(raw, F.lit(shape)), F.try_to_timestamp(raw, F.lit(fmt))) for fmt, shape in FORUM_FORMATS]
    return F.coalesce(*absolute, let(F.lower(raw), parse), as_of)


def iso_timestamp(c: Column | str) -> Column:
    """ISO date or date-time with optional offset; anything else is null.

    The shape is checked first: a cast alone takes a bare clock time for today and a bare year for its first day.
    """
    return F.when(F.rlike(F.trim(col(c)), F.lit(ISO_SHAPE)), col(c).try_cast("timestamp"))


def epoch_to_iso(c: Column | str) -> Column:
    """Epoch seconds as ISO text in the session time zone, fraction only if there is one."""
    ts = F.timestamp_micros(F.round(col(c) * 1_000_000).cast("long"))
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
