"""Who made a change, read from the payload part of an access token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark.functions.common import blank_to_null, col, let

# Claims in the order they are tried, and the answer when none is present.
CLAIMS = ["upn", "email", "preferred_username", "name", "sub"]
NO_CLAIM = "Unknown User"


def actor_from_token(c: Column | str) -> Column:
    """First filled claim of the payload; an unreadable token maps to a stable numbered user."""
    raw = F.trim(F.replace(col(c), F.lit("Bearer "), F.lit("")))
    payload = F.translate(F.get(F.split(raw, r"\."), F.lit(1)), "-_", "+/")
    padded = let(payload, lambda p: F.rpad(p, (F.ceil(F.length(p) / 4) * 4).cast("int"), "="))
    text = F.try_to_binary(padded, F.lit("base64"))
    schema = ", ".join(f"{name} string" for name in CLAIMS)
    decoded = F.try_validate_utf8(text.cast("string"))
    readable = F.try_parse_json(decoded).isNotNull()
    claims = F.from_json(decoded, schema)
    found = let(claims, lambda x: F.coalesce(*[blank_to_null(x[name]) for name in CLAIMS], F.lit(NO_CLAIM)))
    fallback = F.concat(F.lit("User-"), F.pmod(F.xxhash64(raw), F.lit(10000)).cast("string"))
    return F.when(readable, found).otherwise(fallback)
