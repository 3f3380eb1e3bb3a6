"""Named queries over the driver tables, each with its plain-SQL counterpart where one exists."""

from bindings import (  # noqa: F401  (modules register their queries on import)
    classification, incremental, indexed, large_lists, records, repeats, reports, round_trips, storage, text, triage)
from bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
