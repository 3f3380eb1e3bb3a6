"""Voice-of-customer analytics as composable Spark DataFrame operators."""

from vocspark.schema import FEEDBACK_SCHEMA, STATE_SCHEMA
from vocspark.taxonomy import Taxonomy

__all__ = ["FEEDBACK_SCHEMA", "STATE_SCHEMA", "Taxonomy"]
__version__ = "0.1.0"
