"""All queries of this subpackage; its modules register them on import."""

from vocspark.llm import (  # noqa: F401
    alignment, bpe, context_mixing, license_scan, minhash, mixing, quality, sentence_pieces, spelling, token_files, toxicity, vectors, warc)
from vocspark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
