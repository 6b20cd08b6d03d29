"""All queries of the subpackage: importing the operators registers them."""

from tallyframe.llm import (  # noqa: F401
    approximation, bpe, fingerprint, language, merkle, negatives, packing, pii, quality, scoring, sharding, simhash, token_files,
)
from tallyframe.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
