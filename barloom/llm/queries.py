"""Imports every module that registers a query."""
from barloom.llm import (  # noqa: F401
    context_tree, infill, licenses, media, merkle, mixing, odd_sketch, packing, quality_rules, resampling, simhash, token_counts, warc,
)
from barloom.llm.registry import ORACLES, QUERIES  # noqa: F401
