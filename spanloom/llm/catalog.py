"""Imports every module that registers a query of this subpackage."""

from spanloom.llm import balls, dominance, licenses, packing, pieces, private, repetition, secrets, simhash, topk, toxicity, warc, weak  # noqa: F401
from spanloom.llm.registry import ORACLES, QUERIES  # noqa: F401
