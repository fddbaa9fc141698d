"""Imports every module that registers queries."""

from spanloom.plans import annotation, curation, evaluation, streams, subword, tables  # noqa: F401

FLAGSHIP = "span_prf"
