"""The registered queries: each runs an operator over the given tables, with its SQL twin."""

from . import datasets, ingest, retrieval, sources, streams, text  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
