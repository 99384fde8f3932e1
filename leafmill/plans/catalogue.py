"""The query catalogue: name -> query, name -> the SQL that says the same."""

from leafmill.plans import cache, extract, layout, library, match, requests, sources, state, timeline, urls, values, voice, writes  # noqa: F401  (each registers its own)
from leafmill.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
