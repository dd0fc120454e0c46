"""Registry of the engine's own queries and their DuckDB equivalents."""

from __future__ import annotations

from foliolens.plans import audits, chapters, compiled, corpora, decks, details, pages, publishing, queues, reviews, sections
from foliolens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audits", "chapters", "compiled", "corpora", "decks", "details", "pages", "publishing", "queues", "reviews", "sections"]
