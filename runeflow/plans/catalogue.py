"""The engine's queries by name, each over whole tables, with their SQL twins."""

from __future__ import annotations

from runeflow.plans import font_queries, golden_queries, set_queries, text_queries  # noqa: F401
from runeflow.plans.registry import ORACLE, QUERIES  # noqa: F401
