"""All registered queries outside of tidemark.llm, by name, and their SQL."""

from __future__ import annotations

from . import analytics, select, versioned

QUERIES = {**select.QUERIES, **versioned.QUERIES, **analytics.QUERIES}
SQL = {**select.SQL, **versioned.SQL, **analytics.SQL}
