"""Every query by name, and the SQL that it can be held against."""

from __future__ import annotations

from .plans import answers, base, documents, preparation, ratings, reports, sets, texts, timelines  # noqa: F401  (they register their queries)

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
