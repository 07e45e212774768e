"""Named queries over the given tables, with their SQL."""

from . import batch, search, tables, text

QUERIES: dict = {**text.QUERIES, **search.QUERIES, **tables.QUERIES, **batch.QUERIES}
ORACLE_SQL: dict[str, str] = {**text.ORACLE_SQL, **search.ORACLE_SQL, **tables.ORACLE_SQL, **batch.ORACLE_SQL}
