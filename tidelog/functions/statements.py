"""Predicates and clean-up of SQL statements in the log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statements that may change tables, databases that belong to the server.
TABLE_STATEMENT = r"^(alter|create|drop|rename)\s+table"
INDEX_STATEMENT = r"^((create(\s+(unique|fulltext|spatial))?)|drop)\s+index"
DATABASE_STATEMENT = r"^(create|drop)\s+(database|schema)"
GRANT_STATEMENT = r"^grant\s+"
SYSTEM_DATABASES = ("mysql", "information_schema", "performance_schema", "sys")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def statement_kind(sql: Column | str) -> Column:
    """table, index, database, grant or other: by how the statement begins, without letter case. Null for null."""
    s = _col(sql)
    like = lambda p: s.rlike(f"(?i){p}")
    return F.when(s.isNull(), None).when(like(TABLE_STATEMENT), "table").when(like(INDEX_STATEMENT), "index").when(like(DATABASE_STATEMENT), "database").when(like(GRANT_STATEMENT), "grant").otherwise("other")


def changes_schema(sql: Column | str) -> Column:
    """Whether the schema tracker has to look at a statement. One behind a comment or blanks is not seen."""
    return F.coalesce(statement_kind(sql).isin("table", "index", "database"), F.lit(False))


def is_begin(sql: Column | str) -> Column:
    return F.coalesce(_col(sql) == "BEGIN", F.lit(False))


def is_commit(sql: Column | str) -> Column:
    return F.coalesce(_col(sql) == "COMMIT", F.lit(False))


# Fixed value: a comment that the server executes (with or without the version from which it does).
EXECUTABLE_COMMENT = r"/\*!(?:\d{5})?(.*?)\*/"


def without_comments(sql: Column | str) -> Column:
    """Statement with /*! ... */ unwrapped, block comments blanked, runs of blanks squeezed, blanks in front dropped. Line comments stay."""
    s = F.regexp_replace(_col(sql), EXECUTABLE_COMMENT, "$1")
    s = F.regexp_replace(s, r"(?s)/\*.*?\*/", " ")
    return F.regexp_replace(F.regexp_replace(s, r"\h+", " "), r"^\s+", "")
