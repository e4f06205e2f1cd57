"""The registered queries, and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .bindings import Tables

FOUND: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the tables under a name, with the SQL that gives the same rows."""

    def add(f):
        FOUND[name] = (f, sql)
        return f

    return add


def sql_of(name: str) -> str:
    return FOUND[name][1]


def text_list(words: list[str]) -> str:
    """A list of SQL strings."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(words: list[str], column: str) -> str:
    """Whether a column holds any of the words."""
    return "(" + " OR ".join(f"contains({column}, '" + w.replace("'", "''") + "')" for w in words) + ")"


PK = "coalesce(nullif(lower(trim(platform)), ''), 'default')"
NK = r"lower(trim(regexp_replace(outcome, '\s+', ' ', 'g')))"
SYS = "lower(trim(persona)) IN ('system', 'external system')"
ROUTE = r"regexp_replace(lower(regexp_replace(regexp_replace(url, '\?.*$', ''), '/+$', '')), '\{[^}]*\}', ':p', 'g')"
