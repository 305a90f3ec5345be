"""Row search: all columns, one column, whole cells, name or id."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def search(df: DataFrame, query: str | None, mode: str = "global", column: str | None = None, literal: bool = False) -> DataFrame:
    """F-06 to F-09. The query is a regular expression unless ``literal``; case doesn't matter.

    ``global``: any column contains it; ``column``: that column does; ``strict``: any cell equals it.
    An empty query gives all rows. An unknown or missing column raises ``ValueError``.
    """
    if query is None or str(query) == "":
        return df
    text = str(query).lower()
    cell = lambda c: F.coalesce(F.lower(F.col(c).cast("string")), F.lit(""))
    wanted = re.escape(text) if literal else text
    if mode == "strict":
        return df.filter(_any([cell(c) == text for c in df.columns]))
    if mode == "column":
        if column is None or column not in df.columns:
            raise ValueError(f"Column '{column}' not found in DataFrame.")
        return df.filter(cell(column).rlike(wanted))
    if mode != "global":
        raise ValueError(f"unknown mode {mode!r}")
    return df.filter(_any([cell(c).rlike(wanted) for c in df.columns]))


def search_name_or_id(df: DataFrame, query: str | None, name: str = "fullname", person: str = "delegate_id") -> DataFrame:
    """F-10."""
    if not query:
        return df
    return df.filter(_any([F.coalesce(F.col(c).cast("string").rlike(f"(?i){query}"), F.lit(False)) for c in (name, person)]))
