"""Registered queries: the operators over the views, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asklens.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``check`` is the same result in SQL, with views by name."""
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = with_views(check)
        return fn

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that both engines agree on the last places."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def joined(c: str | Column, sep: str = "|") -> Column:
    """An array as text, for comparison across engines."""
    return F.array_join(c, sep)


def load_all() -> None:
    """Import every module that registers queries."""
    from asklens.plans import analytics, corpus, logs, search, texts  # noqa: F401
