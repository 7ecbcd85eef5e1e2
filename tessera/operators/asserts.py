"""Assertions: rows or keys that break a rule, and variants that raise."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


class AssertionFailed(ValueError):
    """A data-quality rule does not hold."""


def failing_condition(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the SQL condition is not true; null counts as failing."""
    return df.where(~F.coalesce(F.expr(condition), F.lit(False)))


def failing_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in any of the columns."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.where(bad)


def conflicting_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ConflictKey): columns whose values repeat, each by itself, nulls aside."""
    wide = df.agg(*[(F.count(c) > F.countDistinct(c)).alias(f"c{k}") for k, c in enumerate(columns)])
    items = F.array(*[F.struct(F.lit(c).alias("ConflictKey"), F.col(f"c{k}").alias("bad")) for k, c in enumerate(columns)])
    return wide.select(F.explode(items).alias("r")).where("r.bad").select("r.ConflictKey")


def conflicting_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose composite key occurs twice or more; nulls equal each other.

    Keys are counted with partial sums and only those that repeat meet the rows
    again, so a key that very many rows share makes no large window.
    """
    twice = df.groupBy(*columns).agg(F.count("*").alias("__n")).where("__n > 1").select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(columns)])
    return df.join(twice, [F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(columns)], "left_semi")


def require_condition(df: DataFrame, condition: str) -> None:
    bad = failing_condition(df, condition).count()
    if bad:
        raise AssertionFailed(f"{bad} rows fail: {condition}")


def require_not_null(df: DataFrame, columns: Sequence[str]) -> None:
    bad = failing_not_null(df, columns).count()
    if bad:
        raise AssertionFailed(f"{bad} rows have a null in {', '.join(columns)}")


def require_unique_key(df: DataFrame, columns: Sequence[str]) -> None:
    bad = [r[0] for r in conflicting_keys(df, columns).collect()]
    if bad:
        raise AssertionFailed(f"keys repeat: {', '.join(bad)}")


def require_unique_keys(df: DataFrame, columns: Sequence[str]) -> None:
    """Groups and keeps keys that repeat: no window over the rows is needed here."""
    bad = df.groupBy(*columns).count().where("count > 1").limit(1).count()
    if bad:
        raise AssertionFailed(f"composite key repeats: {', '.join(columns)}")


def to_sql(expression: str) -> str:
    """A host expression with ``:column`` names, ``==``, ``&&`` and ``||`` as SQL."""
    pieces = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", expression)
    for k in range(0, len(pieces), 2):
        text = re.sub(r":([A-Za-z_]\w*)", r"`\1`", pieces[k])
        pieces[k] = text.replace("==", "=").replace("&&", " and ").replace("||", " or ")
    return "".join(pieces)


def require(df: DataFrame, expression: str, message: str) -> None:
    """Raise the message if the expression is not true for some row; one failing row ends the search."""
    sql = to_sql(expression)
    missing = [c for c in re.findall(r"`(\w+)`", sql) if c not in df.columns]
    if missing:
        raise AssertionFailed(f"column not found: {', '.join(missing)}")
    if failing_condition(df, sql).limit(1).count():
        raise AssertionFailed(message)


def throw(message: str) -> None:
    raise AssertionFailed(message)
