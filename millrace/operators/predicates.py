"""Filters built only where they say something: access scopes, optional filters, keyset pages, rank comparisons."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import SEVERITIES, severity_rank

#: Sources that belong to no repository and that everybody may read: fixed values.
SHARED_SOURCES = ("confluence", "jira", "notion", "upload")


@dataclass(frozen=True)
class Scope:
    """What a reader may see: everything, or some repositories and the shared sources."""

    everything: bool = False
    repos: tuple[str, ...] = field(default=())


def visible(scope: Scope, repo: str = "repo_id", source: str = "source", requires: str | None = None) -> Column | None:
    """Rows that a scope may read; None where it may read all. A row without a repository counts by its source;
    a row that requires repositories needs all of them."""
    if scope.everything:
        return None
    own = F.coalesce(F.col(repo).isin(*scope.repos), F.lit(False)) if scope.repos else F.lit(False)
    out = own | (F.col(repo).isNull() & F.col(source).isin(*SHARED_SOURCES))
    if requires:
        allowed = F.array(*map(F.lit, scope.repos)) if scope.repos else F.array().cast("array<string>")
        out = out & (F.col(requires).isNull() | (F.size(F.array_except(requires, allowed)) == 0))
    return out


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    return functools.reduce(lambda d, c: d if c is None else d.where(c), conditions, df)


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def any_of(column: str, values) -> Column | None:
    return F.col(column).isin(*values) if values else None


def contains_text(column: str, part: str | None) -> Column | None:
    """Literal, whatever the case: % and _ are no wildcards."""
    return F.instr(F.lower(F.col(column)), F.lit(part.lower())) > 0 if part else None


def like_text(column: str, part: str | None) -> Column | None:
    """Whatever the case: % and _ are wildcards."""
    return F.col(column).ilike(f"%{part}%") if part else None


def same(column: str, value) -> Column:
    """Equal, null only to null."""
    return F.col(column).eqNullSafe(F.lit(value))


def holds(column: str, value) -> Column | None:
    """Arrays that have a value among their elements."""
    return None if value is None else F.array_contains(F.col(column), value)


def status_filter(column: str, statuses, hidden: tuple[str, ...] = ("suppressed",)) -> Column:
    """The statuses asked for; if none are, all but the hidden ones."""
    return F.col(column).isin(*statuses) if statuses else ~F.col(column).isin(*hidden)


def patched(df: DataFrame, changes: dict) -> DataFrame:
    """df with columns set to the given values; None leaves a column as it is."""
    return df.withColumns({c: F.coalesce(F.lit(v).cast(df.schema[c].dataType), F.col(c)) for c, v in changes.items()})


def with_truncation(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """The first size rows, and truncated: whether there were more. One row more is fetched to tell."""
    first = df.orderBy(*order).limit(size + 1)
    return first.withColumn("__n", F.count("*").over(Window.partitionBy())).orderBy(*order).limit(size).withColumn("truncated", F.col("__n") > size).drop("__n")


def at_path(column: str, path: str) -> Column:
    """A path that is, or ends with, the given one."""
    return (F.col(column) == path) | F.col(column).endswith("/" + path)


def after(columns: list[str], values: list, descending: bool = False) -> Column:
    """Rows behind a keyset position: (a, b) > (x, y), spelled out so that it reaches the scan."""
    beyond = operator.lt if descending else operator.gt
    out = F.lit(False)
    for i, (c, v) in enumerate(zip(columns, values, strict=True)):
        same = functools.reduce(operator.and_, [F.col(a) == b for a, b in zip(columns[:i], values[:i], strict=True)], F.lit(True))
        out = out | (same & beyond(F.col(c), F.lit(v)))
    return out


def at_least(column: str, severity: str | None) -> Column | None:
    return severity_rank(F.col(column)) >= SEVERITIES.index(severity) + 1 if severity else None


def page(df: DataFrame, order: list[str], size: int, position: list | None = None, descending: bool = False) -> DataFrame:
    """The next size rows behind a position."""
    if position is not None:
        df = df.where(after(order, position, descending))
    return df.orderBy(*(F.col(c).desc() if descending else F.col(c).asc() for c in order)).limit(size)
