"""Columns computed exactly once.

Catalyst copies a column's expression into every filter and projection that uses it.  For a
cascade of regular expressions that would multiply both plan and work.  A generator over a
one-element array is a place it does not cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns (replacing same-named ones), each evaluated once per row."""
    keep = [c for c in df.columns if c not in cols]
    row = F.struct(*[e.alias(n) for n, e in cols.items()])
    return df.select(*keep, F.inline(F.array(row)).alias(*cols)) if len(cols) > 1 else df.select(
        *keep, F.explode(F.array(next(iter(cols.values())))).alias(next(iter(cols))))


def in_turn(df: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    """As :func:`once` with all columns of the groups, one group after the other; all read the columns as they are in ``df``.

    Each group becomes a method of its own in the generated code.  The JVM never compiles a method that is too long, and
    runs a cascade in a single one many times slower.
    """
    new = {n: f"_new_{n}" for g in groups for n in g}
    keep = [c for c in df.columns if c not in new]
    for g in groups:
        if g:
            df = once(df, **{new[n]: c for n, c in g.items()})
    return df.select(*keep, *[F.col(c).alias(n) for n, c in new.items()])
