"""Evaluate-once binding for expressions that use a costly value several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Spark substitutes projected expressions into later filters and projections, which
    repeats a regular-expression chain at every mention; a lambda variable is a value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def select_once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select(*columns)`` whose results later filters refer to instead of recomputing them."""
    return df.select(F.inline(F.array(F.struct(*columns))))
