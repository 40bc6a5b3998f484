"""Player-name folding (SC1, SC2, SC9, SC18).

Full Unicode case folding (``ß`` -> ``ss``) has no built-in Spark function, so
``name_key`` is an Arrow UDF.  It belongs at ingest: queries compare the stored
``player_key`` / ``rival_key`` columns and stay inside the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from duelbook.functions.binding import bind
from duelbook.functions.params import non_blank


def fold_name(value: str) -> str:
    """Key of a literal name given by the caller (driver side)."""
    return unicodedata.normalize("NFKC", non_blank(value, "name")).casefold()


def tidy_name(value: str) -> str:
    return unicodedata.normalize("NFKC", non_blank(value, "name"))


def _mapped(names: pd.Series, fn) -> pd.Series:
    # Names repeat heavily: fold each distinct spelling of the batch once.
    distinct = {n: fn(n) for n in names.dropna().unique()}
    return names.map(distinct).astype(object).where(names.notna(), None)


@F.pandas_udf(StringType())
def clean_name(names: pd.Series) -> pd.Series:
    """Strip, then NFKC; blank names become NULL."""
    return _mapped(names, lambda n: unicodedata.normalize("NFKC", n.strip()) or None)


@F.pandas_udf(StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Strip, NFKC, casefold; blank names become NULL."""
    return _mapped(names, lambda n: unicodedata.normalize("NFKC", n.strip()).casefold() or None)


def perspective_id(match_id: Column, player_key: Column) -> Column:
    return F.concat_ws(":", match_id, player_key)


def league_name(league: Column) -> Column:
    """Comparable league name: trimmed upper case; blank becomes NULL."""
    trimmed = F.upper(F.trim(league))
    return F.when(trimmed != "", trimmed)


def player_in_parentheses(label: Column) -> Column:
    """``Team (Player)`` -> ``Player``; NULL without both parentheses or for an e-sport team."""
    def inside(s: Column) -> Column:
        both = F.contains(s, F.lit("(")) & F.contains(s, F.lit(")"))
        return F.when(both, F.trim(F.replace(F.split_part(s, F.lit("("), F.lit(2)), F.lit(")"), F.lit(""))))

    return bind(bind(label, inside), lambda s: F.when((s != "") & ~F.contains(F.lower(s), F.lit("esport")), s))


def group_slug(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: F.lower(F.trim(m))), "-")


def group_label(members: Column) -> Column:
    return F.array_join(members, " / ")
