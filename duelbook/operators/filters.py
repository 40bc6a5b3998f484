"""History queries: league, player, rival, time and identity-set filters (FLT1-FLT14, WIN1, SRT1).

All filters are plain predicates on stored columns, so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.functions.names import fold_name, league_name
from duelbook.functions.params import non_blank, non_negative_int, positive_int
from duelbook.functions.results import is_valid
from duelbook.functions.times import local_date, parse_utc, utc_datetime, utc_literal
from duelbook.operators.runs import latest_first

IDENTITY = ("league", "player_key")


def chronological(df: DataFrame) -> DataFrame:
    """Presentation order; a global sort, meant for the end of a query."""
    return df.orderBy("ts", "match_id", "player_key", "perspective_id")


def numbered(df: DataFrame) -> DataFrame:
    """Rows with ``position``, their place in presentation order (from 1), without sorting everything in one task.

    Rows are ranked inside their hour; a row per hour carries how many come before.
    """
    rows = df.withColumn("_hour", F.date_trunc("hour", "ts"))
    rank = F.row_number().over(Window.partitionBy("_hour").orderBy("ts", "match_id", "player_key", "perspective_id"))
    hours = rows.groupBy("_hour").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_hour").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    hours = hours.select("_hour", before.alias("_before"))
    return rows.withColumn("_rank", rank).join(hours, "_hour").withColumn("position", F.col("_before") + F.col("_rank")).drop("_hour", "_rank", "_before")


def by_league(df: DataFrame, league: str) -> DataFrame:
    return df.filter(F.lower(F.trim("league")) == non_blank(league, "league").lower())


def by_player(df: DataFrame, player: str, league: str | None = None) -> DataFrame:
    """A player's own perspectives."""
    own = df.filter(F.col("player_key") == fold_name(player))
    return own if league is None else by_league(own, league)


def by_rivalry(df: DataFrame, player: str, rival: str, league: str | None = None) -> DataFrame:
    """One direction: the player's perspectives against the rival."""
    return by_player(df, player, league).filter(F.col("rival_key") == fold_name(rival))


def head_to_head(df: DataFrame, a: str, b: str, league: str | None = None) -> DataFrame:
    """Both directions between two players."""
    ka, kb = fold_name(a), fold_name(b)
    pk, rk = F.col("player_key"), F.col("rival_key")
    both = df.filter(((pk == ka) & (rk == kb)) | ((pk == kb) & (rk == ka)))
    return both if league is None else by_league(both, league)


def by_time(df: DataFrame, start=None, end=None, field: str = "ts") -> DataFrame:
    """Inclusive bounds.  Rows whose stamp is missing or unparsable go only if a bound is given."""
    non_blank(field, "field")
    lo = None if start is None else utc_datetime(start)
    hi = None if end is None else utc_datetime(end)
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("start must not be later than end")
    stamp = F.col(field) if dict(df.dtypes)[field] == "timestamp_ntz" else parse_utc(F.col(field))
    if lo is not None:
        df = df.filter(stamp >= utc_literal(lo))
    if hi is not None:
        df = df.filter(stamp <= utc_literal(hi))
    return df


def trailing_hours(df: DataFrame, reference_time, hours: int = 8) -> DataFrame:
    """``[reference - hours, reference]``, both ends included (FLT10)."""
    positive_int(hours, "window_hours")
    ref = utc_literal(reference_time)
    return df.filter(F.col("ts").between(ref - F.expr(f"INTERVAL {hours} HOURS"), ref))


def on_local_day(df: DataFrame, day) -> DataFrame:
    """Rows of one Madrid calendar day (FLT11).

    The UTC range of the day is a plain bound on ``ts`` that the scan can use.
    """
    d = F.to_date(F.lit(str(day)))
    wide = df.filter(F.col("ts").between(F.date_sub(d, 1).cast("timestamp_ntz"), F.date_add(d, 2).cast("timestamp_ntz")))
    return wide.filter(local_date(F.col("ts")) == d)


def latest(df: DataFrame, limit: int, player: str | None = None, league: str | None = None) -> DataFrame:
    """The latest N perspectives after filtering, in rising order (WIN1); a top-N, never a full sort."""
    non_negative_int(limit, "limit")
    if player is not None:
        df = by_player(df, player)
    if league is not None:
        df = by_league(df, league)
    order = [F.col("ts").desc(), F.col("match_id").desc(), F.col("player_key").desc(), F.col("perspective_id").desc()]
    return df.orderBy(*order).limit(limit).orderBy("ts", "match_id", "player_key", "perspective_id")


def valid_results(df: DataFrame) -> DataFrame:
    return df.filter(is_valid(F.col("result")))


def identified(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose identity columns are not blank, with the league in its comparable form."""
    cols = columns or IDENTITY
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.trim(c) != "")
    return df.filter(ok).withColumn("league", league_name(F.col("league")))


# --- identity sets -----------------------------------------------------------

def identity_set(tracked: DataFrame, condition: Column) -> DataFrame:
    return tracked.filter(condition).select(*IDENTITY).distinct()


def tracked_keys(tracked: DataFrame) -> DataFrame:
    return identity_set(tracked, F.col("tracked"))


def bettable_keys(tracked: DataFrame) -> DataFrame:
    return identity_set(tracked, F.col("tracked") & F.coalesce("bettable", F.lit(True)))


def excluded_keys(tracked: DataFrame) -> DataFrame:
    return identity_set(tracked, F.col("tracked") & ~F.coalesce("bettable", F.lit(True)))


def selected_keys(tracked: DataFrame) -> DataFrame:
    return identity_set(tracked, F.col("selected"))


def only_identities(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Semi-join on the identity (JN1).  No hint: Spark broadcasts the list only if its size allows."""
    return df.join(keys.select(*IDENTITY), list(IDENTITY), "left_semi")


def operational(df: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Identified rows in which neither player nor rival is excluded (FLT6, JN2)."""
    rows = identified(df, "league", "player_key", "rival_key")
    if excluded is None:
        return rows
    ex = excluded.select(*IDENTITY).distinct()
    rows = rows.join(ex, list(IDENTITY), "left_anti")
    return rows.join(ex.withColumnRenamed("player_key", "rival_key"), ["league", "rival_key"], "left_anti")


def operational_results(df: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Operational rows with a valid result and a known time (FLT8, FLT9)."""
    return valid_results(operational(df, excluded)).filter(F.col("ts").isNotNull())
