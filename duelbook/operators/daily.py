"""Daily per-player and per-rival results and their report lines (AGG13, AGG14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.functions.results import DRAW
from duelbook.functions.times import local_date
from duelbook.operators import filters, segments
from duelbook.operators.runs import runs


def _with_day(df: DataFrame, day: Column | None) -> DataFrame:
    rows = filters.identified(filters.valid_results(df))
    return rows.withColumn("date", local_date(F.col("ts")) if day is None else day)


PLAYER_DAY = ["league", "date", "player_key", "player"]
RIVAL_DAY = [*PLAYER_DAY, "rival_key", "rival"]


def daily_players(df: DataFrame, day: Column | None = None, text: bool = False) -> DataFrame:
    """(league, date, player_key, player) with the summary of the local day (see ``segments``) and ``current_streak``, its trailing no-draw run.

    With ``text`` also ``seq``, the whole day in one value, for a day's report and whatever else prints it; ``daily_sequences`` has it by hour.
    """
    return _days(df, PLAYER_DAY, day, text).withColumn("current_streak", segments.drawless_run())


def daily_rivals(df: DataFrame, day: Column | None = None, text: bool = False) -> DataFrame:
    """The same per rival: (league, date, player_key, player, rival_key, rival)."""
    return _days(df, RIVAL_DAY, day, text)


def _days(df: DataFrame, keys: list[str], day: Column | None, text: bool) -> DataFrame:
    return segments.summary(_with_day(df, day), keys, text=text)


def daily_sequences(df: DataFrame, day: Column | None = None, rivals: bool = False) -> DataFrame:
    """(league, date, player_key, player[, rival_key, rival], slice, n, seq): the results of a day as text, a row per hour."""
    return segments.sequences(_with_day(df, day), RIVAL_DAY if rivals else PLAYER_DAY, "hour")


def daily_no_draw_runs(df: DataFrame, day: Column | None = None) -> DataFrame:
    """(league, date, player_key, player, streak, ended): every no-draw run of every day, from the rows; ``ended`` when a draw followed that day."""
    r = runs(_with_day(df, day), PLAYER_DAY, F.col("result") != DRAW, slice_by="hour").filter("value")
    return r.select(*PLAYER_DAY, F.col("length").cast("int").alias("streak"), (~F.col("is_last")).alias("ended"))


def pct1(n: Column, d: Column) -> Column:
    """Percentage with one decimal, half-even in integer arithmetic (report lines)."""
    n, d = n.cast("long"), d.cast("long")
    top = n * 2000 + d
    q = F.call_function("div", top, d * 2)
    return (q - F.when((top % (d * 2) == 0) & (q % 2 == 1), 1).otherwise(0)) / F.lit(10.0)


def rival_line() -> Column:
    """``rival: n (w%/d%/l%) [sequence]``."""
    shown = [F.format_string("%.1f%%", pct1(F.col(c), F.col("played"))) for c in ("wins", "draws", "losses")]
    return F.concat(F.col("rival"), F.lit(": "), F.col("played").cast("string"), F.lit(" ("),
                    F.concat_ws("/", *shown), F.lit(") ["), F.col("seq"), F.lit("]"))
