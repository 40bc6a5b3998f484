"""Gap-delimited playing sessions (WIN8, AGG23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelbook import schemas
from duelbook.functions.names import league_name
from duelbook.functions.params import positive_int
from duelbook.functions.results import balance, indicator
from duelbook.functions.times import iso_local, iso_z, micros, time_slice, utc_literal
from duelbook.operators import filters, segments
from duelbook.operators.runs import ORDER
from duelbook.operators.totals import KEYS, with_pcts

SESSION_GAP_MINUTES = 90
ACTIVE_WINDOW_MINUTES = 180


def session_parts(df: DataFrame, gap_minutes: int, slice_by: str = "day", tie_prefix: int = 0) -> DataFrame:
    """The rows with the ``slice`` they lie in and the number of their part of a session in it, ``local``."""
    w = Window.partitionBy(*KEYS, "slice").orderBy(*ORDER)
    rows = df.select(*KEYS, *ORDER, "result", "player", time_slice(slice_by, tie_prefix).alias("slice"))
    at = micros(F.col("ts"))
    rows = rows.withColumn("_gap", (at - F.lag(at).over(w) > gap_minutes * 60_000_000).cast("int"))
    return rows.withColumn("local", F.coalesce(F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_gap")


def _numbered(parts: DataFrame, gap_minutes: int) -> DataFrame:
    """Summaries or other aggregates of parts (KEYS, slice, local, start, end) with their session's number.

    Parts of one identity lie more than the gap apart or on slice borders, so the window sees a number of rows set by the calendar.
    """
    w = Window.partitionBy(*KEYS).orderBy("slice", "local")
    apart = micros(F.col("start")) - micros(F.lag("end").over(w)) > gap_minutes * 60_000_000
    return parts.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "session_number", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def numbered_sessions(df: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, text: bool = False, **kwargs) -> DataFrame:
    """One row per session: keys, session_number, and the summary of its results (see ``segments``), with the latest player name.

    A session starts when the gap is longer than ``gap_minutes``; an equal gap continues it. With ``text`` also ``seq``, its results.
    """
    positive_int(gap_minutes, "session_gap_minutes")
    parts = segments.summarised(session_parts(df, gap_minutes, **kwargs), KEYS, ["local"], ["player"], text)
    sessions = segments.merged(_numbered(parts, gap_minutes), [*KEYS, "session_number"], ["slice", "local"])
    return sessions.withColumn("player", F.col("latest.player")).drop("latest")


def session_sequences(df: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, slice_by: str = "hour") -> DataFrame:
    """(keys, session_number, start, played, seq): the results of every session as text, a row per part of a session in a slice."""
    positive_int(gap_minutes, "session_gap_minutes")
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, "result")))
    parts = session_parts(df, gap_minutes, slice_by).groupBy(*KEYS, "slice", "local").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("played"),
        F.array_join(F.transform(ordered, lambda r: r["result"]), "").alias("seq"))
    return _numbered(parts, gap_minutes).select(*KEYS, "session_number", "start", "played", "seq")


def session_counts(df: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, **kwargs) -> DataFrame:
    """(league, player_key, sessions): how many sessions each player has had."""
    positive_int(gap_minutes, "session_gap_minutes")
    parts = session_parts(df, gap_minutes, **kwargs).groupBy(*KEYS, "slice", "local").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return _numbered(parts, gap_minutes).groupBy(*KEYS).agg(F.max("session_number").alias("session_number"))


def player_sessions(df: DataFrame, tracked: DataFrame | None = None, *, reference_time,
                    gap_minutes: int = SESSION_GAP_MINUTES, active_window_minutes: int = ACTIVE_WINDOW_MINUTES,
                    excluded: DataFrame | None = None, text: bool = False, **kwargs) -> DataFrame:
    """Every session of every player with its statistics; the balance mark only for tracked players. With ``text`` also ``sequence``, all its results."""
    positive_int(active_window_minutes, "active_window_minutes")
    rows = filters.operational_results(df, excluded)
    s = numbered_sessions(rows, gap_minutes, text, **kwargs).transform(with_pcts)
    if tracked is None:
        s = s.withColumn("tracked", F.lit(False))
    else:
        keys = filters.bettable_keys(tracked).withColumn("tracked", F.lit(True))
        s = s.join(keys, KEYS, "left").fillna({"tracked": False})
    ref = micros(utc_literal(reference_time))
    idle = ref - micros(F.col("end"))
    stamp = F.replace(F.replace(iso_z(F.col("start"), "second"), F.lit("-"), F.lit("")), F.lit(":"), F.lit(""))
    return s.withColumns({
        "session_id": F.concat_ws(":", F.lower(league_name(F.col("league"))), F.col("player_key"), stamp),
        "player": F.trim("player"), "start_timestamp": iso_z(F.col("start")), "end_timestamp": iso_z(F.col("end")),
        "start_local": iso_local(F.col("start")), "end_local": iso_local(F.col("end")),
        "duration_minutes": F.floor((micros(F.col("end")) - micros(F.col("start"))) / 60_000_000),
        "current_streak_result": segments.last_result(), "current_streak": segments.same_run(),
        "balance": balance(indicator(F.col("wins"), F.col("draws"), F.col("losses")), F.col("tracked")),
        "active": (idle >= 0) & (idle <= active_window_minutes * 60_000_000),
    }).select(*schemas.SESSION, *([F.col("seq").alias("sequence")] if text else []))
