"""The operational snapshot of the last hours and the candidates drawn from it (AGG22-AGG25, SRT3, SRT4, JN3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook import schemas
from duelbook.functions.params import positive_int
from duelbook.functions.names import name_key
from duelbook.functions.results import balance, indicator
from duelbook.operators import filters, segments
from duelbook.operators.sessions import SESSION_GAP_MINUTES, session_counts
from duelbook.operators.totals import KEYS, with_pcts

WINDOW_HOURS = 8
MAX_CANDIDATES = 8
MIN_PLAYED = 5


def snapshot_rows(df: DataFrame, tracked: DataFrame, *, reference_time, window_hours: int = WINDOW_HOURS, excluded: DataFrame | None = None) -> DataFrame:
    """The matches of bettable tracked players in the window.

    The time bound is applied first and reaches the scan; the tracked list is a semi-join.
    """
    recent = filters.trailing_hours(df, reference_time, window_hours)
    excluded = filters.excluded_keys(tracked) if excluded is None else excluded
    return filters.only_identities(filters.operational_results(recent, excluded), filters.bettable_keys(tracked))


def snapshot_sequences(df: DataFrame, tracked: DataFrame, **how) -> DataFrame:
    """(league, player_key, slice, n, seq): the results behind a snapshot as text, a row per player and hour."""
    return segments.sequences(snapshot_rows(df, tracked, **how), KEYS, "hour")


def snapshot(df: DataFrame, tracked: DataFrame, *, reference_time, window_hours: int = WINDOW_HOURS,
             excluded: DataFrame | None = None, text: bool = False) -> DataFrame:
    """One row per bettable tracked player with matches in ``[reference - hours, reference]``; with ``text`` also ``sequence``, all its results."""
    rows = snapshot_rows(df, tracked, reference_time=reference_time, window_hours=window_hours, excluded=excluded)
    s = segments.summary(rows, KEYS, text=text).transform(with_pcts)
    names = tracked.filter(F.col("tracked") & F.coalesce("bettable", F.lit(True))).groupBy(*KEYS).agg(
        F.min_by(F.struct("player", "group_index"), "pos").alias("t"))
    mark = indicator(F.col("wins"), F.col("draws"), F.col("losses"))
    return s.join(names, KEYS).withColumns({
        "player": F.col("t.player"), "group_index": F.col("t.group_index"),
        "current_streak_result": segments.last_result(), "current_streak": segments.same_run(),
        "indicator": mark, "balance": balance(mark, F.lit(True)), "tracked": F.lit(True),
    }).select(*schemas.SNAPSHOT, *([F.col("seq").alias("sequence")] if text else []))


def snapshot_order() -> list[Column]:
    return [F.col("league"), F.col("wins").desc(), F.col("win_pct").desc(), F.col("played").desc(),
            F.lower("player"), F.col("player_key")]


def snapshot_with_sessions(df: DataFrame, tracked: DataFrame, *, reference_time, window_hours: int = WINDOW_HOURS,
                           session_gap_minutes: int = SESSION_GAP_MINUTES, excluded: DataFrame | None = None, text: bool = False) -> DataFrame:
    """Snapshot plus ``session_number``: the count of sessions in the full history (AGG24)."""
    excluded = filters.excluded_keys(tracked) if excluded is None else excluded
    s = snapshot(df, tracked, reference_time=reference_time, window_hours=window_hours, excluded=excluded, text=text)
    rows = filters.only_identities(filters.operational_results(df, excluded), filters.bettable_keys(tracked))
    return s.join(session_counts(rows, session_gap_minutes), KEYS, "left").select(*s.columns, "session_number")


def candidates(snap: DataFrame, excluded: DataFrame | None = None, limit: int | None = MAX_CANDIDATES,
               min_played: int = MIN_PLAYED) -> DataFrame:
    """The strongest GREEN/RED players of a snapshot; exclusions apply before the cap.

    ``limit=None`` gives every eligible player.
    """
    eligible = snap.filter((F.col("played") >= min_played) & F.col("indicator").isin("GREEN", "RED"))
    if excluded is not None:
        eligible = eligible.join(excluded.select(*KEYS).distinct(), KEYS, "left_anti")
    cols = [*KEYS, "player", "indicator", "wins", "draws", "losses", "played", "win_pct", "loss_pct"]
    eligible = eligible.select(*cols)
    if limit is None:
        return eligible
    shown = F.when(F.col("indicator") == "GREEN", F.col("win_pct")).otherwise(F.col("loss_pct"))
    order = [shown.desc(), F.col("played").desc(), "league", F.lower("player"), "player_key"]
    return eligible.orderBy(*order).limit(positive_int(limit, "limit"))


def manual_candidates(tracked: DataFrame, selected: DataFrame, snap: DataFrame | None = None,
                      excluded: DataFrame | None = None) -> DataFrame:
    """Selected bettable players, with their snapshot numbers where they have any."""
    chosen = tracked.filter(F.col("tracked") & F.coalesce("bettable", F.lit(True)))
    chosen = filters.only_identities(chosen, selected)
    if excluded is not None:
        chosen = chosen.join(excluded.select(*KEYS).distinct(), KEYS, "left_anti")
    chosen = chosen.groupBy(*KEYS).agg(F.min_by("player", "pos").alias("player"))
    numbers = ["indicator", "wins", "draws", "losses", "played", "win_pct", "loss_pct"]
    if snap is None:
        out = chosen.withColumns({"indicator": F.lit("NONE"), **{c: F.lit(0) for c in numbers[1:5]},
                                  **{c: F.lit(0.0) for c in numbers[5:]}})
    else:
        out = chosen.join(snap.select(*KEYS, *numbers), KEYS, "left").fillna(
            {"indicator": "NONE", **{c: 0 for c in numbers[1:5]}, **{c: 0.0 for c in numbers[5:]}})
    return out.select(*KEYS, "player", *numbers)


def flagged_candidates(tracked: DataFrame) -> DataFrame:
    """Players carrying the older ``selected`` flag, without numbers."""
    return manual_candidates(tracked.filter("selected").withColumns({"tracked": F.lit(True), "bettable": F.lit(True)}),
                             filters.selected_keys(tracked))


def current_streak_panel(history: DataFrame, daily: DataFrame, tracked: DataFrame, day=None, text: bool = False) -> DataFrame:
    """Streak panel of one local day: tracked players rebuilt from the history, others from the daily report.

    ``daily``: the day's rows of ``daily_players``, or league, player, player_key, wins, draws, losses, seq of a report's text.
    With ``day=None`` (undated report) the report rows of tracked players are kept instead. ``text`` adds ``sequence``, the
    day's results; ``daily`` then holds them as ``seq``.
    """
    bettable, excluded = filters.bettable_keys(tracked), filters.excluded_keys(tracked)
    if "last_E" not in daily.columns:
        daily = segments.of_text(daily)

    def marked(rows: DataFrame) -> DataFrame:
        return rows.select(*KEYS, "player", "wins", "draws", "losses", "played", "last_24", *([F.col("seq").alias("sequence")] if text else []), "tracked", segments.winless_run().alias("winless_run"),
                           segments.unbeaten_run().alias("unbeaten_run"), segments.drawless_run().alias("drawless_run"))

    report = daily.join(excluded, KEYS, "left_anti").join(bettable.withColumn("tracked", F.lit(True)), KEYS, "left").fillna({"tracked": False})
    rows = marked(report)
    if day is not None:
        own = filters.only_identities(filters.operational_results(filters.on_local_day(history, day), excluded), bettable)
        names = tracked.filter("tracked").groupBy(*KEYS).agg(F.min_by("player", "pos").alias("player"))
        rebuilt = segments.summary(own, KEYS, text=text).join(names, KEYS).withColumn("tracked", F.lit(True))
        rows = rows.filter(~F.col("tracked")).unionByName(marked(rebuilt))
    return rows.withColumn("balance", balance(indicator(F.col("wins"), F.col("draws"), F.col("losses")), F.col("tracked")))


def with_status(alerts: DataFrame, panel: DataFrame) -> DataFrame:
    """Attach the panel's balance mark to rows by league and player key (JN10); names are folded where rows have no key."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_k", F.col("player_key") if "player_key" in df.columns else name_key("player"))

    status = keyed(panel).groupBy("league", "_k").agg(F.max("balance").alias("status"))
    out = keyed(alerts).join(status, ["league", "_k"], "left").drop("_k")
    return out.withColumn("player_with_status", F.trim(F.concat_ws(" ", F.when(F.col("status") != "", F.col("status")), F.col("player"))))
