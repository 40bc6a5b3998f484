"""Load and compute in one call: the stored history and the tracked list to current streaks and coincident pairs (SRC16)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from duelbook.operators import filters, pairing, snapshot
from duelbook.sources.history import read_history
from duelbook.sources.tracked import load_directives, load_tracked


def load_current_streaks(spark: SparkSession, history_path: str, tracked_path: str, *, reference_time: datetime | None = None, **kwargs) -> DataFrame:
    """The operational snapshot of the tracked list with session numbers, at ``reference_time`` (now)."""
    at = reference_time or datetime.now(timezone.utc)
    return snapshot.snapshot_with_sessions(read_history(spark, history_path), load_tracked(spark, tracked_path), reference_time=at, **kwargs)


def choose_candidates(tracked: DataFrame, directives: DataFrame, snap: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(selected, eligible, mode): the players of select directives if there are any, else the strongest of the snapshot.

    Exclude directives hold in both modes. Only the automatic choice has a limit.
    """
    barred = directives.filter("kind = 'excluded'").select("league", "player_key")
    named = directives.filter("kind = 'selected'").select("league", "player_key")
    if named.isEmpty():
        return snapshot.candidates(snap, barred), snapshot.candidates(snap, barred, limit=None), "automatic"
    return snapshot.manual_candidates(tracked, named, snap, barred), named, "manual"


def load_coincident_pairs(spark: SparkSession, history_path: str, tracked_path: str, *, reference_time: datetime | None = None,
                          max_gap_minutes: int = pairing.MAX_GAP_MINUTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pair headers, matches, selection metadata) of the operational window before ``reference_time`` (now)."""
    at = reference_time or datetime.now(timezone.utc)
    history, tracked, directives = read_history(spark, history_path), load_tracked(spark, tracked_path), load_directives(spark, tracked_path)
    excluded = filters.excluded_keys(tracked)
    snap = snapshot.snapshot(history, tracked, reference_time=at, excluded=excluded)
    selected, eligible, mode = choose_candidates(tracked, directives, snap)
    headers, matches = pairing.coincident_analysis(history, selected, reference_time=at, max_gap_minutes=max_gap_minutes, excluded=excluded)
    barred = directives.filter("kind = 'excluded'").select("league", "player_key")
    return headers, matches, pairing.selection_metadata(eligible, selected, mode, barred)
