"""H2H alerts: strong directed relations of a group with their recent form (SC15, SRT5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.functions.names import name_key
from duelbook.functions.results import delta2, trend
from duelbook.operators import filters
from duelbook.operators.h2h import RELATION, relation_rows
from duelbook.operators.recent import PCTS, window_rows

MIN_WIN_PCT = 48
STRONG_WIN_PCT = 50
MIN_MATCHES = 20
RECENT_WINDOW = 20
TREND_THRESHOLD = 5.0


def h2h_alerts(h2h: DataFrame, names: DataFrame, history: DataFrame, *, bettable: DataFrame | None = None,
               excluded: DataFrame | None = None, min_win_pct: float = MIN_WIN_PCT, recent_window: int = RECENT_WINDOW) -> DataFrame:
    """Relations of ``h2h`` (group totals) at or above the win rate, each with its last results and its last-N history form.

    ``names`` gives group_id and label per (league, group_no). Relations meet the history by the folded keys that ``h2h`` carries;
    names are folded here only where it has none.
    """
    rows = h2h.filter(F.col("win_pct") >= min_win_pct)
    if "player_key" not in rows.columns:
        rows = rows.withColumns({"player_key": name_key("player"), "rival_key": name_key("rival")})
    if bettable is not None:
        rows = filters.only_identities(rows, bettable)
    if excluded is not None:
        barred = excluded.select("league", F.col("player_key").alias("rival_key")).distinct()
        rows = rows.join(barred, ["league", "rival_key"], "left_anti")
        history = filters.operational(history, excluded)
    recent = window_rows(
        relation_rows(history).join(rows.select(*RELATION).distinct(), RELATION, "left_semi"),
        RELATION, [recent_window], ["player"])
    recent = recent.select(*RELATION, *[F.col(c).alias(f"recent_{c}") for c in ("available", "sequence", "wins", "draws", "losses", *PCTS)])
    j = rows.join(recent, RELATION, "left").fillna(
        {**{f"recent_{c}": 0 for c in ("available", "wins", "draws", "losses")},
         **{f"recent_{c}": 0.0 for c in PCTS}, "recent_sequence": ""})
    j = j.join(names.select("league", "group_no", "group_id", "label"), ["league", "group_no"])
    n = F.col("recent_available")
    change = F.when(n > 0, delta2(F.col("recent_win_pct"), F.col("win_pct"))).otherwise(F.lit(0.0))
    status = F.when(n == 0, F.lit("EMPTY")).when(n < recent_window, F.lit("LOW_SAMPLE")).otherwise(F.lit("COMPLETE"))
    few = F.col("matches") < MIN_MATCHES
    out = j.withColumns({
        "signal": F.when(F.col("win_pct") >= STRONG_WIN_PCT, F.lit("STRONG")).otherwise(F.lit("WATCH")),
        "confidence": F.when(few, F.lit("LOW SAMPLE")).otherwise(F.lit("HIGH")), "low_sample": few,
        "recent_window": F.lit(recent_window), "recent_win_pct_delta": change,
    }).withColumns({
        "recent_trend": trend(F.col("recent_win_pct_delta"), n, TREND_THRESHOLD), "recent_sample_status": status,
        "recent_window_complete": n >= recent_window,
    })
    return out.select(
        "league", "group_id", F.col("label").alias("group"), "player_key", "rival_key", "player", "rival", "wins", "draws", "losses", "matches",
        "win_pct", "draw_pct", "loss_pct", "last5", "last10", "win_run", "unbeaten_run", *[c for c in ("seq",) if c in h2h.columns],
        "signal", "confidence", "low_sample", "recent_window", "recent_available", "recent_sequence", "recent_wins",
        "recent_draws", "recent_losses", "recent_win_pct", "recent_draw_pct", "recent_loss_pct",
        "recent_win_pct_delta", "recent_trend", "recent_sample_status", "recent_window_complete")


def alert_order() -> list[Column]:
    return [F.col("confidence") != "HIGH", F.desc("win_pct"), F.desc("matches"), F.col("player"), F.col("rival")]
