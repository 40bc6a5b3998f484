"""Directional head-to-head statistics (AGG3-AGG5, WIN2c, WIN2d)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook import schemas
from duelbook.functions.params import non_negative_number, positive_int
from duelbook.functions.results import RESULTS, count_of, sample_status, trend
from duelbook.operators import filters, segments
from duelbook.operators.recent import recent_and_history, window_rows
from duelbook.operators.runs import ORDER
from duelbook.operators.totals import with_pcts

RELATION = ["league", "player_key", "rival_key"]
DEFAULT_WINDOW = 20
TREND_THRESHOLD = 5.0


def relation_rows(df: DataFrame, league: str | None = None, player: str | None = None, rival: str | None = None) -> DataFrame:
    if player is not None and rival is not None:
        df = filters.by_rivalry(df, player, rival)
    elif player is not None:
        df = filters.by_player(df, player)
    if league is not None:
        df = filters.by_league(df, league)
    return filters.identified(df, *RELATION, "player", "rival")


def h2h_totals(df: DataFrame, league: str | None = None, player: str | None = None, rival: str | None = None, *,
               keep_keys: bool = False, text: bool = False) -> DataFrame:
    """Totals and date range of every directed relation, one row each; with ``text`` also ``sequence``, all its results.

    A plain aggregation that combines before the shuffle, so a relation of any size travels as a row per task. The text, a byte per
    result, is made by month and put together from the months.
    """
    rows = filters.valid_results(relation_rows(df, league, player, rival))
    stats = rows.groupBy(*RELATION).agg(
        *[count_of(v).alias(c) for c, v in zip(("wins", "draws", "losses"), RESULTS)], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max(F.struct(*ORDER, "player", "rival")).alias("last"))
    stats = stats.withColumn("played", F.col("wins") + F.col("draws") + F.col("losses")).transform(with_pcts)
    if text:
        stats = stats.join(segments.joined_text(segments.sequences(rows, RELATION, "month"), RELATION), RELATION)
    return stats.withColumns({
        "player": F.trim("last.player"), "rival": F.trim("last.rival"),
        "first_match_date": F.col("first_ts").cast("date").cast("string"),
        "last_match_date": F.col("last_ts").cast("date").cast("string"),
    }).select(*(RELATION[1:] if keep_keys else []), *schemas.H2H_TOTALS, *(["sequence"] if text else []))


def h2h_sequences(df: DataFrame, league: str | None = None, player: str | None = None, rival: str | None = None) -> DataFrame:
    """(league, player_key, rival_key, slice, n, seq): the results of every directed relation as text, a row per relation and month."""
    return segments.sequences(filters.valid_results(relation_rows(df, league, player, rival)), RELATION, "month")


def h2h_recent(df: DataFrame, window: int = DEFAULT_WINDOW, league: str | None = None, player: str | None = None,
               rival: str | None = None) -> DataFrame:
    """The latest N valid matches of every directed relation.

    The rival's spelling is that of the latest row, with or without a valid result.
    """
    rows = relation_rows(df, league, player, rival)
    stats = window_rows(rows, RELATION, [positive_int(window, "window")], ["player"])
    spelling = rows.groupBy(*RELATION).agg(F.max_by(F.trim("rival"), F.struct(*ORDER)).alias("rival"))
    return stats.join(spelling, RELATION).withColumn(
        "window_complete", F.col("available") >= F.col("window")).select(*schemas.H2H_RECENT)


def h2h_comparison(df: DataFrame, window: int = DEFAULT_WINDOW, league: str | None = None, player: str | None = None,
                   rival: str | None = None, *, min_historical_matches: int = 1,
                   trend_threshold: float = TREND_THRESHOLD) -> DataFrame:
    """Recent against full history for every directed relation with enough matches."""
    positive_int(window, "window")
    positive_int(min_historical_matches, "min_historical_matches")
    threshold = non_negative_number(trend_threshold, "trend_threshold")
    rows = recent_and_history(relation_rows(df, league, player, rival), RELATION, [window], ["player", "rival"])
    return rows.filter(F.col("historical_played") >= min_historical_matches).withColumns({
        "trend": trend(F.col("win_pct_delta"), F.col("recent_available"), threshold),
        "sample_status": sample_status(F.col("recent_available"), F.lit(window)),
    }).select(*schemas.H2H_COMPARISON)


def h2h_for(df: DataFrame, wanted: DataFrame, text: bool = False) -> DataFrame:
    """H2H totals of the wanted relations (league, player, player_key, rival, rival_key); zero rows where unknown."""
    keys = wanted.select(*RELATION).distinct()
    known = h2h_totals(filters.identified(df, *RELATION).join(keys, RELATION, "left_semi"), keep_keys=True, text=text)
    asked = wanted.select(*RELATION, F.trim("player").alias("a_player"), F.trim("rival").alias("a_rival"))
    j = asked.join(known.withColumnsRenamed({"player": "k_player", "rival": "k_rival"}), RELATION, "left")
    zeros = {c: 0 for c in ("played", "wins", "draws", "losses")} | {c: 0.0 for c in ("win_pct", "draw_pct", "loss_pct")} | ({"sequence": ""} if text else {})
    return j.fillna(zeros).withColumns({
        "player": F.coalesce("k_player", "a_player"), "rival": F.coalesce("k_rival", "a_rival"),
    }).select(*schemas.H2H_TOTALS, *(["sequence"] if text else []))
