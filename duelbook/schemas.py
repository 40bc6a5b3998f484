"""Explicit schemas and output column orders."""

from __future__ import annotations

from pyspark.sql import types as T


def _f(name: str, dtype) -> T.StructField:
    return T.StructField(name, dtype, True)


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()

# The stored perspective, required then optional fields.
HISTORY_FIELDS = [
    _f("schema_version", _I), _f("league", _S), _f("match_id", _S), _f("perspective_id", _S),
    _f("player", _S), _f("player_key", _S), _f("rival", _S), _f("rival_key", _S), _f("result", _S),
    _f("timestamp", _S), _f("timestamp_utc", _S), _f("timestamp_precision", _S), _f("timezone", _S),
    _f("timezone_inferred", _B), _f("home_away", _S), _f("home_score", _I), _f("away_score", _I),
    _f("source_type", _S), _f("source_file", _S), _f("data_quality", _S),
]
OPTIONAL_FIELDS = [
    _f("native_match_id", _S), _f("competition", _S), _f("round", _S), _f("group_key", _S),
    _f("group_players", T.ArrayType(_S)), _f("source_block_order", _I), _f("source_row_order", _I),
    _f("collected_at", _S),
]
HISTORY_SCHEMA = T.StructType(HISTORY_FIELDS + OPTIONAL_FIELDS)

# Raw JSON fixtures as they are landed; scores stay text so that booleans and malformed numbers can be told apart.
FIXTURE_SCHEMA = T.StructType([
    _f("id", _S), _f("kickoff", _S),
    _f("participants", T.ArrayType(T.StructType([
        _f("side", _S),
        _f("participant", T.StructType([_f("player", T.StructType([_f("nickname", _S)]))])),
    ]))),
    _f("result", T.StructType([_f("stats", T.StructType([_f("home_score", _S), _f("away_score", _S)]))])),
])

# Column orders of the result tables that consumers read by position.
PLAYER_TOTALS = [
    "league", "player", "played", "wins", "draws", "losses", "win_pct", "draw_pct", "loss_pct",
    "current_streak_result", "current_streak", "best_win_streak", "best_loss_streak",
    "first_match_date", "last_match_date",
]
WINDOW_STATS = [
    "league", "player", "window", "available", "wins", "draws", "losses", "win_pct", "draw_pct",
    "loss_pct", "sequence", "current_streak_result", "current_streak", "first_match_date", "last_match_date",
]
RECENT_VS_HISTORY = [
    "league", "player", "window", "recent_available", "historical_played",
    "recent_win_pct", "historical_win_pct", "win_pct_delta",
    "recent_draw_pct", "historical_draw_pct", "draw_pct_delta",
    "recent_loss_pct", "historical_loss_pct", "loss_pct_delta",
]
RECENT_FORM = PLAYER_TOTALS + [
    "window_size", "available_matches", "window_complete", "historical_played",
    "historical_win_pct", "win_pct_delta", "trend",
]
H2H_TOTALS = [
    "league", "player", "rival", "played", "wins", "draws", "losses", "win_pct", "draw_pct", "loss_pct",
    "first_match_date", "last_match_date",
]
H2H_RECENT = [
    "league", "player", "rival", "window", "available", "window_complete", "wins", "draws", "losses",
    "win_pct", "draw_pct", "loss_pct", "sequence", "current_streak_result", "current_streak",
    "first_match_date", "last_match_date",
]
H2H_COMPARISON = [
    "league", "player", "rival", "window", "recent_available", "historical_played",
    "historical_win_pct", "recent_win_pct", "win_pct_delta",
    "historical_draw_pct", "recent_draw_pct", "draw_pct_delta",
    "historical_loss_pct", "recent_loss_pct", "loss_pct_delta", "trend", "sample_status",
]
SESSION = [
    "session_id", "league", "player", "player_key", "session_number", "start_timestamp", "end_timestamp",
    "start_local", "end_local", "duration_minutes", "played", "wins", "draws", "losses", "win_pct",
    "draw_pct", "loss_pct", "last_24", "current_streak_result", "current_streak",
    "tracked", "balance", "active",
]
SNAPSHOT = [
    "league", "player", "player_key", "wins", "draws", "losses", "played", "win_pct", "draw_pct", "loss_pct",
    "last_24", "current_streak_result", "current_streak", "balance", "indicator", "tracked",
    "group_index",
]
PREDICTION = [
    "league", "group_index", "player_a", "player_b", "predicted_player", "opponent", "estimated_win_pct",
    "confidence", "h2h_matches", "h2h_win_pct", "recent_h2h_matches", "recent_h2h_win_pct",
    "recent_player_matches", "recent_player_win_pct", "recent_opponent_matches", "recent_opponent_loss_pct",
    "overall_player_matches", "overall_player_win_pct", "overall_opponent_matches", "overall_opponent_loss_pct",
]
COINCIDENT_MATCH = [
    "player_a_league", "player_a", "player_a_match_id", "player_a_timestamp", "player_a_result", "player_a_rival",
    "player_b_league", "player_b", "player_b_match_id", "player_b_timestamp", "player_b_result", "player_b_rival",
    "gap_minutes", "pair_order", "confirmation",
]
