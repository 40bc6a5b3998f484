"""Full-history player statistics (AGG1-AGG3, WIN3, WIN4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook import schemas
from duelbook.functions.names import clean_name
from duelbook.functions.params import non_blank
from duelbook.functions.results import pct2
from duelbook.operators import filters
from duelbook.operators.runs import streaks

KEYS = ["league", "player_key"]


def with_pcts(df: DataFrame, total: str = "played") -> DataFrame:
    t = F.col(total)
    return df.withColumns({
        "win_pct": pct2(F.col("wins"), t), "draw_pct": pct2(F.col("draws"), t), "loss_pct": pct2(F.col("losses"), t),
    })


def player_totals(df: DataFrame, league: str | None = None, player: str | None = None, *,
                  slice_by: str = "day", tie_prefix: int = 0, keep_key: bool = False) -> DataFrame:
    """One row per (league, player): totals, percentages, current and best streaks, date range.

    Identities known only from rows without a valid result are kept with zero totals.
    """
    if player is not None:
        df = filters.by_player(df, player)
    if league is not None:
        df = filters.by_league(df, league)
    rows = filters.identified(df, "league", "player_key", "player")
    stats = streaks(rows, KEYS, slice_by=slice_by, tie_prefix=tie_prefix, carry=["player"])
    stats = stats.withColumns({
        "player": F.trim("last.player"), "played": F.col("wins") + F.col("draws") + F.col("losses"),
        "first_match_date": F.col("first_ts").cast("date").cast("string"),
        "last_match_date": F.col("last_ts").cast("date").cast("string"),
    })
    out = with_pcts(stats)
    return out.select("player_key", *schemas.PLAYER_TOTALS) if keep_key else out.select(*schemas.PLAYER_TOTALS)


def _zero_rows(ids: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("string")
    return ids.withColumns({
        **{c: zero for c in ("played", "wins", "draws", "losses", "current_streak", "best_win_streak", "best_loss_streak")},
        **{c: F.lit(0.0) for c in ("win_pct", "draw_pct", "loss_pct")},
        **{c: none for c in ("current_streak_result", "first_match_date", "last_match_date")},
    })


def requested(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of identities asked for by the caller."""
    return spark.createDataFrame(rows, schema)


def totals_for(df: DataFrame, wanted: DataFrame, **kwargs) -> DataFrame:
    """Totals of the wanted identities (league, player, player_key); a zero row for each unknown one (AGG3)."""
    stats = player_totals(filters.only_identities(filters.identified(df), wanted), keep_key=True, **kwargs)
    known = stats.withColumnRenamed("player", "known_as")
    joined = wanted.select("league", "player_key", F.trim("player").alias("asked_as")).join(known, KEYS, "left")
    numbers = {c: 0 for c in ("played", "wins", "draws", "losses", "current_streak", "best_win_streak", "best_loss_streak")}
    numbers.update({c: 0.0 for c in ("win_pct", "draw_pct", "loss_pct")})
    return joined.fillna(numbers).withColumn("player", F.coalesce("known_as", "asked_as")).select(*schemas.PLAYER_TOTALS)


def empty_totals(spark: SparkSession, player: str, league: str | None = None) -> DataFrame:
    """The zero row of a player without matches."""
    name = non_blank(player, "player")
    up = league.strip().upper() if isinstance(league, str) and league.strip() else None
    base = spark.createDataFrame([(up, name)], "league string, player string").withColumn("player", clean_name("player"))
    return _zero_rows(base).select(*schemas.PLAYER_TOTALS)
