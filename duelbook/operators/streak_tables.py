"""No-draw streak tables over daily sequences (AGG15-AGG19, JN12, SRT8, WIN5, FLT13).

Input rows are one player's day: either the summaries of ``daily_players`` or, from reports, league, date, player, wins, draws, losses,
played, seq. Tables of single runs take them from ``daily_no_draw_runs`` (``runs``), or from the reports' text. Every table keeps the
league apart; rows without the column (one league's reports) give tables without it. Everything is per row or a plain
aggregation that combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.functions.params import positive_int
from duelbook.functions.results import drawless_run, pct2
from duelbook.operators import segments
from duelbook.operators.daily import PLAYER_DAY

MIN_PLAYED = 18
MIN_STREAK = 9
PIVOT_LENGTHS = (9, 30)
MAX_BETS = 8
MIN_ENTRY = 8
# Daily-maximum thresholds and their weight in the stability score.
RISK_WEIGHTS = ((18, 1), (20, 2), (22, 3), (25, 4))


def round2_ratio(n: Column, d: Column) -> Column:
    """n/d to two decimals, half-even in integer arithmetic."""
    return pct2(n, d * 100)


def _league(daily: DataFrame) -> list[str]:
    return [c for c in ("league",) if c in daily.columns]


def enough_played(daily: DataFrame, min_played: int = MIN_PLAYED) -> DataFrame:
    return daily.filter(F.col("played") >= positive_int(min_played, "min_played"))


def _summarised(daily: DataFrame) -> DataFrame:
    """Days with their longest and trailing no-draw runs; a report's number of matches stays what it says."""
    if "calm" in daily.columns:
        return daily
    read = segments.of_text(daily.withColumn("_played", F.col("played"))).withColumn("current_streak", segments.drawless_run())
    return read.withColumn("played", F.col("_played")).drop("_played")


def _no_draw_lengths(seq: Column) -> Column:
    return F.transform(F.regexp_extract_all(seq, F.lit("[^E]+"), F.lit(0)), F.length)


def daily_streaks(daily: DataFrame, min_played: int = MIN_PLAYED) -> DataFrame:
    """Longest and trailing no-draw run of each player-day."""
    return enough_played(_summarised(daily), min_played).select(
        *_league(daily), "date", "player", "played", "draws", F.col("calm").cast("int").alias("max_no_draw_streak"),
        F.col("current_streak").alias("ending_no_draw_streak"))


def no_draw_runs(daily: DataFrame, min_played: int = MIN_PLAYED, min_streak: int = MIN_STREAK, runs: DataFrame | None = None) -> DataFrame:
    """(date, player, streak, ended): every no-draw run; ``ended`` when a draw followed that day."""
    days = enough_played(daily, min_played)
    if runs is not None:
        key = [c for c in PLAYER_DAY if c in daily.columns and c in runs.columns]
        return runs.filter(F.col("streak") >= min_streak).join(days.select(*key), key, "left_semi").select(*_league(daily), "date", "player", "streak", "ended")
    rows = days.select(
        *_league(daily), "date", "player", drawless_run(F.col("seq")).alias("open"),
        F.posexplode(_no_draw_lengths(F.col("seq"))).alias("i", "streak"),
        F.size(_no_draw_lengths(F.col("seq"))).alias("n"),
    )
    ended = ~((F.col("i") == F.col("n") - 1) & (F.col("open") > 0))
    return rows.filter(F.col("streak") >= min_streak).select(*_league(daily), "date", "player", "streak", ended.alias("ended"))


def player_summary(daily: DataFrame, min_played: int = MIN_PLAYED) -> DataFrame:
    g = enough_played(daily, min_played).groupBy(*_league(daily), "player").agg(
        F.count("*").alias("days"), F.sum("played").alias("matches"),
        F.sum("wins").alias("wins"), F.sum("draws").alias("draws"), F.sum("losses").alias("losses"),
    )
    return g.withColumns({
        **{f"{n}_pct": pct2(F.col(c), F.col("matches")) for n, c in (("win", "wins"), ("draw", "draws"), ("loss", "losses"))},
        **{f"avg_{c}_day": round2_ratio(F.col(c), F.col("days")) for c in ("matches", "wins", "draws", "losses")},
    })


def player_risk(daily: DataFrame, min_played: int = MIN_PLAYED, max_bets: int = MAX_BETS) -> DataFrame:
    """Streak risk per player: one aggregation over player-days gives both the summary and the risk."""
    rows = enough_played(_summarised(daily), min_played).withColumn("top", F.col("calm").cast("int"))
    g = rows.groupBy(*_league(daily), "player").agg(
        F.count("*").alias("days_analyzed"), F.sum("played").alias("matches_analyzed"), F.sum("draws").alias("_draws"),
        F.max("top").alias("max_streak"), F.sum("top").alias("_tops"),
        *[F.count_if(F.col("top") >= t).alias(f"streaks_{t}_plus") for t, _ in RISK_WEIGHTS],
    )
    score = F.lit(0)
    for t, weight in RISK_WEIGHTS:
        score = score + F.col(f"streaks_{t}_plus") * weight
    entry = F.greatest(F.lit(MIN_ENTRY), F.col("max_streak") - max_bets + 1)
    return g.withColumns({
        "draw_pct": pct2(F.col("_draws"), F.col("matches_analyzed")),
        "avg_max_streak": round2_ratio(F.col("_tops"), F.col("days_analyzed")),
        "recommended_entry": entry, "max_bets": F.lit(max_bets),
        "safe_for_strategy": F.when(F.col("max_streak") <= entry + max_bets - 1, F.lit("YES")).otherwise(F.lit("NO")),
        "danger_days_pct": pct2(F.col("streaks_18_plus"), F.col("days_analyzed")),
        "stability": F.when(score == 0, F.lit("VERY_HIGH")).when(score <= 2, F.lit("HIGH"))
                      .when(score <= 5, F.lit("MEDIUM")).otherwise(F.lit("LOW")),
    }).select(
        *_league(daily), "player", "days_analyzed", "matches_analyzed", "draw_pct", "max_streak", "avg_max_streak",
        "streaks_18_plus", "streaks_20_plus", "streaks_22_plus", "streaks_25_plus", "recommended_entry",
        "max_bets", "safe_for_strategy", "danger_days_pct", "stability",
    )


def streak_distribution(daily: DataFrame, **kwargs) -> DataFrame:
    return no_draw_runs(daily, **kwargs).groupBy(*_league(daily), "streak").agg(
        F.count("*").alias("total_occurrences"), F.count_if("ended").alias("ended_same_day"),
        F.count_if(~F.col("ended")).alias("finished_day_with_streak"),
    )


def streak_distribution_by_day(daily: DataFrame, **kwargs) -> DataFrame:
    return no_draw_runs(daily, **kwargs).groupBy(*_league(daily), "date", "streak").agg(F.count("*").alias("occurrences"))


def daily_streak_summary(daily: DataFrame, lengths: tuple[int, int] = PIVOT_LENGTHS, **kwargs) -> DataFrame:
    """One row per league and day, one column per length, and ``streak_longer`` for all runs beyond the last length."""
    over = lengths[1] + 1
    each = [F.count_if(F.col("streak") == v).alias(f"streak_{v}") for v in range(lengths[0], over)]
    return no_draw_runs(daily, **kwargs).groupBy(*_league(daily), "date").agg(*each, F.count_if(F.col("streak") >= over).alias("streak_longer"))


def streak_records(daily: DataFrame, min_played: int = MIN_PLAYED) -> DataFrame:
    return daily_streaks(daily, min_played).drop("ending_no_draw_streak").orderBy(
        F.desc("max_no_draw_streak"), "player", "date", *_league(daily))


def draw_records(daily: DataFrame, lowest: bool = True, min_played: int = MIN_PLAYED) -> DataFrame:
    first = F.asc("draws") if lowest else F.desc("draws")
    return enough_played(daily, min_played).select(*_league(daily), "date", "player", "played", "draws").orderBy(
        first, F.desc("played"), "player", "date", *_league(daily))
