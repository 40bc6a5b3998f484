"""Betting-opportunity rows from full no-draw run histories (AGG20, AGG21, AGG28, SC16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.functions.params import non_negative_int
from duelbook.functions.results import pct2
from duelbook.operators import filters, segments
from duelbook.operators.runs import runs
from duelbook.operators.streak_tables import round2_ratio
from duelbook.operators.totals import KEYS

LOOKAHEAD = 8
# Thresholds of the two recommendation levels.
BET = {"draw_pct": 17, "prob_next_8": 85, "samples": 30}
WATCH = {"draw_pct": 15, "prob_next_8": 80, "samples": 20}


def no_draw_histogram(df: DataFrame, **kwargs) -> DataFrame:
    """(league, player_key, drawless, length, is_last, n): how often each run length occurs.

    ``is_last`` marks the run still open at the end of the history.
    """
    r = runs(filters.valid_results(df), KEYS, F.col("result") != "E", **kwargs)
    return r.groupBy(*KEYS, F.col("value").alias("drawless"), "length", "is_last").agg(F.count("*").alias("n"))


def entry_backtest(entry: Column, lookahead: int = LOOKAHEAD) -> tuple[Column, Column]:
    """(samples, hits) over a run histogram: a draw within ``lookahead`` matches of reaching ``entry``.

    A run reaches the entry once if it is at least that long; the draw follows in time
    exactly when the run is closed and no longer than entry + lookahead - 1.
    """
    reached = F.col("drawless") & (entry > 0) & (F.col("length") >= entry)
    hit = reached & ~F.col("is_last") & (F.col("length") <= entry + (lookahead - 1))
    return (F.sum(F.when(reached, F.col("n")).otherwise(0)), F.sum(F.when(hit, F.col("n")).otherwise(0)))


def entry_results(df: DataFrame, entry: int, **kwargs) -> DataFrame:
    """Backtest of one fixed entry length per player."""
    non_negative_int(entry, "entry")
    samples, hits = entry_backtest(F.lit(entry))
    return no_draw_histogram(filters.identified(df), **kwargs).groupBy(*KEYS).agg(
        samples.alias("samples"), hits.alias("hits")).withColumn("hit_pct", pct2(F.col("hits"), F.col("samples")))


def opportunities(df: DataFrame, bettable: DataFrame | None = None, excluded: DataFrame | None = None, **kwargs) -> DataFrame:
    """One row per player: draw rate, open no-draw run, mean run, backtest at the open run, advice.

    ``bettable`` restricts to the tracked players; an empty or missing list means all.
    """
    rows = filters.operational_results(df, excluded)
    if bettable is not None:
        rows = filters.only_identities(rows, bettable)
    r = runs(rows, KEYS, F.col("result") != "E", carry=["player"], **kwargs)
    # Histogram first: run lengths per player are few, however many runs there are.
    hist = r.groupBy(*KEYS, F.col("value").alias("drawless"), "length", "is_last").agg(
        F.count("*").alias("n"), F.max("last").alias("last"))
    w = Window.partitionBy(*KEYS)
    current = F.max(F.when(F.col("drawless") & F.col("is_last"), F.col("length")).otherwise(0)).over(w)
    hist = hist.withColumn("current", current)
    samples, hits = entry_backtest(F.col("current"))
    weighted = F.col("length") * F.col("n")
    g = hist.groupBy(*KEYS).agg(
        F.max("last").alias("last"), F.sum(weighted).alias("matches"),
        F.sum(F.when(~F.col("drawless"), weighted).otherwise(0)).alias("draws"),
        F.max("current").alias("current_streak_real"),
        F.sum(F.when(F.col("drawless"), weighted).otherwise(0)).alias("_len"),
        F.sum(F.when(F.col("drawless"), F.col("n")).otherwise(0)).alias("_runs"),
        samples.alias("samples"), hits.alias("_hits"),
    ).withColumns({
        "player": F.col("last.player"), "draw_pct": pct2(F.col("draws"), F.col("matches")),
        "avg_streak": round2_ratio(F.col("_len"), F.col("_runs")), "prob_next_8": pct2(F.col("_hits"), F.col("samples")),
    })
    return g.withColumns({"reason": reason(), "recommendation": recommendation()}).select(
        "league", "player", "matches", "draws", "draw_pct", "current_streak_real", "avg_streak", "samples",
        "prob_next_8", "reason", "recommendation")


def _meets(level: dict) -> Column:
    cond = F.lit(True)
    for name, least in level.items():
        cond = cond & (F.col(name) >= least)
    return cond


def recommendation() -> Column:
    long_enough = F.col("current_streak_real") >= F.col("avg_streak")
    return F.when(_meets(BET) & long_enough, F.lit("BET")).when(_meets(WATCH), F.lit("WATCH")).otherwise(F.lit("SKIP"))


def reason() -> Column:
    return F.concat_ws(
        "|", F.when(F.col("draw_pct") >= BET["draw_pct"], F.lit("DRAW_OK")),
        F.when(F.col("prob_next_8") >= BET["prob_next_8"], F.lit("PROB_OK")),
        F.when(F.col("samples") >= BET["samples"], F.lit("SAMPLES_OK")),
        F.when(F.col("current_streak_real") >= F.col("avg_streak"), F.lit("STREAK_OK")),
    )


def player_texts(df: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(league, player_key, sequence): all operational results of a player as text, put together from the months (AGG20)."""
    return segments.joined_text(player_sequences(df, excluded), KEYS)


def player_sequences(df: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(league, player_key, slice, n, seq): operational results as text, a row per player and month (AGG20)."""
    return segments.sequences(filters.operational_results(df, excluded), KEYS, "month")


def player_text_parts(df: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(league, player_key, grain, slice, n, sequence, sequence_part, sequence_parts): all operational results of a player as text (AGG20).

    A row of grain ``all`` with the whole text, always one part of one, and a row of grain ``month`` for each of its months, numbered in order.
    """
    months = player_sequences(df, excluded)
    w = Window.partitionBy(*KEYS)
    whole = segments.joined_text(months, KEYS, F.sum("n").alias("n")).select(
        *KEYS, F.lit("all").alias("grain"), F.lit(None).cast("date").alias("slice"), "n", "sequence",
        F.lit(1).alias("sequence_part"), F.lit(1).alias("sequence_parts"))
    parts = months.select(*KEYS, F.lit("month").alias("grain"), "slice", "n", F.col("seq").alias("sequence"),
                          F.row_number().over(w.orderBy("slice")).alias("sequence_part"), F.count(F.lit(1)).over(w).cast("int").alias("sequence_parts"))
    return whole.unionByName(parts)
