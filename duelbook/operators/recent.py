"""Last-N windows per player and their comparison with the full history (WIN2, WIN2a-WIN2e, JN4)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook import schemas
from duelbook.functions.params import non_negative_number, positive_int, window_sizes
from duelbook.functions.results import LOSS, RESULTS, WIN, best_run, count_in, count_of, delta2, is_valid, same_run, tail, trend
from duelbook.operators import filters
from duelbook.operators.runs import last_n
from duelbook.operators.totals import KEYS, with_pcts

DEFAULT_WINDOWS = (5, 10, 20)
TREND_THRESHOLD = 5.0


def latest_valid(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Per key the n latest rows, rows without a valid result last (so identities never vanish)."""
    valid = F.coalesce(is_valid(F.col("result")), F.lit(False))
    return last_n(df.withColumn("valid", valid), keys, n, lead="valid")


def window_rows(df: DataFrame, keys: Sequence[str], windows: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Statistics of each requested window (``ord`` = its place in the request), per key.

    The rank filter bounds every group to max(windows) rows before anything is collected.
    """
    top = latest_valid(df, keys, max(windows))
    request = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("window")) for i, n in enumerate(windows)])
    rows = top.select(*keys, "rn", "valid", "ts", "result", *names,
                      F.explode(F.filter(request, lambda r: F.col("rn") <= r["window"])).alias("w"))
    valid = F.col("valid")
    ordered = F.array_sort(F.collect_list(F.when(valid, F.struct((-F.col("rn")).alias("k"), "result"))))
    return rows.groupBy(*keys, F.col("w.ord").alias("ord"), F.col("w.window").alias("window")).agg(
        F.array_join(F.transform(ordered, lambda r: r["result"]), "").alias("sequence"),
        F.min(F.when(valid, F.col("ts"))).cast("date").cast("string").alias("first_match_date"),
        F.max(F.when(valid, F.col("ts"))).cast("date").cast("string").alias("last_match_date"),
        *[F.min_by(F.trim(n), "rn").alias(n) for n in names],
    ).withColumns({
        "available": F.length("sequence"),
        **{n: count_in(F.col("sequence"), v) for n, v in zip(("wins", "draws", "losses"), RESULTS)},
    }).transform(with_pcts, "available").withColumns({
        "current_streak_result": F.when(F.col("available") > 0, tail(F.col("sequence"), 1)),
        "current_streak": same_run(F.col("sequence")),
    })


def _scope(df: DataFrame, league: str | None, player: str | None) -> DataFrame:
    if player is not None:
        df = filters.by_player(df, player)
    if league is not None:
        df = filters.by_league(df, league)
    return filters.identified(df, "league", "player_key", "player")


def player_windows(df: DataFrame, windows: Iterable[int] = DEFAULT_WINDOWS, league: str | None = None,
                   player: str | None = None) -> DataFrame:
    """Several last-N windows at once, for every player or one."""
    sizes = window_sizes(windows)
    return window_rows(_scope(df, league, player), KEYS, sizes, ["player"]).select(*schemas.WINDOW_STATS)


def history_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full-history totals per key: numeric, map-side combined."""
    return df.groupBy(*keys).agg(
        *[count_of(v).alias(n) for n, v in zip(("wins", "draws", "losses"), RESULTS)],
        F.count_if(is_valid(F.col("result"))).alias("played"),
    ).transform(with_pcts)


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in columns])


PCTS = ("win_pct", "draw_pct", "loss_pct")


def deltas() -> dict[str, Column]:
    return {f"{p}_delta": delta2(F.col(f"recent_{p}"), F.col(f"historical_{p}")) for p in PCTS}


def recent_and_history(df: DataFrame, keys: Sequence[str], windows: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Recent window joined to full-history totals: both sides hold one small row per key (and window)."""
    recent = window_rows(df, keys, windows, names).withColumnRenamed("available", "recent_available")
    recent = recent.withColumns({f"recent_{p}": F.col(p) for p in PCTS})
    past = prefixed(history_counts(df, keys), keys, "historical_", ("played", *PCTS))
    return recent.join(past, list(keys)).withColumns(deltas())


def recent_vs_history(df: DataFrame, window: int, league: str | None = None, player: str | None = None) -> DataFrame:
    rows = recent_and_history(_scope(df, league, player), KEYS, [positive_int(window, "window")], ["player"])
    return rows.select(*schemas.RECENT_VS_HISTORY)


def recent_forms(df: DataFrame, windows: Iterable[int] = (5, 10), league: str | None = None, player: str | None = None,
                 rival: str | None = None, *, trend_threshold: float = TREND_THRESHOLD) -> DataFrame:
    """Enriched recent form per player and requested window (request order and repeats kept in ``ord``).

    With ``rival`` only the matches of the player against that rival count.
    """
    sizes = [positive_int(w, "window") for w in windows]
    threshold = non_negative_number(trend_threshold, "trend_threshold")
    if rival is not None:
        df = filters.by_rivalry(df, player, rival)
    rows = recent_and_history(_scope(df, league, player), KEYS, sizes, ["player"])
    seq = F.col("sequence")
    return rows.withColumns({
        "played": F.col("recent_available"), "best_win_streak": best_run(seq, WIN), "best_loss_streak": best_run(seq, LOSS),
        "window_size": F.col("window"), "available_matches": F.col("recent_available"),
        "window_complete": F.col("recent_available") == F.col("window"),
        "trend": trend(F.col("win_pct_delta"), F.col("recent_available"), threshold),
    }).select("ord", *schemas.RECENT_FORM)
