"""Sliding snapshots and gap sessions on a stream (STR3, STR4)."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.functions.params import positive_int
from duelbook.functions.results import RESULTS, count_of, indicator
from duelbook.operators import filters
from duelbook.operators.totals import KEYS, with_pcts
from duelbook.streaming.ingest import REPAIR_DELAY, with_event_time

COUNTS = ("wins", "draws", "losses")


def sliding_snapshot(stream: DataFrame, hours: int = 8, slide_minutes: int = 15, delay: str = REPAIR_DELAY) -> DataFrame:
    """Totals and indicator per player for every window of ``hours`` on a ``slide`` grid.

    Matches are counted once, in the pane of the grid they lie in; a pane goes on as one row per player when the watermark closes
    it, and only these rows are dealt to the windows that hold the pane. Windows are aligned to the slide; the exact
    ``[reference - hours, reference]`` snapshot is the batch operator, run per trigger with ``foreachBatch`` over the recent rows.
    """
    whole, slide = positive_int(hours, "hours") * 60, positive_int(slide_minutes, "slide_minutes")
    rows = with_event_time(filters.valid_results(stream), delay)
    panes = rows.groupBy(F.window("event_ts", f"{gcd(whole, slide)} minutes").alias("pane"), *KEYS).agg(
        F.count("*").alias("played"), *[count_of(v).alias(n) for n, v in zip(COUNTS, RESULTS)])
    g = panes.groupBy(F.window("pane", f"{whole} minutes", f"{slide} minutes").alias("window"), *KEYS).agg(*[F.sum(c).alias(c) for c in ("played", *COUNTS)])
    return with_pcts(g).withColumn("indicator", indicator(F.col("wins"), F.col("draws"), F.col("losses")))


def streaming_sessions(stream: DataFrame, gap_minutes: int = 90, delay: str = REPAIR_DELAY) -> DataFrame:
    """Sessions per player, emitted once the watermark has closed them.

    A session window also joins matches exactly one gap apart, as the batch operator does.
    """
    gap = f"{positive_int(gap_minutes, 'session_gap_minutes')} minutes"
    rows = with_event_time(filters.valid_results(stream), delay)
    return rows.groupBy(F.session_window("event_ts", gap).alias("s"), *KEYS).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("played"),
        *[count_of(v).alias(n) for n, v in zip(COUNTS, RESULTS)])
