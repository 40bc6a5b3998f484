"""Gaps and islands over very long result series (WIN3-WIN6, S1).

Every ordered computation here has two levels.  Rows are windowed inside
(identity, slice), where a slice is a stretch of time; what crosses slice borders
is stitched from one or two summary rows per slice.  An identity that holds a
third of all rows therefore spreads over as many tasks as it has slices, and the
second level sees at most a few rows per calendar day and identity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.functions.results import DRAW, LOSS, WIN, is_valid
from duelbook.functions.times import time_slice

# Chronological order of one identity's perspectives (S1).
ORDER = ("ts", "match_id", "perspective_id")


def latest_first() -> list[Column]:
    return [F.col(c).desc() for c in ORDER]


def _local_runs(df: DataFrame, keys: Sequence[str], value: Column, slice_by: str, tie_prefix: int,
                carry: Sequence[str]) -> DataFrame:
    """Runs of equal ``value`` inside each (identity, slice): one sort, no aggregation.

    Each run is represented by its last row; lengths are differences of row numbers.
    Rows with a NULL value are set apart as ``run`` 0.
    """
    rows = df.select(*keys, *ORDER, *[c for c in carry if c not in (*keys, *ORDER)],
                     value.alias("value"), time_slice(slice_by, tie_prefix).alias("slice"))
    rows = rows.withColumn("_ok", F.col("value").isNotNull())
    w = Window.partitionBy(*keys, "slice", "_ok").orderBy(*ORDER)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*", F.row_number().over(w).alias("_rn"), F.lead("value").over(w).alias("_next"),
        F.lead("ts").over(w).alias("_next_ts"), F.first("ts").over(w).alias("_slice_ts"),
    )
    ends = rows.filter("_next IS NULL OR _next <> value").select(
        "*", (F.col("_rn") - F.coalesce(F.lag("_rn").over(w), F.lit(0))).cast("long").alias("length"),
        F.row_number().over(w).alias("_run"),
        F.coalesce(F.lag("_next_ts").over(w), F.col("_slice_ts")).alias("first_ts"),
        F.count("*").over(whole).alias("slice_runs"),
    )
    return ends.select(
        *keys, "slice", "_ok", F.when(F.col("_ok"), F.col("_run")).otherwise(0).alias("run"), "slice_runs", "value", "length",
        "first_ts", F.col("ts").alias("last_ts"), F.struct(*ORDER, *carry).alias("last"),
    )


def runs(df: DataFrame, keys: Sequence[str], value: Column, *, slice_by: str = "day",
         tie_prefix: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """All maximal runs: keys, value, length, first_ts, last_ts, last, is_last.

    Runs strictly inside a slice are final; the first and last of each slice (two rows
    per slice at most) are joined to their neighbours when the value continues.
    """
    local = _local_runs(df, keys, value, slice_by, tie_prefix, carry).filter("run > 0")
    out = [*keys, "value", "length", "first_ts", "last_ts", "last", "is_last"]
    inner = local.filter("run > 1 AND run < slice_runs").withColumn("is_last", F.lit(False)).select(*out)
    w = Window.partitionBy(*keys).orderBy("slice", "run")
    joins = (F.col("run") == 1) & F.col("value").eqNullSafe(F.lag("value").over(w))
    edge = local.filter("run = 1 OR run = slice_runs").withColumn(
        "_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    edge = edge.select(
        "*", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"),
        F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("islands"),
    )
    stitched = edge.groupBy(*keys, "island").agg(
        F.min("value").alias("value"), F.sum("length").alias("length"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.max("last").alias("last"), (F.max("islands") == F.col("island")).alias("is_last"),
    ).select(*out)
    return inner.unionByName(stitched)


def streaks(df: DataFrame, keys: Sequence[str], *, slice_by: str = "day", tie_prefix: int = 0,
            carry: Sequence[str] = ()) -> DataFrame:
    """Totals, current streak and best streaks per identity, in one pass over the rows.

    One summary row per (identity, slice) reaches the second level, which folds the
    slices in order.  ``last`` is the identity's latest valid row; identities without any
    valid result keep their latest row and zero totals.
    """
    result = F.when(is_valid(F.col("result")), F.col("result"))
    local = _local_runs(df, keys, result, slice_by, tie_prefix, carry)
    edge, valid = F.struct("value", "length"), F.col("run") > 0

    def longest(value: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("value") == value, F.col("length"))), F.lit(0).cast("long"))

    def total(value: str) -> Column:
        return F.sum(F.when(F.col("value") == value, F.col("length")).otherwise(0))

    per_slice = local.groupBy(*keys, "slice", "_ok").agg(
        F.min_by(edge, F.when(valid, F.col("run"))).alias("head"), F.max_by(edge, F.when(valid, F.col("run"))).alias("tail"),
        F.max("run").alias("n_runs"), longest(WIN).alias("best_v"), longest(LOSS).alias("best_d"),
        total(WIN).alias("wins"), total(DRAW).alias("draws"), total(LOSS).alias("losses"),
        F.min(F.when(valid, F.col("first_ts"))).alias("first_ts"), F.max(F.when(valid, F.col("last_ts"))).alias("last_ts"),
        F.max(F.struct(valid.alias("valid"), "last")).alias("last"),
    )
    per_key = per_slice.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(
            F.col("n_runs") > 0, F.struct("slice", "n_runs", "head", "tail", "best_v", "best_d")))).alias("s"),
        F.sum("wins").alias("wins"), F.sum("draws").alias("draws"), F.sum("losses").alias("losses"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("last").alias("last"),
    )

    def step(acc: Column, s: Column) -> Column:
        head = s["head"]
        joined = head["length"] + F.when(acc["value"] == head["value"], acc["length"]).otherwise(F.lit(0).cast("long"))
        single = s["n_runs"] == 1

        def best(name: str, value: str) -> Column:
            return F.greatest(acc[name], s[name], F.when(head["value"] == value, joined).otherwise(F.lit(0).cast("long")))

        return F.struct(
            s["tail"]["value"].alias("value"),
            F.when(single, joined).otherwise(s["tail"]["length"]).alias("length"),
            best("best_v", WIN).alias("best_v"), best("best_d", LOSS).alias("best_d"),
        )

    zero = F.struct(F.lit("").alias("value"), F.lit(0).cast("long").alias("length"),
                    F.lit(0).cast("long").alias("best_v"), F.lit(0).cast("long").alias("best_d"))
    folded = per_key.withColumn("f", F.aggregate("s", zero, step))
    return folded.select(
        *keys, "wins", "draws", "losses", "first_ts", "last_ts", F.col("last.last").alias("last"),
        F.when(F.size("s") > 0, F.col("f.value")).alias("current_streak_result"), F.col("f.length").alias("current_streak"),
        F.col("f.best_v").alias("best_win_streak"), F.col("f.best_d").alias("best_loss_streak"),
    )


def last_n(df: DataFrame, keys: Sequence[str], n: int, lead: str | None = None) -> DataFrame:
    """The latest n rows per key with their recency rank ``rn`` (1 = latest); rows of a higher ``lead`` come first.

    Spark turns the rank filter into a limit per map task and key before the shuffle, up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` rows. Longer windows go by days: counts per (key, day) say which days hold the
    n rows and how many rows lie after each, only rows of these days travel, and each is ranked within its day.
    """
    first = [F.col(lead).desc()] if lead else []
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        w = Window.partitionBy(*keys).orderBy(*first, *latest_first())
        return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    day = [*keys, *([lead] if lead else []), "_day"]
    rows = df.withColumn("_day", F.coalesce(F.col("ts").cast("date"), F.lit("0001-01-01").cast("date")))
    later = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in day[len(keys):]]).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*day).agg(F.count("*").alias("_n")).withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).filter(F.col("_later") < n)
    local = F.row_number().over(Window.partitionBy(*day).orderBy(*first, *latest_first()))
    return rows.join(days.drop("_n"), day).withColumn("rn", (F.col("_later") + local).cast("int")).filter(F.col("rn") <= n).drop("_day", "_later")
