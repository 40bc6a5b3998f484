"""Summaries of result series that are made per slice of time and merged, without the series as text.

A summary of a stretch of results holds its counts, the places of the first and the last win, draw and loss, its longest
stretch without a draw, and its last results. Places count from the stretch's beginning, so summaries of neighbouring slices
are merged by adding what lies before them, and every trailing run is a difference of places. However many results a
session, a day or a window has, tasks see them slice by slice, and what is merged is a row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.functions.results import DRAW, LOSS, RESULTS, WIN, count_in, count_of
from duelbook.functions.times import time_slice
from duelbook.operators.runs import ORDER

COUNTS = ("wins", "draws", "losses")
#: Results at the end that a summary holds.
END = 24


def summarised(rows: DataFrame, keys: Sequence[str], inside: Sequence[str] = (), carry: Sequence[str] = (), text: bool = False) -> DataFrame:
    """A summary per (keys, slice, inside) of rows with ``slice``; ``inside`` numbers the stretches of a slice in time order.

    ``played`` results, counts, ``start``, ``end``, ``first_`` and ``last_`` place of each result (null where it doesn't occur),
    ``last_24`` as text, without ``inside`` also ``calm``, the longest stretch without a draw, and with ``carry`` ``latest``: these columns of the
    latest row, and with ``text`` ``seq``, the slice's results, a byte each.
    """
    w = Window.partitionBy(*keys, "slice").orderBy(*ORDER)
    rows = rows.select(*keys, "slice", *inside, *ORDER, "result", *[c for c in carry if c not in (*keys, *ORDER)],
                       F.row_number().over(w).alias("_at"))
    ahead = F.lead(F.struct(F.lit(True).alias("_"), *inside), END).over(w)
    late = ahead.isNull()
    for c in inside:
        late = late | (ahead[c] != F.col(c))
    rows = rows.withColumn("_late", late)
    extra = []
    if not inside:
        drawn = F.max(F.when(F.col("result") == DRAW, F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_calm", F.col("_at") - F.coalesce(drawn, F.lit(0)))
        extra.append(F.max("_calm").cast("long").alias("calm"))
    if carry:
        extra.append(F.max(F.struct(*ORDER, *carry)).alias("latest"))
    if text:
        whole = F.array_sort(F.collect_list(F.struct("_at", "result")))
        extra.append(F.array_join(F.transform(whole, lambda r: r["result"]), "").alias("seq"))
    before = F.min("_at") - 1
    places = [(f(F.when(F.col("result") == v, F.col("_at"))) - before).cast("long").alias(f"{name}_{v}")
              for v in RESULTS for name, f in (("first", F.min), ("last", F.max))]
    ending = F.array_sort(F.collect_list(F.when(F.col("_late"), F.struct("_at", "result"))))
    return rows.groupBy(*keys, "slice", *inside).agg(
        F.count("*").alias("played"), *[count_of(v).alias(c) for c, v in zip(COUNTS, RESULTS)], F.min("ts").alias("start"), F.max("ts").alias("end"), *places,
        F.array_join(F.transform(ending, lambda r: r["result"]), "").alias("last_24"), *extra)


def of_text(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows with the summary of the results that a text column holds; a null text holds none. Their own counts stay."""
    text = F.coalesce(F.col(seq), F.lit(""))
    places = {}
    for v in RESULTS:
        others = F.lit("".join(r for r in RESULTS if r != v))
        places[f"first_{v}"] = F.nullif(F.instr(text, v), F.lit(0)).cast("long")
        places[f"last_{v}"] = F.nullif(F.length(F.rtrim(text, others)), F.lit(0)).cast("long")
    stretches = F.transform(F.regexp_extract_all(text, F.lit(f"[^{DRAW}]+"), F.lit(0)), F.length)
    return df.withColumns({
        "played": F.length(text).cast("long"), **{c: count_in(text, v).cast("long") for c, v in zip(COUNTS, RESULTS) if c not in df.columns}, **places,
        "last_24": F.right(text, F.lit(END)), "calm": F.coalesce(F.array_max(stretches), F.lit(0)).cast("long")})


def merged(parts: DataFrame, keys: Sequence[str], order: Sequence[str] = ("slice",)) -> DataFrame:
    """One summary per key out of those of its parts in ``order``.

    The window over a key sees a row per part, which the calendar bounds. Where the parts have ``seq``, it is put together as well.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead, behind = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("played").over(behind), F.lit(0)), "_after": F.coalesce(F.sum("played").over(ahead), F.lit(0))})
    extra = [f(c).alias(c) for c, f in (("start", F.min), ("end", F.max), ("latest", F.max)) if c in parts.columns]
    if "seq" in parts.columns:
        texts = F.array_sort(F.collect_list(F.struct("_before", "played", "seq")))
        extra.append(F.array_join(F.transform(texts, lambda t: t["seq"]), "").alias("seq"))
    if "calm" in parts.columns:  # what reaches over a border: from the latest draw before it to the first one behind it
        drawn = F.max(F.col("_before") + F.col(f"last_{DRAW}")).over(behind)
        until = F.col("_before") + F.coalesce(F.col(f"first_{DRAW}") - 1, F.col("played"))
        parts = parts.withColumn("_across", until - F.coalesce(drawn, F.lit(0)))
        extra.append(F.greatest(F.max("calm"), F.max("_across")).alias("calm"))
    ending = F.array_sort(F.collect_list(F.when(F.col("_after") < END, F.struct("_before", "played", "last_24"))))
    return parts.groupBy(*keys).agg(
        F.sum("played").alias("played"), *[F.sum(c).alias(c) for c in COUNTS],
        *[f(F.col("_before") + F.col(f"{name}_{v}")).alias(f"{name}_{v}") for v in RESULTS for name, f in (("first", F.min), ("last", F.max))],
        F.right(F.array_join(F.transform(ending, lambda t: t["last_24"]), ""), F.lit(END)).alias("last_24"), *extra)


def summary(df: DataFrame, keys: Sequence[str], slice_by: str = "hour", tie_prefix: int = 0, carry: Sequence[str] = (), text: bool = False) -> DataFrame:
    """The merged summary of each key's rows: ``played``, counts, ``start``, ``end``, places, ``last_24``, ``calm`` (and ``latest``, ``seq``)."""
    rows = df.withColumn("slice", time_slice(slice_by, tie_prefix))
    return merged(summarised(rows, keys, carry=carry, text=text), keys)


def trailing(*broken_by: str) -> Column:
    """Length of the run at the end that none of these results breaks."""
    return (F.col("played") - F.greatest(*[F.coalesce(f"last_{v}", F.lit(0)) for v in broken_by], F.lit(0))).cast("int")


def win_run() -> Column:
    return trailing(DRAW, LOSS)


def unbeaten_run() -> Column:
    return trailing(LOSS)


def winless_run() -> Column:
    return trailing(WIN)


def drawless_run() -> Column:
    return trailing(DRAW)


def last_result() -> Column:
    return F.right("last_24", F.lit(1))


def same_run() -> Column:
    """Length of the run of equal results at the end."""
    return (F.when(F.col(f"last_{WIN}") == F.col("played"), trailing(DRAW, LOSS)).when(F.col(f"last_{DRAW}") == F.col("played"), trailing(WIN, LOSS))
            .otherwise(trailing(WIN, DRAW)))


def sequences(df: DataFrame, keys: Sequence[str], slice_by: str) -> DataFrame:
    """(keys, slice, n, seq): the results as text, a row per key and slice of the calendar, whatever its size.

    The text of a key is that of its slices, in order. A slice's text is made in one task, a byte per result.
    """
    rows = df.select(*keys, *ORDER, "result", time_slice(slice_by).alias("slice"))
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, "result")))
    return rows.groupBy(*keys, "slice").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda r: r["result"]), "").alias("seq"))


def joined_text(parts: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """(keys, sequence): the slices' text put together, for stretches that one value may hold; ``extra``: further aggregates of the slices."""
    ordered = F.array_sort(F.collect_list(F.struct("slice", "seq")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["seq"]), "").alias("sequence"), *extra)
