"""Coincident matches of two players: backward pairing with consumption (JN5, JN8, JN9, WIN9, AGG26, SRT7).

Walking both players' matches as one timeline, each match takes the latest still unused
match of the other side if it lies within the gap, and otherwise waits to be taken.
What waits at a moment depends on the past, so no join expresses this; but a waiting match
is dead once the gap has passed.  The timeline is therefore cut where it pauses for longer
than the gap, and each stretch is walked on its own, as a stream that holds only what waits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from duelbook import schemas
from duelbook.functions.params import non_negative_int
from duelbook.functions.results import confirmation
from duelbook.functions.times import iso_z, micros
from duelbook.operators import filters
from duelbook.operators.runs import ORDER, last_n
from duelbook.operators.snapshot import MAX_CANDIDATES
from duelbook.operators.totals import KEYS

MAX_GAP_MINUTES = 30
WINDOW_HOURS = 8
DAY_MICROS = 86_400_000_000
# Reliability weights and levels.
WEIGHTS = {"history": 0.50, "recent": 0.30, "strength": 0.20}
RECENT = 5
HIGH = (8, 70.0)
MEDIUM = (5, 65.0)
TOP_PAIRS = 5

PAIR = ["league_a", "key_a", "league_b", "key_b"]


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """Unordered pairs of distinct candidates, oriented by league, name, key.

    Candidates are a top-k result or a hand-written list of any length; all pairs of the list are the feature. Each candidate
    meets the later ones of the list by an equi-join on their places.
    """
    one = candidates.groupBy(*KEYS).agg(F.min_by(F.struct("player", "indicator"), F.col("player")).alias("c"))
    member = one.select("league", "player_key", F.col("c.player").alias("player"), F.coalesce("c.indicator", F.lit("NONE")).alias("indicator"))
    order = Window.orderBy("league", F.lower("player"), "player_key", "player")  # the list is as long as its author made it
    ranked = member.withColumns({"place": F.row_number().over(order), "size": F.count("*").over(Window.partitionBy(F.lit(0)))})
    names = ("league", "player_key", "player", "indicator")
    a = ranked.filter("place < size").select(*[F.col(c).alias(f"{c}_a") for c in names], F.explode(F.sequence(F.col("place") + 1, F.col("size").cast("int"))).alias("place"))
    b = ranked.select("place", *[F.col(c).alias(f"{c}_b") for c in names])
    return a.join(b, "place").select(*[F.col(f"{c}_{s}").alias(f"{'key' if c == 'player_key' else c}_{s}") for s in "ab" for c in names])


def pair_events(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each pair's matches, tagged with the side they belong to."""
    sides = pairs.select(*PAIR, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("league_a").alias("league"), F.col("key_a").alias("player_key")),
        F.struct(F.lit(1).alias("side"), F.col("league_b").alias("league"), F.col("key_b").alias("player_key")))).alias("s"))
    sides = sides.select(*PAIR, "s.*")
    cols = [*KEYS, *ORDER, "result", "rival"]
    return df.select(*cols).join(sides, KEYS).select(
        *PAIR, "side", micros(F.col("ts")).alias("at"), "match_id", "perspective_id", "result", "rival")


def components(events: DataFrame, gap: int) -> DataFrame:
    """Events with ``component``: the start of the stretch of a pair's timeline they lie in.

    Between two neighbours of a timeline that lie more than the gap apart nothing can pair, so a stretch without such a pause is on its
    own. Pauses are looked for inside (pair, day), so a pair with very many matches spreads over its days; a row per pair and day carries
    what crosses midnight.
    """
    rows = events.withColumn("day", F.floor(F.col("at") / DAY_MICROS))
    w = Window.partitionBy(*PAIR, "day").orderBy("at")
    begins = F.when(F.col("at") - F.lag("at").over(w) > gap, F.col("at"))
    rows = rows.withColumn("begins", begins).withColumn("begun", F.max("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = rows.groupBy(*PAIR, "day").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("begins").alias("within"))
    by_day = Window.partitionBy(*PAIR).orderBy("day")
    before = F.lag("last").over(by_day)
    opened = F.when(before.isNull() | (F.col("first") - before > gap), F.col("first"))
    days = days.withColumn("opened", opened)
    open_at_end = F.last(F.coalesce("within", "opened"), ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*PAIR, "day", F.coalesce("opened", open_at_end).alias("at_first"))
    return rows.join(days, [*PAIR, "day"]).withColumn("component", F.coalesce("begun", "at_first")).drop("day", "begins", "begun", "at_first")


_MATCH = ["at", "match_id", "perspective_id", "result", "rival"]
_OUT = pa.schema([*((c, pa.string()) for c in PAIR), *((p + f, pa.int64() if f == "at" else pa.string()) for p in ("a_", "b_") for f in _MATCH)])


def _walker(gap: int, exclude_same_match: bool):
    """A walk over timelines that arrive sorted, one after the other; only matches that still wait and aren't dead are held."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        timeline, waiting = None, (deque(), deque())
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in b.schema.names}
            own, side, found = list(zip(*(columns[c] for c in [*PAIR, "component"]), strict=True)), columns["side"], []
            for i, match in enumerate(zip(*(columns[c] for c in _MATCH), strict=True)):
                if own[i] != timeline:
                    timeline, waiting = own[i], (deque(), deque())
                mine, other = waiting[side[i]], waiting[1 - side[i]]
                dead = match[0] - gap
                if other and other[-1][0] >= dead:
                    taken = other.pop()
                    if not exclude_same_match or taken[1] != match[1]:
                        found.append((*timeline[:4], *((*match, *taken) if side[i] == 0 else (*taken, *match))))
                else:
                    other.clear()  # its latest is dead, so all are
                    while mine and mine[0][0] < dead:
                        mine.popleft()
                    mine.append(match)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * len(_OUT), _OUT, strict=True)], schema=_OUT)

    return walk


def match_pairs(events: DataFrame, max_gap_minutes: int = MAX_GAP_MINUTES, *, exclude_same_match: bool = False) -> DataFrame:
    """Matched event pairs (a_*, b_*) of every pair, over a window or a whole history alike.

    Timelines are cut where a pause exceeds the gap; each stretch is walked once, in order, as a stream: a task holds the matches of the
    last ``max_gap_minutes`` that still wait, however long the stretch is.
    """
    gap = non_negative_int(max_gap_minutes, "max_gap_minutes") * 60_000_000
    keys = [*PAIR, "component"]
    rows = components(events, gap).select(*keys, "side", *_MATCH)
    dealt = rows.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "at", "side", "match_id", "perspective_id")
    return dealt.mapInArrow(_walker(gap, exclude_same_match), from_arrow_schema(_OUT))


def coincident_matches(df: DataFrame, pairs: DataFrame, *, max_gap_minutes: int = MAX_GAP_MINUTES, exclude_same_match: bool = False) -> DataFrame:
    """Coincident matches of every pair, numbered in time order, with their confirmation.

    A direct match of the two players pairs with itself unless ``exclude_same_match``.
    """
    solved = match_pairs(pair_events(df, pairs), max_gap_minutes, exclude_same_match=exclude_same_match)
    rows = solved.withColumn("latest", F.greatest("a_at", "b_at"))
    # Two-level numbering: rank inside a day, plus the counts of the days before.
    rows = rows.withColumn("day", F.floor(F.col("latest") / DAY_MICROS))
    order = ["latest", "a_at", "a_match_id", "a_perspective_id", "b_at", "b_match_id", "b_perspective_id"]
    rank = F.row_number().over(Window.partitionBy(*PAIR, "day").orderBy(*order))
    days = rows.groupBy(*PAIR, "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*PAIR).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(*PAIR, "day", (F.sum("n").over(w) - F.col("n")).alias("before"))
    rows = rows.withColumn("_rank", rank).join(days, [*PAIR, "day"])
    at = {s: F.timestamp_add("MICROSECOND", F.col(f"{s}_at"), F.lit("1970-01-01").cast("timestamp_ntz")) for s in "ab"}
    seconds = F.floor(F.abs(F.col("a_at") - F.col("b_at")) / 1_000_000)
    out = rows.join(pairs, PAIR).withColumns({
        "player_a_league": F.col("league_a"), "player_b_league": F.col("league_b"),
        **{f"player_{s}_{f}": F.col(f"{s}_{f}") for s in "ab" for f in ("match_id", "result", "rival")},
        **{f"player_{s}_timestamp": iso_z(at[s]) for s in "ab"},
        "gap_minutes": F.floor(seconds / 60).cast("int"), "pair_order": (F.col("before") + F.col("_rank")).cast("long"),
        "confirmation": confirmation(F.col("indicator_a"), F.col("a_result"), F.col("indicator_b"), F.col("b_result")),
    })
    return out.select(*PAIR, "indicator_a", "indicator_b", *schemas.COINCIDENT_MATCH)


def pair_headers(pairs: DataFrame, matched: DataFrame, max_gap_minutes: int = MAX_GAP_MINUTES) -> DataFrame:
    """One row per pair, pairs without matches included."""
    n = matched.groupBy(*PAIR).agg(F.count("*").alias("matches"))
    return pairs.join(n, PAIR, "left").fillna({"matches": 0}).withColumns(
        {"max_gap_minutes": F.lit(max_gap_minutes), "operational_window_hours": F.lit(WINDOW_HOURS)})


def selection_metadata(eligible: DataFrame, selected: DataFrame, mode: str = "automatic",
                       excluded: DataFrame | None = None, limit: int = MAX_CANDIDATES) -> DataFrame:
    """One row: eligible players, selected candidates, limit, mode, excluded candidates."""
    e = eligible.agg(F.count_distinct(*KEYS).alias("eligible_players"))
    s = selected.agg(F.count_distinct(*KEYS).alias("selected_candidates"))
    x = (excluded if excluded is not None else eligible.limit(0)).agg(F.count_distinct(*KEYS).alias("excluded_candidates"))
    one = [d.withColumn("_j", F.lit(1)) for d in (e, s, x)]
    return one[0].join(one[1], "_j").join(one[2], "_j").drop("_j").withColumns(
        {"candidate_limit": F.lit(limit), "selection_mode": F.lit(mode)})


def coincident_analysis(df: DataFrame, selected: DataFrame, *, reference_time=None, window_hours: int = WINDOW_HOURS,
                        max_gap_minutes: int = MAX_GAP_MINUTES, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pair headers, matches) for the selected candidates over the window or, without a reference time, the whole history."""
    rows = filters.operational_results(df, excluded)
    if reference_time is not None:
        rows = filters.trailing_hours(rows, reference_time, window_hours)
    pairs = candidate_pairs(selected)
    matched = coincident_matches(rows, pairs, max_gap_minutes=max_gap_minutes)
    return pair_headers(pairs, matched, max_gap_minutes), matched


def pair_reliability(pairs: DataFrame, matched: DataFrame, snap: DataFrame) -> DataFrame:
    """Weighted score of confirmed share, confirmed share of the last five, and indicator strength."""
    confirmed = F.count_if(F.col("confirmation").isNotNull())
    total = matched.groupBy(*PAIR).agg(F.count("*").alias("matches"), confirmed.alias("confirmed"))
    w = Window.partitionBy(*PAIR).orderBy(F.desc("pair_order"))
    recent = matched.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= RECENT)
    recent = recent.groupBy(*PAIR).agg(F.count("*").alias("recent_matches"), confirmed.alias("recent_confirmed"))
    power = F.when(F.col("indicator") == "GREEN", F.col("win_pct")).when(F.col("indicator") == "RED", F.col("loss_pct")).otherwise(F.lit(0.0))
    strength = snap.select(*KEYS, power.alias("strength"))
    a = strength.select(F.col("league").alias("league_a"), F.col("player_key").alias("key_a"), F.col("strength").alias("sa"))
    b = strength.select(F.col("league").alias("league_b"), F.col("player_key").alias("key_b"), F.col("strength").alias("sb"))
    j = pairs.join(total, PAIR, "left").join(recent, PAIR, "left").join(a, PAIR[:2], "left").join(b, PAIR[2:], "left")
    j = j.fillna({"matches": 0, "confirmed": 0, "recent_matches": 0, "recent_confirmed": 0, "sa": 0.0, "sb": 0.0})

    def share(x: str, n: str) -> Column:
        return F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.col(x) / F.col(n) * 100.0)

    history, late = share("confirmed", "matches"), share("recent_confirmed", "recent_matches")
    both = F.when((F.col("sa") > 0) & (F.col("sb") > 0), (F.col("sa") + F.col("sb")) / 2.0).otherwise(F.lit(0.0))
    j = j.withColumn("_s", history * WEIGHTS["history"] + late * WEIGHTS["recent"] + both * WEIGHTS["strength"])

    def reaches(level) -> Column:
        return (F.col("matches") >= level[0]) & (F.col("_s") >= level[1])

    return j.select(
        *PAIR, "player_a", "player_b", F.round("_s", 2).alias("score"),
        F.when(reaches(HIGH), F.lit("HIGH")).when(reaches(MEDIUM), F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("level"),
        "matches", "confirmed", F.round(history, 2).alias("historical_pct"), "recent_matches", "recent_confirmed",
        F.round(late, 2).alias("recent_pct"), F.round(both, 2).alias("indicator_strength"))


def reliable_pairs(reliability: DataFrame, top: int = TOP_PAIRS) -> DataFrame:
    """The best HIGH or MEDIUM pairs (a top-k report)."""
    return reliability.filter(F.col("level").isin("HIGH", "MEDIUM")).orderBy(
        F.desc("score"), F.desc("matches"), F.lower("player_a"), F.lower("player_b")).limit(top)
