"""Event-time ordered running state: streaks per player and pairing per pair (STR6, STR7).

Rows wait in state until the watermark has passed them and are then handled in order, so
late data within the delay cannot break a streak.  Needs the RocksDB state store.
"""

from __future__ import annotations

import pickle
import sys
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from duelbook.operators.totals import KEYS
from duelbook.streaming.ingest import REPAIR_DELAY, with_event_time

# The planner's helper process for stateful operators does not see shipped packages, so the
# processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TAIL = 24
#: Microseconds of a slice of waiting rows, as a processor has it by itself, and as the streams below choose it: a slice costs a
#: timer and a handful of calls to the state store, so slices of an hour cost the same whether they hold one row or thousands.
SLICE = 60_000_000
HOUR = 3_600_000_000
#: Rows of one key and micro-batch that are sorted into slices at once.
GATHERED = 500_000
STREAK_SCHEMA = ("league string, player_key string, match_id string, at long, played long, wins long, draws long, "
                 "losses long, current_streak_result string, current_streak long, last_24 string")
PAIR_SCHEMA = ("pair_id string, a_at long, a_match_id string, a_result string, b_at long, b_match_id string, "
               "b_result string, gap_minutes long")


class _Ordered(StatefulProcessor):
    """Keeps rows until the watermark passes them, then hands them on in order.

    Rows wait by slice of time, one entry of a map state each, with one timer at the slice's end. A timer reads and removes its own
    slice and nothing else, and a new row touches its own slice only, so the cost of a row doesn't depend on how many wait. Timers
    of a key come in the order of time. The rows of a key and micro-batch are put together first, so each slice is written once for them.
    """

    buffer_schema = ""
    order: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    slice = SLICE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.buffer_schema.split(", ")]
        fields = ", ".join(c.replace(" ", ": ", 1) for c in self.buffer_schema.split(", "))
        self.buffer = handle.getMapState("slices", "slice long", f"rows array<struct<{fields}>>")
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gathered, n = [], 0
        for batch in rows:
            gathered.append(batch[self.names])
            n += len(batch)
            if n >= GATHERED:
                self._keep(pd.concat(gathered))
                gathered, n = [], 0
        if n:
            self._keep(pd.concat(gathered))
        return iter(())

    def _keep(self, rows: pd.DataFrame) -> None:
        for slice_, part in rows.groupby(rows["at"] // self.slice):
            at = (int(slice_),)
            more = list(zip(*(part[c].tolist() for c in self.names)))
            if self.buffer.containsKey(at):
                more = [tuple(r) for r in self.buffer.getValue(at)[0]] + more
            else:
                self.handle.registerTimer((at[0] + 1) * self.slice // 1000)
            self.buffer.updateValue(at, (more,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.slice - 1,)
        waiting = self.buffer.getValue(at)
        if waiting is None:
            return iter(())
        due = sorted((dict(zip(self.names, r)) for r in waiting[0]), key=lambda r: tuple(r[c] for c in self.order))
        self.buffer.removeKey(at)
        rows = self.advance(key, due)
        return iter((pd.DataFrame(rows, columns=self.columns),)) if rows else iter(())

    def close(self) -> None:
        pass


class RunningStreak(_Ordered):
    buffer_schema = "at long, match_id string, perspective_id string, result string"
    order = ("at", "match_id", "perspective_id")
    columns = tuple(c.split()[0] for c in STREAK_SCHEMA.split(", "))

    def __init__(self, slice_micros: int = SLICE):
        self.slice = slice_micros

    def open(self, handle) -> None:
        self.totals = handle.getValueState("totals", "wins long, draws long, losses long, streak long, tail string")

    def advance(self, key, due: list[dict]) -> list[tuple]:
        state = self.totals.get()
        wins, draws, losses, streak, tail = state if state is not None else (0, 0, 0, 0, "")
        rows = []
        for r in due:
            res = r["result"]
            wins, draws, losses = wins + (res == "V"), draws + (res == "E"), losses + (res == "D")
            streak = streak + 1 if tail[-1:] == res else 1
            tail = (tail + res)[-TAIL:]
            rows.append((key[0], key[1], r["match_id"], r["at"], wins + draws + losses, wins, draws, losses, res, streak, tail))
        if due:
            self.totals.update((wins, draws, losses, streak, tail))
        return rows


def pack(rows: list[tuple]) -> bytes:
    """(at, match_id, result) rows in order, small enough to be copied to every pair of a player."""
    return zlib.compress(pickle.dumps(tuple(zip(*rows)), 5), 1)


def unpack(packed: bytes) -> list[tuple]:
    return list(zip(*pickle.loads(zlib.decompress(packed))))


def _of_hour(packs: list[bytes]) -> list[tuple]:
    """The rows of a side's hour; it has several packs if its pair is listed several times."""
    rows = [r for packed in packs for r in unpack(packed)]
    return sorted(rows, key=lambda r: (r[0], r[1] or "")) if len(packs) > 1 else rows


_AT = itemgetter(0)


class RunningPairs(StatefulProcessor):
    """Pairs the matches of two sides; gets their hours as packed rows, each hour once and never one before an hour it has had.

    The hours of a micro-batch are walked in order, each unpacked when its turn comes, and not at all where the other side has nothing
    within the gap: what such an hour holds only waits. State are the waiting rows that later ones may still take.
    """

    columns = tuple(c.split()[0] for c in PAIR_SCHEMA.split(", "))

    def __init__(self, gap_minutes: int, slice_micros: int = HOUR):
        self.gap = gap_minutes * 60_000_000
        self.slice = slice_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", "a binary, b binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hours: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for batch in rows:
            for hour, side, packed in zip(batch["hour"].tolist(), batch["side"].tolist(), batch["packed"].tolist()):
                hours.setdefault(hour, ([], []))[side].append(packed)
        state = self.waiting.get()
        #: what waits on either side, by time: rows, and after them hours that were not unpacked yet
        stacks = [unpack(bytes(b)) if b is not None else [] for b in state] if state is not None else [[], []]
        closed: list[list] = [[], []]
        found: list[tuple] = []
        for hour in sorted(hours):
            sides, oldest = hours.pop(hour), hour - self.gap
            for s in (0, 1):
                closed[s] = [h for h in closed[s] if h[0] + self.slice > oldest]
                del stacks[s][:bisect_left(stacks[s], oldest, key=_AT)]
            if any(sides[s] and (sides[1 - s] or stacks[1 - s] or closed[1 - s]) for s in (0, 1)):
                for s in (0, 1):
                    for _, packs in closed[s]:
                        stacks[s] += _of_hour(packs)
                    closed[s] = []
                self.walk(key[0], [_of_hour(packs) for packs in sides], stacks, found)
            else:
                for s in (0, 1):
                    if sides[s]:
                        closed[s].append((hour, sides[s]))
            if len(found) >= GATHERED:
                yield pd.DataFrame(found, columns=self.columns)
                found = []
        if found:
            yield pd.DataFrame(found, columns=self.columns)
        left = [stacks[s] + [r for _, packs in closed[s] for r in _of_hour(packs)] for s in (0, 1)]
        latest = max((rows[-1][0] for rows in left if rows), default=0)
        left = [rows[bisect_left(rows, latest - self.gap, key=_AT):] for rows in left]
        if any(left):
            self.waiting.update(tuple(pack(rows) if rows else None for rows in left))
        elif state is not None:
            self.waiting.clear()

    def walk(self, pair: str, sides: list[list], stacks: list[list], found: list[tuple]) -> None:
        """The rows of an hour, by time and at one time the first side before the second: each takes the latest waiting one of the other side, or waits."""
        timeline = sorted([(*r, 0) for r in sides[0]] + [(*r, 1) for r in sides[1]], key=_AT)
        gap = self.gap
        for at, match_id, result, side in timeline:
            other = stacks[1 - side]
            if other and at - other[-1][0] <= gap:
                e_at, e_match, e_result = other.pop()
                minutes = (at - e_at) // 60_000_000
                found.append((pair, e_at, e_match, e_result, at, match_id, result, minutes) if side
                             else (pair, at, match_id, result, e_at, e_match, e_result, minutes))
            else:
                stacks[side].append((at, match_id, result))

    def close(self) -> None:
        pass


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.unix_micros("event_ts"))


def running_streaks(stream: DataFrame, delay: str = REPAIR_DELAY) -> DataFrame:
    """After every match of a player: totals so far, current streak and the last 24 results."""
    rows = _micros(with_event_time(stream, delay)).select(*KEYS, "event_ts", "at", "match_id", "perspective_id", "result")
    return rows.groupBy(*KEYS).transformWithStateInPandas(RunningStreak(HOUR), STREAK_SCHEMA, "append", "eventTime")


def running_pairs(stream: DataFrame, pairs: DataFrame, gap_minutes: int = 30, delay: str = REPAIR_DELAY) -> DataFrame:
    """Coincident matches as they become certain; ``pairs`` is a static table of candidate pairs.

    Waiting matches older than the gap can never be taken and leave the state. A match is sorted and packed once, by player and hour;
    pairs get whole hours, and need no timers, as an hour comes when the watermark has passed it.
    """
    pid = F.concat_ws("|", "league_a", "key_a", "league_b", "key_b").alias("pair_id")
    sides = pairs.select(pid, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("league_a").alias("league"), F.col("key_a").alias("player_key")),
        F.struct(F.lit(1).alias("side"), F.col("league_b").alias("league"), F.col("key_b").alias("player_key")))).alias("s")
    ).select("pair_id", "s.*")
    hours = player_hours(stream, delay).join(sides, KEYS).select("pair_id", "side", "hour", "packed")
    return hours.groupBy("pair_id").transformWithStateInPandas(RunningPairs(gap_minutes), PAIR_SCHEMA, "append", "none")


def player_hours(stream: DataFrame, delay: str = REPAIR_DELAY) -> DataFrame:
    """(league, player_key, hour, packed): the matches of a player and hour in order, once, when the watermark has passed the hour.

    They are collected, sorted and packed here, before they are copied to the player's pairs.
    """
    rows = _micros(with_event_time(stream, delay))
    collected = rows.groupBy(F.window("event_ts", f"{HOUR} microseconds").alias("w"), *KEYS).agg(
        F.array_sort(F.collect_list(F.struct("at", "match_id", "perspective_id", "result"))).alias("rows"))

    def packs(rows: pa.Array) -> pa.Array:
        flat = rows.flatten()
        every = list(zip(*(flat.field(c).to_pylist() for c in ("at", "match_id", "result"))))
        ends = list(accumulate(rows.value_lengths().to_pylist(), initial=0))
        return pa.array([pack(every[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())

    return collected.select(*KEYS, F.unix_micros("w.start").alias("hour"), F.arrow_udf(packs, "binary")("rows").alias("packed"))
