"""Registered streaming queries: the events table drained as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.functions.times import from_micros, iso_z
from duelbook.operators import pairing
from duelbook.plans import fixture_map as fx
from duelbook.plans import oracle as q
from duelbook.plans.analysis_queries import CANDIDATE_PAIRS, walk_sql
from duelbook.plans.registry import registry
from duelbook.streaming import ingest, stateful, windows

QUERIES, ORACLE, register = registry()


def event_stream(spark, sf, closed: bool = True) -> DataFrame:
    """The events file as a one-file stream of perspectives.

    ``closed`` adds one row of a league of its own, far in the future: the watermark follows it past the last event, so
    everything that waits for the watermark comes out. The row itself stays behind the watermark and never does.
    """
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = fx.events_as_perspectives(raw)
    if not closed:
        return rows
    folder = f"{spark.sparkContext.getCheckpointDir()}/end-{uuid.uuid4().hex}"
    end = spark.range(1).select(*[F.lit("~").alias(c) for c in rows.columns if c not in ("ts", "result")], F.lit("V").alias("result"),
                                F.lit("2100-01-01").cast("timestamp_ntz").alias("ts")).select(*rows.columns)
    end.write.parquet(folder)
    return rows.unionByName(spark.readStream.schema(end.schema).parquet(folder))


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream until its input is used up; the result lies in the shared checkpoint folder."""
    spark = df.sparkSession
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out") \
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@register(f"with {q.EVENTS} select perspective_id, result from ev")
def stream_unique_perspectives(spark, sf):
    """Every event sent twice, each perspective kept once."""
    s = event_stream(spark, sf, closed=False)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return drained(ingest.unique_perspectives(twice).select("perspective_id", "result"))


_SESS = f"""g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) <= 5400000000 then 0 else 1 end as fresh from ev
  window w as (partition by player_key order by {q.ORDER})),
n as (select *, sum(fresh) over (partition by player_key order by {q.ORDER} rows unbounded preceding) as s from g),
se as (select league, player_key, count(*) as played, {q.counts()}, min(ts) as a, max(ts) as z from n group by league, player_key, s)"""


@register(f"""with {q.EVENTS}, {_SESS} select league, player_key, played, wins, draws, losses, {q.zulu('a')} as start, {q.zulu('z')} as "end" from se""")
def stream_closed_sessions(spark, sf):
    """All sessions, each given out when the watermark closes it."""
    s = drained(windows.streaming_sessions(event_stream(spark, sf)).drop("s"))
    return s.withColumns({"start": iso_z(F.col("start")), "end": iso_z(F.col("end"))})


@register(f"""with {q.EVENTS}, w as (select ev.*, make_timestamp((epoch_us(ts) // 900000000 - k) * 900000000) as start from ev, range(32) r(k)),
g as (select league, player_key, start, count(*) as played, {q.counts()} from w group by 1, 2, 3)
select league, player_key, {q.zulu('start')} as start, played, wins, draws, losses, {q.pcts('played')}, {q.INDICATOR} as indicator from g""")
def stream_sliding_snapshot(spark, sf):
    """Eight-hour windows every 15 minutes, each given out when the watermark closes it."""
    s = windows.sliding_snapshot(event_stream(spark, sf))
    out = drained(s.select("league", "player_key", F.col("window.start").alias("start"), "played", "wins", "draws", "losses",
                           "win_pct", "draw_pct", "loss_pct", "indicator"))
    return out.withColumn("start", iso_z(from_micros(F.unix_micros("start"))))


def _with_rocksdb(spark, build):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.ROCKSDB)
    try:
        return build()
    finally:
        spark.conf.set(name, before)


@register(f"""with {q.EVENTS}, o as (select *, row_number() over w as played, case when result = lag(result) over w then 0 else 1 end as fresh,
  count(*) filter (where result = 'V') over (w rows unbounded preceding) as wins, count(*) filter (where result = 'E') over (w rows unbounded preceding) as draws,
  count(*) filter (where result = 'D') over (w rows unbounded preceding) as losses,
  string_agg(result, '') over (w rows between 23 preceding and current row) as last_24
  from ev window w as (partition by player_key order by {q.ORDER})),
s as (select *, max(case when fresh = 1 then played end) over (partition by player_key order by {q.ORDER} rows unbounded preceding) as since from o)
select league, player_key, match_id, epoch_us(ts) as at, played, wins, draws, losses, result as current_streak_result, played - since + 1 as current_streak, last_24 from s""")
def stream_running_streaks(spark, sf):
    """Totals and streak after every match."""
    return _with_rocksdb(spark, lambda: drained(stateful.running_streaks(event_stream(spark, sf))))


@register(f"""with recursive {q.EVENTS}, {q.TRACKED}, ops as (from ev),
cand as (select league, player_key, player, 'NONE' as indicator from tracked where bettable and league = 'GT'), {CANDIDATE_PAIRS}, {walk_sql('')}
select concat_ws('|', league_a, h.key_a, league_b, h.key_b) as pair_id, epoch_us(h.a.at) as a_at, h.a.m as a_match_id, h.a.res as a_result,
  epoch_us(h.b.at) as b_at, h.b.m as b_match_id, h.b.res as b_result, abs(epoch_us(h.a.at) - epoch_us(h.b.at)) // 60000000 as gap_minutes
from hits h join pairs p using (key_a, key_b)""")
def stream_running_pairs(spark, sf):
    """Coincident matches of all pairs of the list, as a stream."""
    listed = fx.tracked(spark).filter("bettable and league = 'GT'")
    pairs = pairing.candidate_pairs(listed.withColumn("indicator", F.lit("NONE")))
    return _with_rocksdb(spark, lambda: drained(stateful.running_pairs(event_stream(spark, sf), pairs)))
