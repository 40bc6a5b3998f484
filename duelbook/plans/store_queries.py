"""Registered queries that write histories, lists and tables to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.operators import daily as d
from duelbook.operators import filters, predictions, streak_tables
from duelbook.operators.merge import conform
from duelbook.plans import analysis_queries, stream_queries
from duelbook.plans import fixture_map as fx
from duelbook.plans import oracle as q
from duelbook.plans.registry import registry
from duelbook.schemas import HISTORY_SCHEMA
from duelbook.sources import history, sinks, tracked
from duelbook.streaming import ingest

QUERIES, ORACLE, register = registry()


def _folder(spark, name: str) -> str:
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# --- JSON lines ------------------------------------------------------------------------------

def _stamped(df: DataFrame) -> DataFrame:
    """Perspectives with the stored stamps of their instant, to the second."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumns({"timestamp_utc": F.concat(text, F.lit("Z")), "timestamp": F.concat(text, F.lit("+00:00"))})


_KEEP = "league, match_id, perspective_id, player, rival, result, strftime(ts, '%Y-%m-%d %H:%M:%S') as at"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("league", "match_id", "perspective_id", "player", "rival", "result", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@register(f"with {q.EVENTS} select {_KEEP} from ev")
def jsonl_history(spark, sf):
    """All events exported as JSON lines, one folder a month, and read back strictly from all folders."""
    path = _folder(spark, "jsonl")
    rows = _stamped(fx.event_perspectives(spark, sf)).withColumn("month", F.date_format("ts", "yyyyMM")).select(
        *[c for c in HISTORY_SCHEMA.fieldNames() if c in ("league", "match_id", "perspective_id", "player", "player_key", "rival", "rival_key", "result", "timestamp", "timestamp_utc")], "month")
    rows.write.partitionBy("month").json(path)
    return _shown(history.read_jsonl(spark, path))


@register("""select 'day=' || strftime(ts, '%Y%m%d') as folder, row_number() over (partition by strftime(ts, '%Y%m%d') order by event_id) as line_no, event_id from events
qualify event_id % 97 = 0""")
def invalid_jsonl_lines(spark, sf):
    """Files with damaged lines, one a day: each damaged line with its folder and line number."""
    path = _folder(spark, "damaged")
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.concat(F.when(F.col("event_id") % 97 == 0, F.lit("{broken ")).otherwise(F.lit("{")), F.lit('"match_id": "'), F.col("event_id").cast("string"), F.lit('"}'))
    days = e.select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"), text.alias("value"))
    days.repartition("day").sortWithinPartitions("day", "event_id").select("value", "day").write.partitionBy("day").text(path)
    bad = history.invalid_lines(spark, path)
    return bad.select(F.regexp_extract("path", r"(day=\d+)/", 1).alias("folder"), "line_no", F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("event_id"))


# --- the store ----------------------------------------------------------------------------------

def _store(spark, sf, name: str) -> str:
    """A store of the first half of the events that lacks the rivals."""
    path = _folder(spark, name)
    old = fx.event_perspectives(spark, sf).where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).withColumn("rival", F.lit(""))
    history.write_history(conform(old), path)
    return path


@register(f"with {q.EVENTS} select {_KEEP} from ev")
def updated_store(spark, sf):
    """The store after an update by all events: gaps filled, the rest added."""
    path = _store(spark, sf, "store")
    history.update_history(spark, path, fx.event_perspectives(spark, sf), _folder(spark, "staging"))
    return _shown(history.read_history(spark, path))


@register(f"with {q.EVENTS} select {_KEEP} from ev where league = 'GT' and ts < timestamp '2024-01-16'")
def stored_league_history(spark, sf):
    """One league of a written store."""
    path = _folder(spark, "leagues")
    rows = conform(fx.event_perspectives(spark, sf)).where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    history.write_history(rows.unionByName(rows.withColumn("league", F.lit("EADRIATIC"))), path)
    return _shown(history.read_history(spark, path, league=" gt "))


@register(f"with {q.EVENTS} select {_KEEP} from ev")
def stream_merged_store(spark, sf):
    """The same update as a stream."""
    path = _store(spark, sf, "streamed")
    ingest.merge_into(stream_queries.event_stream(spark, sf, closed=False), path, _folder(spark, "staging"), _folder(spark, "state")).awaitTermination()
    return _shown(history.read_history(spark, path))


@register(f"""with {q.EVENTS}, n as (select *, cast(split_part(match_id, ':', 2) as bigint) as no from ev where ts >= timestamp '2024-01-14' and ts < timestamp '2024-01-17'),
r as (select * replace (case when no % 5 = 0 and ts < timestamp '2024-01-15' then ts - interval 1 day else ts end as ts) from n) select {_KEEP} from r""")
def stream_repaired_store(spark, sf):
    """Three days, some rows a day early, after a repair of two of them as a stream: rows move to their day."""
    path = _folder(spark, "repaired")

    def within(df: DataFrame) -> DataFrame:
        return df.where((F.col("ts") >= F.lit("2024-01-14").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-17").cast("timestamp_ntz")))

    right = within(fx.event_perspectives(spark, sf))
    early = F.split_part("match_id", F.lit(":"), F.lit(2)).cast("long") % 5 == 0
    wrong = right.withColumn("ts", F.when(early, F.timestamp_add("DAY", F.lit(-1), F.col("ts"))).otherwise(F.col("ts")))
    history.write_history(conform(_stamped(wrong)), path)
    stream = _stamped(within(stream_queries.event_stream(spark, sf, closed=False)))
    ingest.repair_from(stream, "2024-01-15", path, _folder(spark, "staging"), _folder(spark, "state")).awaitTermination()
    return _shown(history.read_history(spark, path))


# --- lists and tables -------------------------------------------------------------------------------

_LIST = """l as (select n_nationkey as k, case when n_regionkey % 2 = 0 then 'GT' else 'EADRIATIC' end as league, n_name as name from nation),
lp as (select *, row_number() over (partition by league order by k) - 1 as i from l)"""


def _list(spark, sf) -> str:
    """A tracked list of the nations: stars, an empty slot, directives at its end."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    k = F.col("n_nationkey")
    league = F.when(F.col("n_regionkey") % 2 == 0, F.lit("GT")).otherwise(F.lit("EADRIATIC"))
    line = F.concat(league, F.lit("|"), F.when(k != 7, F.initcap("n_name")).otherwise(F.lit("")), F.when(k % 7 == 3, F.lit("*")).otherwise(F.lit("")))
    named = F.concat(league, F.lit("|"), F.initcap("n_name"))

    def directive(which: str, rest: int):
        return F.concat(F.lit(tracked.DIRECTIVES[which]), F.array_join(F.sort_array(F.collect_list(F.when(k % 6 == rest, named))), ","))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))), lambda x: x["line"])
    whole = n.agg(F.array_join(F.concat(ordered, F.array(directive("selected", 0), directive("excluded", 1))), "\n").alias("value"))
    path = _folder(spark, "list")
    whole.write.text(path)
    return path


@register(f"""with {_LIST} select league, k as pos, case when k = 7 then '' else upper(name[1]) || lower(name[2:]) end as player,
  case when k = 7 then '' else lower(name) end as player_key, k <> 7 as tracked, k % 7 <> 3 and k <> 7 as bettable, k = 7 as empty_slot,
  cast(i // 5 as int) as group_index from lp""".replace("upper(name[1]) || lower(name[2:])", "array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"))
def tracked_list(spark, sf):
    """A tracked list written from the nations and read back."""
    t = tracked.load_tracked(spark, _list(spark, sf))
    return t.select("league", "pos", "player", "player_key", "tracked", "bettable", "empty_slot", "group_index")


@register(f"with {_LIST} select case when k % 6 = 0 then 'selected' else 'excluded' end as kind, league, lower(name) as player_key from l where k % 6 in (0, 1)")
def tracked_directives(spark, sf):
    return tracked.load_directives(spark, _list(spark, sf))


@register(analysis_queries.ORACLE["player_day_summary"])
def csv_player_summary(spark, sf):
    """The player summary written as CSV and read back with its types."""
    daily = d.daily_players(fx.event_perspectives(spark, sf)).withColumn("date", F.date_format("date", "yyyyMMdd"))
    table, path = streak_tables.player_summary(daily), _folder(spark, "csv")
    sinks.write_csv(table, path)
    return sinks.read_csv(spark, path, table.schema)


# --- presentation order --------------------------------------------------------------------------------

@register(f"with {q.PERSPECTIVES} select perspective_id, row_number() over (order by ts, match_id, player_key, perspective_id) as position from p")
def history_positions(spark, sf):
    """Every perspective with its place in presentation order (SRT1)."""
    return filters.numbered(fx.perspectives(spark, sf)).select("perspective_id", "position")


@register(f"""{analysis_queries.PREDICTION_WITH} select row_number() over (order by estimated_win_pct desc, case confidence when 'HIGH' then 1 else 2 end, league, group_index,
  lower(predicted_player), lower(opponent)) as position, league, predicted_player, opponent, estimated_win_pct, confidence
from (select *, row_number() over (partition by league, group_index, player_a, player_b order by estimated_win_pct desc, side) as r from e qualify r = 1) x
where estimated_win_pct >= 50 and confidence in ('HIGH', 'MEDIUM')""")
def prediction_positions(spark, sf):
    """Predictions in presentation order (SRT6)."""
    p = predictions.predictions(fx.perspectives(spark, sf), fx.tracked(spark), min_estimated_win_pct=50)
    return predictions.numbered(p).select("position", "league", "predicted_player", "opponent", "estimated_win_pct", "confidence")
