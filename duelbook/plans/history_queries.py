"""Registered queries over filters, validation, merging, totals, windows and H2H."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelbook.functions.times import iso_local, iso_z
from duelbook.operators import filters, merge, quality
from duelbook.operators.h2h import h2h_comparison, h2h_for, h2h_recent, h2h_sequences, h2h_totals
from duelbook.operators.recent import player_windows, recent_forms, recent_vs_history
from duelbook.operators.runs import last_n
from duelbook.operators.totals import player_totals, totals_for
from duelbook.plans import fixture_map as fx
from duelbook.plans import oracle as q
from duelbook.plans.registry import registry

QUERIES, ORACLE, register = registry()
P, EV = q.PERSPECTIVES, q.EVENTS


_ROW = "perspective_id, player, rival, result"
_ROW_COLS = ["perspective_id", "player", "rival", "result"]


# --- filters -----------------------------------------------------------------

@register(f"with {P} select {_ROW} from p where league = 'EADRIATIC'")
def history_by_league(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_league(fx.perspectives(spark, sf), " eadriatic ").select(*_ROW_COLS)


@register(f"with {P} select {_ROW} from p where player_key = 'p7' and league = 'GT'")
def history_of_player(spark, sf):
    return filters.by_player(fx.perspectives(spark, sf), " P7", "gt").select(*_ROW_COLS)


@register(f"with {P} select {_ROW} from p where player_key = 'p7' and rival_key = 'p9'")
def history_player_vs_rival(spark, sf):
    return filters.by_rivalry(fx.perspectives(spark, sf), "P7", "p9").select(*_ROW_COLS)


@register(f"""with {P} select {_ROW} from p
where (player_key = 'p7' and rival_key = 'p9') or (player_key = 'p9' and rival_key = 'p7')""")
def history_head_to_head(spark, sf):
    return filters.head_to_head(fx.perspectives(spark, sf), "P7", "P9").select(*_ROW_COLS)


@register(f"with {P} select {_ROW} from p where ts between timestamp '1996-03-01' and timestamp '1996-03-31'")
def history_by_time(spark, sf):
    return filters.by_time(fx.perspectives(spark, sf), "1996-03-01", datetime(1996, 3, 31)).select(*_ROW_COLS)


@register(f"with {EV}, {q.TRACKED}, {q.OPERATIONAL} select {_ROW} from ops")
def operational_records(spark, sf):
    return filters.operational_results(fx.event_perspectives(spark, sf), filters.excluded_keys(fx.tracked(spark))).select(*_ROW_COLS)


@register(f"with {EV} select {_ROW} from ev where ts between timestamp '2024-01-15 12:00:00' and timestamp '2024-01-15 20:00:00'")
def operational_window(spark, sf):
    return filters.trailing_hours(fx.event_perspectives(spark, sf), fx.REFERENCE_TIME, 8).select(*_ROW_COLS)


@register(f"with {EV} select {_ROW} from ev where cast({q.madrid('ts')} as date) = date '2024-01-15'")
def local_day_records(spark, sf):
    return filters.on_local_day(fx.event_perspectives(spark, sf), "2024-01-15").select(*_ROW_COLS)


@register(f"""with {EV} select {q.day(q.madrid('ts'))} as local_date, count(*) as n from ev
where cast({q.madrid('ts')} as date) in (date '2024-01-15', date '2024-01-16') group by all""")
def repair_relevant_days(spark, sf):
    rows = fx.event_perspectives(spark, sf).withColumn("timestamp", iso_local(F.col("ts")))
    return merge.repair_candidates(rows, "2024-01-15").groupBy(
        F.substring("timestamp", 1, 10).alias("local_date")).agg(F.count("*").alias("n"))


@register(f"""with {P}, {q.TRACKED} select 'tracked' as kind, count(*) as n from p semi join tracked t using (league, player_key)
union all select 'bettable', count(*) from p semi join (from tracked where bettable) t using (league, player_key)
union all select 'excluded', count(*) from p semi join (from tracked where not bettable) t using (league, player_key)""")
def records_by_identity_set(spark, sf):
    """How many perspectives each identity set of the tracked list selects."""
    t = fx.tracked(spark)
    sets = filters.tracked_keys(t).withColumn("kind", F.lit("tracked")) \
        .union(filters.bettable_keys(t).withColumn("kind", F.lit("bettable"))) \
        .union(filters.excluded_keys(t).withColumn("kind", F.lit("excluded")))
    per_player = fx.perspectives(spark, sf).groupBy("league", "player_key").agg(F.count("*").alias("n"))
    return per_player.join(sets, ["league", "player_key"]).groupBy("kind").agg(F.sum("n").alias("n"))


@register(f"""with {P} select {_ROW} from p
order by ts desc, match_id desc, player_key desc, perspective_id desc limit 50""")
def latest_matches(spark, sf):
    return filters.latest(fx.perspectives(spark, sf), 50).select(*_ROW_COLS)


@register(f"""with {P} select {_ROW} from p where player_key = 'p3' and league = 'GT' order by {q.DESC} limit 7""")
def latest_matches_of_player(spark, sf):
    return filters.latest(fx.perspectives(spark, sf), 7, "P3", "GT").select(*_ROW_COLS)


@register(f"""with {P} select {_ROW}, row_number() over (partition by league, player_key order by {q.DESC}) as rn from p
qualify rn <= 10""")
def latest_per_player(spark, sf):
    return last_n(fx.perspectives(spark, sf), ["league", "player_key"], 10).select(*_ROW_COLS, "rn")


# --- quality and merging --------------------------------------------------------

@register(f"with {q.MATCHES} select match_id, home, away, home_score, away_score from matches")
def first_copy_of_match(spark, sf):
    return fx.matches(spark, sf).select("match_id", "home", "away", "home_score", "away_score")


@register(f"with {q.RAW}, p as ({q.sides('rawm')}) select perspective_id, count(*) as copies from p group by 1 having count(*) > 1")
def duplicate_perspectives(spark, sf):
    return quality.duplicate_ids(fx.as_perspectives(_raw_named(spark, sf)))


def _raw_named(spark, sf):
    raw = fx.raw_matches(spark, sf)
    return raw.withColumns({"home": F.concat(F.lit("P"), F.col("home_no").cast("string")),
                            "away": F.concat(F.lit("P"), F.col("away_no").cast("string"))})


def _stamped_matches(spark, sf):
    """The matches with their stamps, which both perspectives share."""
    return fx.matches(spark, sf).withColumns({"timestamp": iso_local(F.col("ts")), "timestamp_utc": iso_z(F.col("ts"))})


def full_records(spark, sf):
    """Complete stored records derived from the matches, a share of them damaged by match number."""
    p = fx.as_perspectives(_stamped_matches(spark, sf), "match_no", "timestamp", "timestamp_utc")
    n, home = F.col("match_no"), F.col("home_away") == "home"
    good = p.withColumns({
        "schema_version": F.lit(1), "timestamp_precision": F.lit("second"), "timezone": F.lit("Europe/Madrid"), "timezone_inferred": F.lit(True),
        "source_type": F.lit("table"), "source_file": F.lit("lineitem"), "data_quality": F.lit("complete"),
    })
    return good.withColumns({
        "schema_version": F.when(n % 101 == 1, 2).otherwise(F.col("schema_version")),
        "result": F.when((n % 103 == 1) & home, F.lit("X")).otherwise(F.col("result")),
        "timestamp_utc": F.when((n % 107 == 1) & home, F.replace("timestamp_utc", F.lit("Z"), F.lit(""))).otherwise(F.col("timestamp_utc")),
        "home_score": F.when((n % 109 == 1) & home, F.lit(-1)).otherwise(F.col("home_score")),
        "player_key": F.when((n % 113 == 1) & ~home, F.col("player")).otherwise(F.col("player_key")),
        "timezone": F.when(n % 127 == 1, F.lit("")).otherwise(F.col("timezone")),
        "data_quality": F.when(n % 131 == 1, F.lit("perfect")).otherwise(F.col("data_quality")),
    })


@register(f"""with {P} , bad as (
  select 'schema_version' as rule from p where match_no % 101 = 1
  union all select 'result' from p where match_no % 103 = 1 and home_away = 'home'
  union all select 'result against score' from p where home_away = 'home' and (match_no % 103 = 1 or
     (match_no % 109 = 1 and result <> case when -1 > away_score then 'V' when -1 < away_score then 'D' else 'E' end))
  union all select 'timestamp_utc' from p where match_no % 107 = 1 and home_away = 'home'
  union all select 'scores' from p where match_no % 109 = 1 and home_away = 'home'
  union all select 'keys not normalized' from p where match_no % 113 = 1 and home_away = 'away'
  union all select 'timezone' from p where match_no % 127 = 1
  union all select 'data_quality' from p where match_no % 131 = 1)
select rule, count(*) as rows from bad group by 1""")
def record_error_counts(spark, sf):
    return quality.error_counts(full_records(spark, sf))


@register(f"""with {P}, bad as (
  select distinct match_id, 'results not symmetric' as error from p where home_away = 'home' and (match_no % 103 = 1
     or (match_no % 109 = 1 and result <> case when -1 > away_score then 'V' when -1 < away_score then 'D' else 'E' end))
  union select match_id, 'disagree on timestamp_utc' from p where match_no % 107 = 1
  union select match_id, 'disagree on home_score' from p where match_no % 109 = 1
  union select match_id, 'players not symmetric' from p where match_no % 113 = 1)
select match_id, error from bad""")
def match_pair_errors(spark, sf):
    return quality.pair_errors(full_records(spark, sf)).select("match_id", F.explode("errors").alias("error"))


def _copies(spark, sf):
    """Every raw copy of every perspective with its arrival number and gaps in some fields."""
    raw = fx.raw_matches(spark, sf).select("match_no", "league", *fx.FIRST_WINS)
    raw = raw.withColumn("arrival", F.row_number().over(Window.partitionBy("match_no", "league").orderBy(*fx.FIRST_WINS)).cast("long"))
    raw = fx.described(raw, "arrival")
    sides = F.explode(F.array(F.struct("home", "away"), F.struct(F.col("away").alias("home"), F.col("home").alias("away"))))
    r = raw.withColumn("s", sides)
    return r.select(
        F.concat_ws(":", "match_id", F.lower("s.home")).alias("perspective_id"), "league", "match_id", "arrival",
        F.when(F.col("arrival") % 2 == 0, F.col("s.away")).otherwise(F.lit("")).alias("rival"),
        F.when(F.col("home_score") > 0, F.col("home_score")).alias("home_score"),
        F.element_at(F.array(F.lit("partial"), F.lit("inferred"), F.lit("complete")), (F.col("away_score") % 3 + 1).cast("int")).alias("data_quality"),
    )


_COPIES = q.RAW + """, c as (
  select match_id || ':' || lower(home) as perspective_id, league, match_id, copy as arrival,
    case when copy % 2 = 0 then away else '' end as rival, case when home_score > 0 then home_score end as home_score,
    away_score % 3 as quality from rawm
  union all select match_id || ':' || lower(away), league, match_id, copy,
    case when copy % 2 = 0 then home else '' end, case when home_score > 0 then home_score end, away_score % 3 from rawm)"""


@register(f"""with {_COPIES} select perspective_id, any_value(league) as league, any_value(match_id) as match_id,
  arg_min(rival, arrival) filter (where rival <> '') as rival,
  arg_min(home_score, arrival) filter (where home_score is not null) as home_score,
  ['partial', 'inferred', 'complete'][max(quality) + 1] as data_quality from c group by perspective_id""")
def merged_history(spark, sf):
    return merge.merge_history(_copies(spark, sf))


@register(f"""with {_COPIES}, v as (
  select perspective_id, 'rival' as field, rival as value, min(arrival) as arrival from c where rival <> '' group by all
  union all select perspective_id, 'home_score', cast(home_score as varchar), min(arrival) from c where home_score is not null group by all)
select perspective_id, field, arg_min(value, arrival) as kept, count(*) as distinct_values from v group by 1, 2 having count(*) > 1""")
def merge_conflict_report(spark, sf):
    return merge.merge_conflicts(_copies(spark, sf))


def _repair_sides(spark, sf):
    """Stored rows and re-collected candidates derived from the matches."""
    p = fx.as_perspectives(_stamped_matches(spark, sf), "match_no", "timestamp", "timestamp_utc")
    p = p.withColumns({"round": F.lit("R1"), "source_file": F.lit("first")})
    stored = p.filter("match_no % 7 <> 0").drop("match_no")
    n = F.col("match_no")
    new = p.filter("match_no % 3 = 0 OR match_no % 7 = 0").withColumns({
        "source_file": F.lit("repair"),
        "round": F.when(n % 5 == 0, F.lit("R2")).otherwise(F.col("round")),
        "home_score": F.when(n % 11 == 0, F.col("home_score") + 9).otherwise(F.col("home_score")),
    }).drop("match_no")
    return stored, new


_REPAIR = f"""with {P}, r as (select p.*, match_no % 7 <> 0 as old, match_no % 3 = 0 or match_no % 7 = 0 as new from p),
a as (select *, case when not new then 'stored' when not old then 'added' when match_no % 11 = 0 then 'conflict'
  when match_no % 5 = 0 then 'updated' else 'unchanged' end as action from r where old or new)"""


@register(f"{_REPAIR} select action, count(*) as perspectives from a group by 1")
def repair_action_counts(spark, sf):
    return merge.repair_counts(merge.reconcile_repair(*_repair_sides(spark, sf)))


@register(f"""{_REPAIR} select perspective_id, action,
  case when action in ('updated', 'added') then 'repair' else 'first' end as source_file,
  case when action in ('updated', 'added') and match_no % 5 = 0 then 'R2' else 'R1' end as round,
  home_score + case when action = 'added' and match_no % 11 = 0 then 9 else 0 end as home_score from a""")
def repaired_history(spark, sf):
    return merge.reconcile_repair(*_repair_sides(spark, sf)).select("perspective_id", "action", "source_file", "round", "home_score")


@register(f"""with {P} select perspective_id, player, result, case when match_no % 4 = 0 then 'a' else 'b' end as round from p""")
def upserted_history(spark, sf):
    """A part of the matches is stored already, all are candidates: stored values win, nothing doubles."""
    p = fx.as_perspectives(fx.matches(spark, sf), "match_no")
    old = p.filter("match_no % 4 = 0").withColumn("round", F.lit("a")).drop("match_no")
    new = p.withColumn("round", F.lit("b")).drop("match_no")
    return merge.upsert(merge.upsert(old, new), new).select("perspective_id", "player", "result", "round")


# --- totals -----------------------------------------------------------------------

def _totals_sql(where: str = "true") -> str:
    return f"""with {P}, base as (from p where {where}), {q.runs('base', 'league, player_key')},
t as (select league, player_key, arg_max(player, (ts, match_id, perspective_id)) as player, count(*) as played, {q.counts()},
  {q.day('min(ts)')} as first_match_date, {q.day('max(ts)')} as last_match_date from base group by 1, 2),
s as (select league, player_key, arg_max(v, last_rn) as current_streak_result, arg_max(len, last_rn) as current_streak,
  coalesce(max(len) filter (where v = 'V'), 0) as best_win_streak, coalesce(max(len) filter (where v = 'D'), 0) as best_loss_streak
  from runs group by 1, 2)
select t.league, player, played, wins, draws, losses, {q.pcts('played')}, current_streak_result, current_streak,
  best_win_streak, best_loss_streak, first_match_date, last_match_date from t join s using (league, player_key)"""


@register(_totals_sql())
def player_history_totals(spark, sf):
    return player_totals(fx.perspectives(spark, sf))


@register(_totals_sql("league = 'GT'"))
def player_history_totals_of_league(spark, sf):
    return player_totals(fx.perspectives(spark, sf), league="gt")


@register(_totals_sql("player_key = 'p11'"))
def player_history_totals_of_player(spark, sf):
    return player_totals(fx.perspectives(spark, sf), player="p11")


@register(_totals_sql("player_key = 'p5' and league = 'GT'") + """
union all select 'GT', 'Nobody', 0, 0, 0, 0, 0, 0, 0, null, 0, 0, 0, null, null""")
def player_totals_with_unknown(spark, sf):
    wanted = spark.createDataFrame([("GT", "P5", "p5"), ("GT", "Nobody", "nobody")], "league string, player string, player_key string")
    return totals_for(fx.perspectives(spark, sf), wanted)


# --- recent windows -----------------------------------------------------------------

_LAST = f"""l as (select *, row_number() over (partition by league, player_key order by {q.DESC}) as rn from p)"""
_ALL = f"h as (select league, player_key, count(*) as played, {q.counts()} from p group by 1, 2), hp as (select *, {q.pcts('played')} from h)"


def _window_sql(sizes: str) -> str:
    return f"""{_LAST}, w as (select l.league, l.player_key, z.ord, z.n as win, count(*) as available, {q.counts()}, {q.seq()} as sequence,
  arg_min(player, rn) as player, {q.day('min(ts)')} as first_match_date, {q.day('max(ts)')} as last_match_date
  from l join (values {sizes}) z(ord, n) on rn <= z.n group by all),
wp as (select *, {q.pcts('available')}, right(sequence, 1) as current_streak_result,
  {q.trailing('sequence', '(V+|E+|D+)$')} as current_streak from w)"""


@register(f"""with {P}, {_window_sql('(0, 5), (1, 10), (2, 20)')}
select league, player, win as "window", available, wins, draws, losses, win_pct, draw_pct, loss_pct, sequence, current_streak_result,
  current_streak, first_match_date, last_match_date from wp""")
def player_recent_windows(spark, sf):
    return player_windows(fx.perspectives(spark, sf), [20, 5, 10, 5])


_DELTAS = ", ".join(
    f"wp.{n}_pct as recent_{n}_pct, hp.{n}_pct as historical_{n}_pct, round(wp.{n}_pct - hp.{n}_pct, 2) as {n}_pct_delta" for n in ("win", "draw", "loss"))


@register(f"""with {P}, {_window_sql('(0, 10)')}, {_ALL}
select league, player, win as "window", available as recent_available, played as historical_played, {_DELTAS}
from wp join hp using (league, player_key)""")
def player_recent_against_history(spark, sf):
    return recent_vs_history(fx.perspectives(spark, sf), 10)


def _best(v: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all(sequence, '{v}+'), lambda x: length(x))), 0)"


@register(f"""with {P}, {_window_sql('(0, 10), (1, 5), (2, 10)')}, {_ALL}
select ord, league, player, available as played, wp.wins, wp.draws, wp.losses, wp.win_pct, wp.draw_pct, wp.loss_pct,
  current_streak_result, current_streak, {_best('V')} as best_win_streak, {_best('D')} as best_loss_streak,
  first_match_date, last_match_date, win as window_size, available as available_matches, available = win as window_complete,
  hp.played as historical_played, hp.win_pct as historical_win_pct, round(wp.win_pct - hp.win_pct, 2) as win_pct_delta,
  {q.trend('round(wp.win_pct - hp.win_pct, 2)', 'available')} as trend from wp join hp using (league, player_key)""")
def player_recent_forms(spark, sf):
    return recent_forms(fx.perspectives(spark, sf), [10, 5, 10])


@register(f"""with {P}, p2 as (from p where player_key = 'p4' and rival_key = 'p9'),
l as (select *, row_number() over (partition by league order by {q.DESC}) as rn from p2),
w as (select league, count(*) as available, {q.counts()} from l where rn <= 5 group by 1),
h as (select league, count(*) as played, count(*) filter (where result = 'V') as hw from p2 group by 1),
x as (select league, available, played, {q.pct2('wins', 'available')} as win_pct, {q.pct2('hw', 'played')} as historical_win_pct from w join h using (league))
select league, available as played, win_pct, historical_win_pct, round(win_pct - historical_win_pct, 2) as win_pct_delta,
  {q.trend('round(win_pct - historical_win_pct, 2)', 'available')} as trend from x""")
def recent_form_against_rival(spark, sf):
    return recent_forms(fx.perspectives(spark, sf), [5], player="P4", rival="P9").select(
        "league", "played", "win_pct", "historical_win_pct", "win_pct_delta", "trend")


# --- head to head ---------------------------------------------------------------------

_REL = "league, player_key, rival_key"
_H2H = f"""h as (select {_REL}, arg_max(player, (ts, match_id, perspective_id)) as player, arg_max(rival, (ts, match_id, perspective_id)) as rival,
  count(*) as played, {q.counts()}, {q.seq()} as sequence, {q.day('min(ts)')} as first_match_date, {q.day('max(ts)')} as last_match_date
  from p group by 1, 2, 3), hp as (select *, {q.pcts('played')} from h)"""
_H2H_RECENT = f"""l as (select *, row_number() over (partition by {_REL} order by {q.DESC}) as rn from p),
w as (select {_REL}, any_value(player) as player, any_value(rival) as rival, count(*) as available, {q.counts()}, {q.seq()} as sequence,
  {q.day('min(ts)')} as first_match_date, {q.day('max(ts)')} as last_match_date from l where rn <= 20 group by 1, 2, 3),
wp as (select *, {q.pcts('available')}, right(sequence, 1) as current_streak_result, {q.trailing('sequence', '(V+|E+|D+)$')} as current_streak from w)"""
_TOTAL_COLS = "league, player, rival, played, wins, draws, losses, win_pct, draw_pct, loss_pct, sequence, first_match_date, last_match_date"


@register(f"with {P}, {_H2H} select {_TOTAL_COLS} from hp")
def h2h_history_totals(spark, sf):
    return h2h_totals(fx.perspectives(spark, sf), text=True)


@register(f"with {P} select {_REL}, date_trunc('month', ts)::date as slice, count(*) as n, {q.seq()} as seq from p group by all")
def h2h_history_sequences(spark, sf):
    """The results behind the totals as text, by relation and month."""
    return h2h_sequences(fx.perspectives(spark, sf))


@register(f"""with {P}, {_H2H} select {_TOTAL_COLS} from hp
where league = 'GT' and player_key = 'p1' and rival_key = 'p2'
union all select 'GT', 'P1', 'Nobody', 0, 0, 0, 0, 0, 0, 0, '', null, null""")
def h2h_totals_with_unknown(spark, sf):
    wanted = spark.createDataFrame([("GT", "P1", "p1", "P2", "p2"), ("GT", "P1", "p1", "Nobody", "nobody")],
                                   "league string, player string, player_key string, rival string, rival_key string")
    return h2h_for(fx.perspectives(spark, sf), wanted, text=True)


@register(f"""with {P}, {_H2H_RECENT} select league, player, rival, 20 as "window", available, available >= 20 as window_complete, wins, draws, losses,
  win_pct, draw_pct, loss_pct, sequence, current_streak_result, current_streak, first_match_date, last_match_date from wp""")
def h2h_recent_windows(spark, sf):
    return h2h_recent(fx.perspectives(spark, sf))


@register(f"""with {P}, {_H2H}, {_H2H_RECENT} select league, hp.player, hp.rival, 20 as "window", available as recent_available,
  played as historical_played, {_DELTAS}, {q.trend('round(wp.win_pct - hp.win_pct, 2)', 'available')} as trend,
  case when available = 0 then 'EMPTY' when available < 20 then 'LOW_SAMPLE' else 'COMPLETE' end as sample_status
from hp join wp using ({_REL}) where played >= 10""")
def h2h_recent_against_history(spark, sf):
    return h2h_comparison(fx.perspectives(spark, sf), min_historical_matches=10)
