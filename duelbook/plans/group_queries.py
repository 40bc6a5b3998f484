"""Registered queries over target groups, daily groups and H2H alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duelbook.operators import alerts, filters, groups, snapshot
from duelbook.operators import daily as d
from duelbook.plans import fixture_map as fx
from duelbook.plans import oracle as q
from duelbook.plans.registry import registry
from duelbook.sources import sinks

QUERIES, ORACLE, register = registry()

def _day():
    """Days of the match table are days of the UTC stamp."""
    return F.col("ts").cast("date")


def _daily(spark, sf):
    return d.daily_rivals(fx.perspectives(spark, sf), _day())


def _day_counts(spark, sf):
    """The counts of every relation and day, written once: day groups and what is made of them look at them many times.

    It has a row per relation and day, however many matches these had.
    """
    path = f"{spark.sparkContext.getCheckpointDir()}/daily-{uuid.uuid4().hex}"
    counts = _daily(spark, sf).select(*d.RIVAL_DAY, "played", *groups.COUNTS)
    counts.write.parquet(path)
    return spark.read.schema(counts.schema).parquet(path)


def _targets(spark, size: int = 5):
    return groups.target_groups(fx.tracked(spark), size)


def _h2h(spark, sf, text: bool = False):
    t = _targets(spark)
    return groups.group_h2h(t, d.daily_rivals(groups.among_targets(t, fx.perspectives(spark, sf)), _day(), text), text)


def _tg(size: int) -> str:
    return f"""tg as (select league, player, (pos % 40) // {size} as group_no, {size} as group_size, (pos % 40) % {size} + 1 as slot from tracked)"""


_DLY = f"""dly as (select league, cast(ts as date) as date, player, rival, {q.counts()}, {q.seq()} as seq from p group by all)"""
_GH = f"""gh as (select t.league, t.group_no, t.group_size, d.player, d.rival, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('wins', 'draws', 'losses'))},
    string_agg(seq, '' order by date) as seq from dly d join tg t on (t.league, t.player) = (d.league, d.player)
  join tg u on (u.league, u.group_no, u.player) = (t.league, t.group_no, d.rival) group by all),
h as (select *, wins + draws + losses as matches, {q.pct('wins', '(wins + draws + losses)')} as win_pct, {q.pct('draws', '(wins + draws + losses)')} as draw_pct,
  {q.pct('losses', '(wins + draws + losses)')} as loss_pct, right(seq, 5) as last5, right(seq, 10) as last10,
  {q.trailing('seq', 'V*$')} as win_run, {q.trailing('seq', '[^D]*$')} as unbeaten_run from gh)"""
_WITH = f"with {q.PERSPECTIVES}, {q.TRACKED}, {_tg(5)}, {_DLY}, {_GH}"
_CELL = "wins, draws, losses, matches, win_pct, draw_pct, loss_pct, last5, last10, win_run, unbeaten_run"


@register(f"{_WITH} select * from h")
def group_h2h_totals(spark, sf):
    return _h2h(spark, sf, text=True).drop("player_key", "rival_key")


@register(f"""with {q.PERSPECTIVES}, {q.TRACKED}, {_tg(5)} select p.league, p.player_key, p.player, p.rival_key, p.rival, date_trunc('month', p.ts)::date as slice, count(*) as n,
  {q.seq()} as seq from p join tg t on (t.league, t.player) = (p.league, p.player) join tg u on (u.league, u.group_no, u.player) = (t.league, t.group_no, p.rival) group by all""")
def group_h2h_sequences(spark, sf):
    """The results behind the group totals as text, by relation and month."""
    return groups.group_sequences(_targets(spark), fx.perspectives(spark, sf))


@register(f"{_WITH} select league, group_no, player, rival, {_CELL} from h")
def group_h2h_matrix(spark, sf):
    """The nested matrix, one line per cell."""
    m = groups.nested_matrix(_h2h(spark, sf))
    return m.select("league", "group_no", "player", F.explode("rivals").alias("c")).select("league", "group_no", "player", "c.*")


@register(f"""{_WITH}, pw0 as (select tg.league, tg.group_no, tg.player, list(win_pct - 50 order by rival) filter (where rival is not null) as l
  from tg left join h using (league, group_no, player) group by all),
pw as (select league, group_no, player, list_reduce(list_prepend(0::double, coalesce(l, [])), lambda a, b: a + b) as score from pw0)
select *, row_number() over (partition by league, group_no order by score desc, player) as position from pw""")
def group_power_ranking(spark, sf):
    return groups.power_ranking(_targets(spark), _h2h(spark, sf))


@register(f"""{_WITH} select tg.league, tg.group_no, tg.player, count(*) filter (where win_pct > 50) as wins, count(h.rival) as rivals
from tg left join h using (league, group_no, player) group by all""")
def group_dominance(spark, sf):
    return groups.dominance(_targets(spark), _h2h(spark, sf))


_RANK = f"""rk0 as (select tg.league, tg.group_no, tg.player, cast(coalesce(sum(wins), 0) as bigint) as w, cast(coalesce(sum(matches), 0) as bigint) as matches
  from tg left join h using (league, group_no, player) group by all),
rk as (select league, group_no, player, matches, {q.pct('w', 'matches')} as score, {q.pct('w', 'matches')} * matches as weighted_score from rk0),
ranked as (select *, row_number() over (partition by league, group_no order by weighted_score desc, player) as position from rk)"""


@register(f"{_WITH}, {_RANK} from ranked")
def group_h2h_ranking(spark, sf):
    return groups.h2h_ranking(_targets(spark), _h2h(spark, sf))


_PICK = """pick as (select * exclude (r) from (select league, group_no, 'back' as side, player, score, matches, weighted_score,
    row_number() over (partition by league, group_no order by score desc, position) as r from ranked) where r = 1
  union all select * exclude (r) from (select league, group_no, 'lay', player, score, matches, weighted_score,
    row_number() over (partition by league, group_no order by score, position) as r from ranked) where r = 1)"""


@register(f"{_WITH}, {_RANK}, {_PICK} from pick")
def group_back_and_lay(spark, sf):
    return groups.back_and_lay(groups.h2h_ranking(_targets(spark), _h2h(spark, sf)))


@register(f"""{_WITH}, {_RANK}, {_PICK} select p.league, p.group_no, p.side, p.player, h.group_size, h.rival, {', '.join('h.' + c for c in _CELL.split(', '))},
  row_number() over (partition by p.league, p.group_no, p.side order by case p.side when 'back' then -h.win_pct else h.win_pct end, h.rival) as place
from pick p join h using (league, group_no, player) qualify place <= 3""")
def group_matchups(spark, sf):
    h = _h2h(spark, sf)
    return groups.matchups(groups.back_and_lay(groups.h2h_ranking(_targets(spark), h)), h).drop("player_key", "rival_key")


@register(f"""with {q.PERSPECTIVES}, {q.TRACKED}, {_tg(5)}, n as (select league, group_no, group_size, list(player order by slot) as m from tg group by all)
select n.league, n.group_no, array_to_string(list_transform(m, lambda x: lower(x)), '-') as group_id, array_to_string(m, ' / ') as label,
  count(p.match_id) as member_matches from n join tg using (league, group_no) left join p on p.league = tg.league and p.player = tg.player group by all""")
def group_names_with_volume(spark, sf):
    """Ids and labels of the target groups with the number of perspectives behind them."""
    t = _targets(spark)
    per_player = fx.perspectives(spark, sf).groupBy("league", "player").agg(F.count("*").alias("n"))
    volume = t.join(per_player, ["league", "player"], "left").groupBy("league", "group_no").agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("member_matches"))
    return groups.group_names(t).drop("members", "group_size").join(volume, ["league", "group_no"])


# --- daily groups ------------------------------------------------------------------------------

_DAYGROUPS = f"""pl as (select league, date, player, sum(wins + draws + losses) as played from dly group by all),
ord as (select league, date, player, row_number() over (partition by league, date order by played desc, player) as row_no from pl),
nb as (select league, date, player as seed, list_sort(list_append(list(distinct rival), player)) as members from dly group by league, date, player),
arm as (select league, date, seed, members, unnest(members) as player from nb),
met as (select a.league, a.date, a.seed, a.members, count(*) as met from arm a join (select distinct league, date, player, rival from dly) e
  using (league, date, player) where list_contains(a.members, e.rival) group by all),
val as (select m.league, m.date, m.seed, m.members, row_no from met m join ord o on (o.league, o.date, o.player) = (m.league, m.date, m.seed)
  where met = len(members) * (len(members) - 1)),
seq as (select *, row_number() over (partition by league, date order by row_no) as i from val),
pick as (select league, date, i, seed, members, true as taken, members as used from seq where i = 1
  union all select s.league, s.date, s.i, s.seed, s.members, not list_contains(k.used, s.seed),
    case when list_contains(k.used, s.seed) then k.used else list_concat(k.used, s.members) end
  from pick k join seq s on (s.league, s.date) = (k.league, k.date) and s.i = k.i + 1),
dg as (select league, date, seed as group_seed, unnest(members) as member from pick where taken)"""
_WITH_DAYS = f"with recursive {q.PERSPECTIVES}, {q.TRACKED}, {_tg(2)}, {_DLY}, {_DAYGROUPS}"


def _day_groups(daily):
    """The closed groups of daily counts; a player's matches of a day are those against all rivals."""
    players = daily.groupBy(*d.PLAYER_DAY).agg(F.sum("played").alias("played"))
    return groups.day_groups(daily, groups.report_order(players))


@register(f"{_WITH_DAYS} from dg")
def closed_day_groups(spark, sf):
    return _day_groups(_day_counts(spark, sf))


_OV = """ov as (select t.league, t.group_no, t.group_size, d.date, d.group_seed, count(*) as common from dg d join tg t on (t.league, t.player) = (d.league, d.member) group by all),
ovk as (select *, case when common = group_size then 'exact' when group_size > 1 and common >= group_size - 1 then 'near' end as kind from ov)"""


def _overlap(spark, sf):
    return groups.group_overlap(_targets(spark, 2), _day_groups(_day_counts(spark, sf)))


@register(f"{_WITH_DAYS}, {_OV} select * from ovk where kind is not null")
def day_group_overlap(spark, sf):
    return _overlap(spark, sf)


@register(f"""{_WITH_DAYS}, {_OV} select distinct tg.league, tg.group_no, tg.group_size, coalesce(e, 0) as exact_matches, coalesce(n, 0) as near_matches from tg
left join (select league, group_no, count(*) filter (where kind = 'exact') as e, count(*) filter (where kind = 'near') as n from ovk group by 1, 2) using (league, group_no)""")
def day_group_overlap_counts(spark, sf):
    return groups.overlap_counts(_targets(spark, 2), _overlap(spark, sf))


@register(f"""{_WITH_DAYS}, {_OV}, cm as (select k.league, k.group_no, k.date, k.group_seed, k.kind, d.member from ovk k join dg d using (league, date, group_seed)
  join tg t on (t.league, t.group_no, t.player) = (k.league, k.group_no, d.member) where kind is not null),
g as (select a.league, a.group_no, a.kind, y.player, cast(sum(wins) as bigint) as wins, cast(sum(draws) as bigint) as draws, cast(sum(losses) as bigint) as losses
  from dly y join cm a on (a.league, a.date, a.member) = (y.league, y.date, y.player)
  join cm b on (b.league, b.group_no, b.date, b.group_seed, b.member) = (a.league, a.group_no, a.date, a.group_seed, y.rival) group by all)
select *, {q.pct('wins', '(wins + draws + losses)')} as win_pct, {q.pct('losses', '(wins + draws + losses)')} as loss_pct from g""")
def day_group_overlap_totals(spark, sf):
    daily = _day_counts(spark, sf)
    g = _day_groups(daily)
    t = _targets(spark, 2)
    return groups.overlap_totals(t, g, groups.group_overlap(t, g), daily)


# --- alerts ---------------------------------------------------------------------------------------

_ALERT = f"""hb as (select league, player_key from tracked where bettable), hx as (select league, player_key from tracked where not bettable),
opsp as (select * from p where not exists (select 1 from hx where hx.league = p.league and hx.player_key in (p.player_key, p.rival_key))),
ah as (select h.* from h where win_pct >= 48 and exists (select 1 from hb where hb.league = h.league and hb.player_key = lower(h.player))
  and not exists (select 1 from hx where hx.league = h.league and hx.player_key = lower(h.rival))),
l as (select *, row_number() over (partition by league, player_key, rival_key order by {q.DESC}) as rn from opsp),
w as (select league, player, rival, count(*) as recent_available, {q.counts()}, {q.seq()} as recent_sequence from l where rn <= 20 group by 1, 2, 3),
wp as (select *, {q.pcts('recent_available')} from w),
nm as (select league, group_no, array_to_string(list(lower(player) order by slot), '-') as group_id, array_to_string(list(player order by slot), ' / ') as label from tg group by all),
j as (select ah.*, group_id, label, coalesce(recent_available, 0) as recent_available, coalesce(recent_sequence, '') as recent_sequence, coalesce(wp.wins, 0) as recent_wins,
  coalesce(wp.draws, 0) as recent_draws, coalesce(wp.losses, 0) as recent_losses, coalesce(wp.win_pct, 0) as recent_win_pct, coalesce(wp.draw_pct, 0) as recent_draw_pct,
  coalesce(wp.loss_pct, 0) as recent_loss_pct, case when coalesce(recent_available, 0) > 0 then round(wp.win_pct - ah.win_pct, 2) else 0 end as recent_win_pct_delta
  from ah left join wp on (wp.league, wp.player, wp.rival) = (ah.league, ah.player, ah.rival) join nm on (nm.league, nm.group_no) = (ah.league, ah.group_no)),
al as (select league, group_id, label as "group", player, rival, {_CELL}, case when win_pct >= 50 then 'STRONG' else 'WATCH' end as signal,
  case when matches >= 20 then 'HIGH' else 'LOW SAMPLE' end as confidence, matches < 20 as low_sample, 20 as recent_window, recent_available, recent_sequence, recent_wins,
  recent_draws, recent_losses, recent_win_pct, recent_draw_pct, recent_loss_pct, recent_win_pct_delta, {q.trend('recent_win_pct_delta', 'recent_available')} as recent_trend,
  case when recent_available = 0 then 'EMPTY' when recent_available < 20 then 'LOW_SAMPLE' else 'COMPLETE' end as recent_sample_status,
  recent_available >= 20 as recent_window_complete from j)"""


def _alerts(spark, sf, text: bool = False):
    t = fx.tracked(spark)
    g = _targets(spark)
    return alerts.h2h_alerts(_h2h(spark, sf, text), groups.group_names(g), fx.perspectives(spark, sf),
                             bettable=filters.bettable_keys(t), excluded=filters.excluded_keys(t))


@register(f"{_WITH}, {_ALERT} select al.*, h.seq from al join h using (league, player, rival)")
def h2h_alerts(spark, sf):
    return _alerts(spark, sf, text=True).drop("player_key", "rival_key")


@register(f"""{_WITH}, {_ALERT}, {q.EVENTS}, pan as (select player, {q.counts()} from ev where cast({q.madrid('ts')} as date) = date '2024-01-15' group by 1),
st as (select lower(player) as k, case when wins >= draws + losses then '🟢' when losses >= wins + draws then '🔴' else '' end as status from pan)
select al.league, al.player, al.rival, st.status, trim(case when coalesce(status, '') <> '' then status || ' ' else '' end || al.player) as player_with_status
from al left join st on st.k = lower(al.player) and al.league = 'GT'""")
def h2h_alerts_with_status(spark, sf):
    ev = filters.on_local_day(fx.event_perspectives(spark, sf), "2024-01-15")
    panel = d.daily_players(ev).filter("date = date'2024-01-15'").withColumn("tracked", F.lit(True))
    panel = panel.withColumn("balance", F.when(F.col("wins") >= F.col("draws") + F.col("losses"), F.lit("🟢"))
                             .when(F.col("losses") >= F.col("wins") + F.col("draws"), F.lit("🔴")).otherwise(F.lit("")))
    return snapshot.with_status(_alerts(spark, sf), panel).select("league", "player", "rival", "status", "player_with_status")


# --- payload tables, written and read back ------------------------------------------------------

def _written(spark, sf, name: str):
    """One table of the payload after a round through its files."""
    t, h = _targets(spark), _h2h(spark, sf)
    daily = (_day_counts if name in ("groups", "overlap_totals") else _daily)(spark, sf)
    ranking = groups.h2h_ranking(t, h)
    picks = groups.back_and_lay(ranking)
    g = _day_groups(daily)
    overlap = groups.group_overlap(t, g)
    meta = daily.groupBy("league").agg(F.count_distinct("date").alias("files_count"), F.min("date").cast("string").alias("data_from"),
                                       F.max("date").cast("string").alias("data_to"))
    table = sinks.payload_tables(
        groups.group_names(t), h, groups.power_ranking(t, h), groups.dominance(t, h), ranking, picks, groups.matchups(picks, h),
        groups.overlap_counts(t, overlap), groups.overlap_totals(t, g, overlap, daily), _alerts(spark, sf), meta)[name]
    path = f"{spark.sparkContext.getCheckpointDir()}/payload-{uuid.uuid4().hex}"
    sinks.write_payload({name: table}, path)
    return sinks.read_payload(spark, path, name, table.schema)


@register(f"""with recursive {q.PERSPECTIVES}, {q.TRACKED}, {_tg(5)}, {_DLY}, {_DAYGROUPS}, {_OV},
c as (select league, group_no, count(*) filter (where kind = 'exact') as e, count(*) filter (where kind = 'near') as n from ovk group by 1, 2)
select league, group_no, array_to_string(list(lower(player) order by slot), '-') as group_id, array_to_string(list(player order by slot), ' / ') as label,
  coalesce(any_value(e), 0) as exact_matches, coalesce(any_value(n), 0) as near_matches from tg left join c using (league, group_no) group by 1, 2""")
def group_analysis_payload(spark, sf):
    """The groups of the payload."""
    return _written(spark, sf, "groups").select("league", "group_no", "group_id", "label", "exact_matches", "near_matches")


@register(f"{_WITH} select league, group_no, player, rival, {_CELL} from h")
def group_payload_cells(spark, sf):
    """The matrix cells of the payload."""
    return _written(spark, sf, "cells")


@register(f"""{_WITH}, {_ALERT} select league, row_number() over (partition by league order by confidence <> 'HIGH', win_pct desc, matches desc, player, rival) as position,
  group_id, player, rival, win_pct, matches, last10, signal, confidence, recent_sequence, recent_trend from al""")
def group_payload_alerts(spark, sf):
    """The alerts of the payload in presentation order (SRT5)."""
    return _written(spark, sf, "alerts").select("league", "position", "group_id", "player", "rival", "win_pct", "matches", "last10", "signal", "confidence",
                                                "recent_sequence", "recent_trend")


@register(f"""with {q.PERSPECTIVES}, {_DLY} select league, count(distinct date) as files_count, strftime(min(date), '%Y-%m-%d') as data_from,
  strftime(max(date), '%Y-%m-%d') as data_to, {sinks.PAYLOAD_VERSION} as schema_version, '{sinks.ANALYSIS_SCOPE}' as analysis_scope,
  48 as h2h_alert_threshold, 20 as min_h2h_alert_matches from dly group by league""")
def group_payload_metadata(spark, sf):
    return _written(spark, sf, "metadata")
