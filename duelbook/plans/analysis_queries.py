"""Registered queries over sessions, snapshots, pairing, predictions and streak tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelbook.functions.results import fmt_pct, fmt_score
from duelbook.operators import daily as d
from duelbook.operators import filters, opportunity, pairing, predictions, sessions, snapshot, streak_tables
from duelbook.plans import fixture_map as fx
from duelbook.plans import oracle as q
from duelbook.plans.registry import registry
from duelbook.sources.sinks import snapshot_payload

QUERIES, ORACLE, register = registry()
EV, T, OPS = q.EVENTS, q.TRACKED, q.OPERATIONAL
REF = "timestamp '2024-01-15 20:00:00'"
K = "league, player_key"


# --- sessions ----------------------------------------------------------------------

_SESS = f"""g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) <= 5400000000 then 0 else 1 end as fresh from ops
  window w as (partition by {K} order by {q.ORDER})),
n as (select *, sum(fresh) over (partition by {K} order by {q.ORDER} rows unbounded preceding) as session_number from g),
s as (select {K}, cast(session_number as int) as session_number, min(ts) as a, max(ts) as z, count(*) as played, {q.counts()},
  {q.seq()} as sequence, arg_max(player, (ts, match_id)) as player from n group by 1, 2, 3),
sp as (select *, {q.pcts('played')}, exists (select 1 from tracked t where t.bettable and t.league = s.league and t.player_key = s.player_key) as tracked from s)"""


@register(f"""with {EV}, {T}, {OPS}, {_SESS}
select lower(league) || ':' || player_key || ':' || strftime(a, '%Y%m%dT%H%M%SZ') as session_id, league, player, player_key, session_number,
  {q.zulu('a')} as start_timestamp, {q.zulu('z')} as end_timestamp, {q.madrid_iso('a')} as start_local, {q.madrid_iso('z')} as end_local,
  (epoch_us(z) - epoch_us(a)) // 60000000 as duration_minutes, played, wins, draws, losses, win_pct, draw_pct, loss_pct, sequence,
  right(sequence, 24) as last_24, right(sequence, 1) as current_streak_result, {q.trailing('sequence', '(V+|E+|D+)$')} as current_streak, tracked,
  case when tracked and wins >= draws + losses then '🟢' when tracked and losses >= wins + draws then '🔴' else '' end as balance,
  epoch_us({REF}) - epoch_us(z) between 0 and 10800000000 as active from sp""")
def player_sessions(spark, sf):
    t = fx.tracked(spark)
    return sessions.player_sessions(fx.event_perspectives(spark, sf), t, reference_time=fx.REFERENCE_TIME, excluded=filters.excluded_keys(t), text=True)


@register(f"""with {EV}, {T}, {OPS}, {_SESS} select {K}, cast(session_number as int) as session_number, min(ts) as start, count(*) as played, {q.seq()} as seq
from n group by {K}, session_number, date_trunc('hour', ts)""")
def player_session_sequences(spark, sf):
    """The results of every session as text, by hour."""
    rows = filters.operational_results(fx.event_perspectives(spark, sf), filters.excluded_keys(fx.tracked(spark)))
    return sessions.session_sequences(rows)


@register(f"with {EV}, {T}, {OPS}, {_SESS} select {K}, max(session_number) as session_number from s group by 1, 2")
def session_counts(spark, sf):
    rows = filters.operational_results(fx.event_perspectives(spark, sf), filters.excluded_keys(fx.tracked(spark)))
    return sessions.session_counts(rows)


# --- operational snapshot -------------------------------------------------------------

_SNAP = f"""w as (select ops.{K.replace(', ', ', ops.')}, count(*) as played, {q.counts()}, {q.seq()} as sequence from ops
  semi join (from tracked where bettable) t using (league, player_key)
  where ts between {REF} - interval 8 hours and {REF} group by 1, 2),
snap as (select w.*, t.player, t.group_index, {q.pcts('played', 'w.')}, {q.INDICATOR} as indicator from w join tracked t using (league, player_key))"""
_SNAP_COLS = f"""league, player, player_key, wins, draws, losses, played, win_pct, draw_pct, loss_pct, sequence, right(sequence, 24) as last_24,
  right(sequence, 1) as current_streak_result, {q.trailing('sequence', '(V+|E+|D+)$')} as current_streak,
  case indicator when 'GREEN' then '🟢' when 'RED' then '🔴' else '' end as balance, indicator, true as tracked, group_index"""


def _snapshot(spark, sf, hours: int = 8, text: bool = False):
    return snapshot.snapshot(fx.event_perspectives(spark, sf), fx.tracked(spark), reference_time=fx.REFERENCE_TIME, window_hours=hours, text=text)


@register(f"with {EV}, {T}, {OPS}, {_SNAP} select {_SNAP_COLS} from snap")
def operational_snapshot(spark, sf):
    return _snapshot(spark, sf, text=True)


@register(f"""with {EV}, {T}, {OPS} select {K}, epoch_us(ts) // 3600000000 as slice, count(*) as n, {q.seq()} as seq from ops
  semi join (from tracked where bettable) t using (league, player_key) where ts between {REF} - interval 8 hours and {REF} group by all""")
def operational_snapshot_sequences(spark, sf):
    """The results behind the snapshot as text, by hour."""
    return snapshot.snapshot_sequences(fx.event_perspectives(spark, sf), fx.tracked(spark), reference_time=fx.REFERENCE_TIME)


@register(f"""with {EV}, {T}, {OPS}, {_SNAP}, {_SESS} select {_SNAP_COLS}, c.session_number from snap
join (select {K}, max(session_number) as session_number from s group by 1, 2) c using (league, player_key)""")
def operational_snapshot_with_sessions(spark, sf):
    return snapshot.snapshot_with_sessions(fx.event_perspectives(spark, sf), fx.tracked(spark), reference_time=fx.REFERENCE_TIME, text=True)


@register(f"""with {EV}, {T}, {OPS}, {_SNAP}, o as (select league, row_number() over (partition by league
    order by wins desc, win_pct desc, played desc, lower(player)) as place, player, wins, fmt from
    (select *, format('{{:.2f}}%', win_pct) as fmt from snap))
select league, place, player, wins, fmt as shown from o""")
def snapshot_payload_rows(spark, sf):
    """The per-league payload, one line per array element."""
    p = snapshot_payload(_snapshot(spark, sf))
    return p.select("league", F.posexplode("rows").alias("i", "r")).select(
        "league", (F.col("i") + 1).alias("place"), "r.player", "r.wins", fmt_pct(F.col("r.win_pct")).alias("shown"))


_CAND = """cand as (select league, player_key, player, indicator, wins, draws, losses, played, win_pct, loss_pct,
    case when indicator = 'GREEN' then win_pct else loss_pct end as shown from snap
  where played >= 5 and indicator in ('GREEN', 'RED') order by shown desc, played desc, league, lower(player), player_key limit 8)"""
_CAND_COLS = "league, player_key, player, indicator, wins, draws, losses, played, win_pct, loss_pct"


@register(f"with {EV}, {T}, {OPS}, {_SNAP}, {_CAND} select {_CAND_COLS} from cand")
def automatic_candidates(spark, sf):
    return snapshot.candidates(_snapshot(spark, sf))


@register(f"""with {EV}, {T}, {OPS}, {_SNAP} select t.league, t.player_key, t.player, coalesce(indicator, 'NONE') as indicator,
  coalesce(wins, 0) as wins, coalesce(draws, 0) as draws, coalesce(losses, 0) as losses, coalesce(played, 0) as played,
  coalesce(win_pct, 0) as win_pct, coalesce(loss_pct, 0) as loss_pct
from tracked t left join snap using (league, player_key) where t.bettable and t.pos % 3 = 0 and t.player_key <> 'p0'""")
def manual_candidates(spark, sf):
    t = fx.tracked(spark)
    chosen = t.filter("pos % 3 = 0").select("league", "player_key")
    barred = t.filter("player_key = 'p0'").select("league", "player_key")
    return snapshot.manual_candidates(t, chosen, _snapshot(spark, sf), barred)


_DAILY = f"""dly as (select league, cast({q.madrid('ts')} as date) as date, player_key, player, count(*) as played, {q.counts()}, {q.seq()} as seq
  from ev group by all)"""


@register(f"""with {EV}, {T}, {OPS}, {_DAILY},
r as (select d.*, exists (select 1 from tracked t where t.bettable and t.league = d.league and t.player_key = d.player_key) as tracked from dly d
  where date = date '2024-01-15' and not exists (select 1 from tracked t where not t.bettable and t.league = d.league and t.player_key = d.player_key)),
own as (select league, player_key, any_value(player) as player, count(*) as played, {q.counts()}, {q.seq()} as seq from ops
  where cast({q.madrid('ts')} as date) = date '2024-01-15' group by 1, 2),
a as (select league, player_key, player, wins, draws, losses, played, seq, tracked from r where not tracked
  union all select league, player_key, player, wins, draws, losses, played, seq, true from own)
select league, player_key, player, wins, draws, losses, played, seq as sequence, right(seq, 24) as last_24, tracked, {q.trailing('seq', '[^V]*$')} as winless_run,
  {q.trailing('seq', '[^D]*$')} as unbeaten_run, {q.trailing('seq', '[^E]*$')} as drawless_run,
  case when tracked and wins >= draws + losses then '🟢' when tracked and losses >= wins + draws then '🔴' else '' end as balance from a""")
def current_streak_panel(spark, sf):
    ev = fx.event_perspectives(spark, sf)
    day = d.daily_players(filters.on_local_day(ev, "2024-01-15"), text=True).filter("date = date'2024-01-15'")
    return snapshot.current_streak_panel(ev, day, fx.tracked(spark), "2024-01-15", text=True)


# --- coincident pairs ---------------------------------------------------------------------

CANDIDATE_PAIRS = """pairs as (select a.league as league_a, a.player_key as key_a, a.player as player_a, a.indicator as indicator_a,
    b.league as league_b, b.player_key as key_b, b.player as player_b, b.indicator as indicator_b
  from cand a join cand b on (a.league, lower(a.player), a.player_key) < (b.league, lower(b.player), b.player_key))"""


def walk_sql(window: str) -> str:
    """Every pair's timeline walked one event at a time with two explicit stacks."""
    ev = "struct_pack(at := ts, m := match_id, p := perspective_id, res := result, riv := rival)"
    return f"""tl as (select *, row_number() over (partition by key_a, key_b order by ts, side, match_id, perspective_id) as i from (
    select p.key_a, p.key_b, 0 as side, o.ts, o.match_id, o.perspective_id, o.result, o.rival from pairs p join ops o on o.player_key = p.key_a {window}
    union all select p.key_a, p.key_b, 1, o.ts, o.match_id, o.perspective_id, o.result, o.rival from pairs p join ops o on o.player_key = p.key_b {window})),
walk as (
  select key_a, key_b, cast(0 as bigint) as i, list_filter([{ev}], lambda x: false) as s0, list_filter([{ev}], lambda x: false) as s1,
    list_filter([struct_pack(a := {ev}, b := {ev})], lambda x: false) as hit from tl where i = 1
  union all
  select w.key_a, w.key_b, t.i,
    case when t.side = 1 and t.ok then w.s0[1:-2] when t.side = 0 and not t.ok then list_append(w.s0, t.e) else w.s0 end,
    case when t.side = 0 and t.ok then w.s1[1:-2] when t.side = 1 and not t.ok then list_append(w.s1, t.e) else w.s1 end,
    case when t.ok then [struct_pack(a := case when t.side = 0 then t.e else w.s0[-1] end, b := case when t.side = 0 then w.s1[-1] else t.e end)]
      else list_filter(w.hit, lambda x: false) end
  from walk w, lateral (select tl.i, tl.side, {ev} as e,
      coalesce(epoch_us(tl.ts) - epoch_us((case when tl.side = 0 then w.s1[-1] else w.s0[-1] end).at) <= 1800000000, false) as ok
    from tl where tl.key_a = w.key_a and tl.key_b = w.key_b and tl.i = w.i + 1) t),
hits as (select key_a, key_b, hit[1].a as a, hit[1].b as b from walk where len(hit) = 1)"""


_MATCHED_SQL = f"""select p.league_a, p.key_a, p.league_b, p.key_b, indicator_a, indicator_b, p.league_a as player_a_league, p.player_a,
  h.a.m as player_a_match_id, {q.zulu('h.a.at')} as player_a_timestamp, h.a.res as player_a_result, h.a.riv as player_a_rival,
  p.league_b as player_b_league, p.player_b, h.b.m as player_b_match_id, {q.zulu('h.b.at')} as player_b_timestamp, h.b.res as player_b_result,
  h.b.riv as player_b_rival, abs(epoch_us(h.a.at) - epoch_us(h.b.at)) // 60000000 as gap_minutes,
  row_number() over (partition by p.key_a, p.key_b order by greatest(h.a.at, h.b.at), h.a.at, h.a.m, h.a.p, h.b.at, h.b.m, h.b.p) as pair_order,
  case when ((indicator_a = 'GREEN' and h.a.res = 'V') or (indicator_a = 'RED' and h.a.res = 'D'))
    and ((indicator_b = 'GREEN' and h.b.res = 'V') or (indicator_b = 'RED' and h.b.res = 'D'))
    then case when indicator_a <> indicator_b then 'MIXED' when indicator_a = 'GREEN' then 'BOTH_GREEN' else 'BOTH_RED' end end as confirmation
from hits h join pairs p using (key_a, key_b)"""
_IN_WINDOW = f"and o.ts between {REF} - interval 8 hours and {REF}"


def _candidates(spark, sf):
    return snapshot.candidates(_snapshot(spark, sf))


def _analysis(spark, sf):
    return pairing.coincident_analysis(fx.event_perspectives(spark, sf), _candidates(spark, sf), reference_time=fx.REFERENCE_TIME,
                                       excluded=filters.excluded_keys(fx.tracked(spark)))


@register(f"with recursive {EV}, {T}, {OPS}, {_SNAP}, {_CAND}, {CANDIDATE_PAIRS}, {walk_sql(_IN_WINDOW)} {_MATCHED_SQL}")
def coincident_matches_in_window(spark, sf):
    return _analysis(spark, sf)[1]


@register(f"with recursive {EV}, {T}, {OPS}, {_SNAP}, {_CAND}, {CANDIDATE_PAIRS}, {walk_sql('')} {_MATCHED_SQL}")
def coincident_matches_full_history(spark, sf):
    """The same pairs over their whole histories, stretch by stretch."""
    rows = filters.operational_results(fx.event_perspectives(spark, sf), filters.excluded_keys(fx.tracked(spark)))
    return pairing.coincident_matches(rows, pairing.candidate_pairs(_candidates(spark, sf)))


@register(f"""with recursive {EV}, {T}, {OPS}, cand as (select league, player_key, player, 'NONE' as indicator from tracked where bettable and league = 'GT'),
{CANDIDATE_PAIRS}, {walk_sql(_IN_WINDOW)} {_MATCHED_SQL}""")
def manual_coincident_matches(spark, sf):
    """All pairs of a hand-written list, which has no limit."""
    t = fx.tracked(spark)
    chosen = snapshot.manual_candidates(t, t.filter("league = 'GT'").select("league", "player_key"))
    return pairing.coincident_analysis(fx.event_perspectives(spark, sf), chosen, reference_time=fx.REFERENCE_TIME,
                                       excluded=filters.excluded_keys(t))[1]


@register(f"""with recursive {EV}, {T}, {OPS}, {_SNAP}, {_CAND}, {CANDIDATE_PAIRS}, {walk_sql(_IN_WINDOW)}
select pairs.*, coalesce(n, 0) as matches, 30 as max_gap_minutes, 8 as operational_window_hours from pairs
left join (select key_a, key_b, count(*) as n from hits group by 1, 2) using (key_a, key_b)""")
def coincident_pair_headers(spark, sf):
    return _analysis(spark, sf)[0]


@register(f"""with {EV}, {T}, {OPS}, {_SNAP}, {_CAND} select
  (select count(*) from snap where played >= 5 and indicator in ('GREEN', 'RED') and player_key <> 'p1') as eligible_players,
  least(8, (select count(*) from snap where played >= 5 and indicator in ('GREEN', 'RED') and player_key <> 'p1')) as selected_candidates,
  1 as excluded_candidates, 8 as candidate_limit, 'automatic' as selection_mode""")
def coincident_selection_metadata(spark, sf):
    s = _snapshot(spark, sf)
    barred = fx.tracked(spark).filter("player_key = 'p1' and league = 'GT'")
    return pairing.selection_metadata(snapshot.candidates(s, barred, limit=None), snapshot.candidates(s, barred), excluded=barred)


_REL = f"""m as ({_MATCHED_SQL}),
tot as (select key_a, key_b, count(*) as matches, count(confirmation) as confirmed, max(pair_order) as top from m group by 1, 2),
rec as (select m.key_a, m.key_b, count(*) as recent_matches, count(confirmation) as recent_confirmed from m join tot using (key_a, key_b)
  where pair_order > top - 5 group by 1, 2),
st as (select player_key, case indicator when 'GREEN' then win_pct when 'RED' then loss_pct else 0 end as strength from snap),
f as (select p.league_a, p.key_a, p.league_b, p.key_b, p.player_a, p.player_b, coalesce(matches, 0) as matches, coalesce(confirmed, 0) as confirmed,
  coalesce(recent_matches, 0) as recent_matches, coalesce(recent_confirmed, 0) as recent_confirmed,
  coalesce(confirmed / matches * 100, 0) as hp, coalesce(recent_confirmed / recent_matches * 100, 0) as rp,
  case when a.strength > 0 and b.strength > 0 then (a.strength + b.strength) / 2 else 0 end as ip
  from pairs p left join tot using (key_a, key_b) left join rec using (key_a, key_b)
  left join st a on a.player_key = p.key_a left join st b on b.player_key = p.key_b),
fs as (select *, hp * 0.5::double + rp * 0.3::double + ip * 0.2::double as s from f),
rel as (select league_a, key_a, league_b, key_b, player_a, player_b, round(s, 2) as score,
  case when matches >= 8 and s >= 70 then 'HIGH' when matches >= 5 and s >= 65 then 'MEDIUM' else 'LOW' end as level,
  matches, confirmed, round(hp, 2) as historical_pct, recent_matches, recent_confirmed, round(rp, 2) as recent_pct, round(ip, 2) as indicator_strength from fs)"""
_REL_WITH = f"with recursive {EV}, {T}, {OPS}, {_SNAP}, {_CAND}, {CANDIDATE_PAIRS}, {walk_sql(_IN_WINDOW)}, {_REL}"


def _reliability(spark, sf):
    s = _snapshot(spark, sf)
    headers, matched = _analysis(spark, sf)
    return pairing.pair_reliability(headers.drop("matches"), matched, s)


@register(f"{_REL_WITH} from rel")
def coincident_pair_reliability(spark, sf):
    return _reliability(spark, sf)


@register(f"""{_REL_WITH} select player_a, player_b, level, score, format('{{:.2f}}', score) as shown from rel where level in ('HIGH', 'MEDIUM')
order by score desc, matches desc, lower(player_a), lower(player_b) limit 5""")
def reliable_coincident_pairs(spark, sf):
    r = pairing.reliable_pairs(_reliability(spark, sf))
    return r.select("player_a", "player_b", "level", "score", fmt_score(F.col("score")).alias("shown"))


# --- predictions ----------------------------------------------------------------------------

def _shr(p: str, n: str, k: int) -> str:
    return f"case when {n} <= 0 then 50::double else ({p} * {n} + {50 * k}::double) / ({n} + {k}) end"


def _rec(source: str, keys: str) -> str:
    return (f"select {keys}, n, {q.pct2('w', 'n')} as win, {q.pct2('l', 'n')} as loss from (select {keys}, count(*) as n, "
            f"count(*) filter (where result = 'V') as w, count(*) filter (where result = 'D') as l from {source} group by all)")


_R = "league, player_key, rival_key"
_PRED = f"""rn as (select *, row_number() over (partition by {K} order by {q.DESC}) as pr, row_number() over (partition by {_R} order by {q.DESC}) as hr from ops_p),
pa as ({_rec('rn', K)}), pf as ({_rec('(from rn where pr <= 24)', K)}), ha as ({_rec('rn', _R)}), hf as ({_rec('(from rn where hr <= 20)', _R)}),
pairs as (select a.league, a.group_index, a.player as player_a, a.player_key as key_a, b.player as player_b, b.player_key as key_b
  from tracked a join tracked b using (league, group_index) where a.bettable and b.bettable and (lower(a.player), a.player_key) < (lower(b.player), b.player_key)),
sd as (select league, group_index, player_a, player_b, 0 as side, key_a as player_key, key_b as rival_key, player_a as predicted_player, player_b as opponent from pairs
  union all select league, group_index, player_a, player_b, 1, key_b, key_a, player_b, player_a from pairs),
j as (select sd.*, coalesce(ha.n, 0) as hn, coalesce(ha.win, 0) as hw, coalesce(hf.n, 0) as rn, coalesce(hf.win, 0) as rw,
  coalesce(f1.n, 0) as fn, coalesce(f1.win, 0) as fw, coalesce(f2.n, 0) as gn, coalesce(f2.loss, 0) as gl,
  coalesce(a1.n, 0) as an, coalesce(a1.win, 0) as aw, coalesce(a2.n, 0) as bn, coalesce(a2.loss, 0) as bl
  from sd left join ha using ({_R}) left join hf using ({_R}) left join pf f1 on (f1.league, f1.player_key) = (sd.league, sd.player_key)
  left join pf f2 on (f2.league, f2.player_key) = (sd.league, sd.rival_key) left join pa a1 on (a1.league, a1.player_key) = (sd.league, sd.player_key)
  left join pa a2 on (a2.league, a2.player_key) = (sd.league, sd.rival_key)),
e as (select league, group_index, player_a, player_b, side, predicted_player, opponent,
  round(({_shr('hw', 'hn', 12)}) * 0.4::double + ({_shr('rw', 'rn', 6)}) * 0.25::double
    + (({_shr('fw', 'fn', 8)}) + ({_shr('gl', 'gn', 8)})) / 2 * 0.25::double
    + (({_shr('aw', 'an', 40)}) + ({_shr('bl', 'bn', 40)})) / 2 * 0.1::double, 2) as estimated_win_pct,
  case when hn >= 20 and fn >= 12 and gn >= 12 then 'HIGH' when hn >= 10 and fn >= 8 and gn >= 8 then 'MEDIUM' else 'LOW' end as confidence,
  hn as h2h_matches, hw as h2h_win_pct, rn as recent_h2h_matches, rw as recent_h2h_win_pct, fn as recent_player_matches, fw as recent_player_win_pct,
  gn as recent_opponent_matches, gl as recent_opponent_loss_pct, an as overall_player_matches, aw as overall_player_win_pct,
  bn as overall_opponent_matches, bl as overall_opponent_loss_pct from j)"""
_OPS_P = q.OPERATIONAL.replace("ops as", "ops_p as").replace("from ev", "from p").replace("ev.", "p.")
PREDICTION_WITH = f"with {q.PERSPECTIVES}, {T}, {_OPS_P}, {_PRED}"


@register(f"{PREDICTION_WITH} from e")
def matchup_side_estimates(spark, sf):
    t = fx.tracked(spark)
    return predictions.side_estimates(fx.perspectives(spark, sf), predictions.group_pairs(t), filters.excluded_keys(t))


@register(f"""{PREDICTION_WITH} select * exclude (side) from (select *, row_number() over (partition by league, group_index, player_a, player_b
  order by estimated_win_pct desc, side) as r from e qualify r = 1) x where estimated_win_pct >= 50 and confidence in ('HIGH', 'MEDIUM')""".replace("exclude (side)", "exclude (side, r)"))
def upcoming_predictions(spark, sf):
    return predictions.predictions(fx.perspectives(spark, sf), fx.tracked(spark), min_estimated_win_pct=50)


# --- daily results and streak tables -------------------------------------------------------------

@register(f"""with {EV}, {_DAILY} select *, right(seq, 24) as last_24, {q.trailing('seq', '[^E]*$')} as current_streak,
  coalesce(list_max(list_transform(string_split(seq, 'E'), lambda x: length(x))), 0) as calm from dly""")
def daily_player_results(spark, sf):
    return d.daily_players(fx.event_perspectives(spark, sf), text=True).select(*d.PLAYER_DAY, "played", "wins", "draws", "losses", "seq", "last_24", "current_streak", "calm")


@register(f"""with {EV} select league, cast({q.madrid('ts')} as date) as date, player_key, player, epoch_us(ts) // 3600000000 as slice, count(*) as n, {q.seq()} as seq
from ev group by all""")
def daily_player_sequences(spark, sf):
    """The results of every day as text, by hour."""
    return d.daily_sequences(fx.event_perspectives(spark, sf))


_RIVALS = f"""riv as (select league, cast({q.madrid('ts')} as date) as date, player_key, player, rival_key, rival, count(*) as played, {q.counts()}, {q.seq()} as seq
  from ev group by all)"""


@register(f"with {EV}, {_RIVALS} select *, right(seq, 24) as last_24 from riv")
def daily_rival_results(spark, sf):
    return d.daily_rivals(fx.event_perspectives(spark, sf), text=True).select(*d.RIVAL_DAY, "played", "wins", "draws", "losses", "seq", "last_24")


def _p1(c: str) -> str:
    top, two = f"(2000 * {c} + played)", "(2 * played)"
    return f"format('{{:.1f}}%', cast(({top} // {two}) - case when {top} % {two} = 0 and ({top} // {two}) % 2 = 1 then 1 else 0 end as double) / 10)"


@register(f"""with {EV}, {_RIVALS} select league, date, player, rival || ': ' || played || ' (' || {_p1('wins')} || '/' || {_p1('draws')} || '/' || {_p1('losses')}
  || ') [' || seq || ']' as line from riv""")
def daily_rival_lines(spark, sf):
    r = d.daily_rivals(fx.event_perspectives(spark, sf), text=True)
    return r.select("league", "date", "player", d.rival_line().alias("line"))


def _daily(spark, sf):
    return d.daily_players(fx.event_perspectives(spark, sf)).withColumn("date", F.date_format("date", "yyyyMMdd"))


def _runs(spark, sf):
    return d.daily_no_draw_runs(fx.event_perspectives(spark, sf)).withColumn("date", F.date_format("date", "yyyyMMdd"))


_D18 = f"""{EV}, {_DAILY}, d18 as (select league, strftime(date, '%Y%m%d') as date, player, wins, draws, losses, played, seq,
  list_transform(list_filter(string_split(seq, 'E'), lambda x: x <> ''), lambda x: length(x)) as lens, {q.trailing('seq', '[^E]*$')} as ending from dly where played >= 18),
runs as (select league, date, player, unnest(lens) as streak, generate_subscripts(lens, 1) = len(lens) and ending > 0 as open from d18), r9 as (from runs where streak >= 9)"""
_TOP = "coalesce(list_max(lens), 0)"


def _r2(n: str, d: str) -> str:
    return q.pct2(n, f"({d} * 100)")


@register(f"with {_D18} select league, date, player, played, draws, {_TOP} as max_no_draw_streak, ending as ending_no_draw_streak from d18")
def daily_no_draw_streaks(spark, sf):
    return streak_tables.daily_streaks(_daily(spark, sf))


@register(f"""with {_D18}, g as (select league, player, count(*) as days, cast(sum(played) as bigint) as matches, cast(sum(wins) as bigint) as wins,
  cast(sum(draws) as bigint) as draws, cast(sum(losses) as bigint) as losses from d18 group by 1, 2)
select *, {q.pcts('matches')}, {_r2('matches', 'days')} as avg_matches_day, {_r2('wins', 'days')} as avg_wins_day,
  {_r2('draws', 'days')} as avg_draws_day, {_r2('losses', 'days')} as avg_losses_day from g""")
def player_day_summary(spark, sf):
    return streak_tables.player_summary(_daily(spark, sf))


@register(f"""with {_D18}, t as (select *, {_TOP} as top from d18), g as (select league, player, count(*) as days_analyzed, cast(sum(played) as bigint) as matches_analyzed,
  cast(sum(draws) as bigint) as dr, max(top) as max_streak, cast(sum(top) as bigint) as tops, {', '.join(f'count(*) filter (where top >= {x}) as streaks_{x}_plus' for x in (18, 20, 22, 25))}
  from t group by 1, 2), h as (select *, greatest(8, max_streak - 7) as recommended_entry, streaks_18_plus + 2 * streaks_20_plus + 3 * streaks_22_plus + 4 * streaks_25_plus as score from g)
select league, player, days_analyzed, matches_analyzed, {q.pct2('dr', 'matches_analyzed')} as draw_pct, max_streak, {_r2('tops', 'days_analyzed')} as avg_max_streak,
  streaks_18_plus, streaks_20_plus, streaks_22_plus, streaks_25_plus, recommended_entry, 8 as max_bets,
  case when max_streak <= recommended_entry + 7 then 'YES' else 'NO' end as safe_for_strategy, {q.pct2('streaks_18_plus', 'days_analyzed')} as danger_days_pct,
  case when score = 0 then 'VERY_HIGH' when score <= 2 then 'HIGH' when score <= 5 then 'MEDIUM' else 'LOW' end as stability from h""")
def player_streak_risk(spark, sf):
    return streak_tables.player_risk(_daily(spark, sf))


@register(f"""with {_D18} select league, streak, count(*) as total_occurrences, count(*) filter (where not open) as ended_same_day,
  count(*) filter (where open) as finished_day_with_streak from r9 group by 1, 2""")
def streak_distribution(spark, sf):
    return streak_tables.streak_distribution(_daily(spark, sf), runs=_runs(spark, sf))


@register(f"with {_D18} select league, date, streak, count(*) as occurrences from r9 group by 1, 2, 3")
def streak_distribution_by_day(spark, sf):
    return streak_tables.streak_distribution_by_day(_daily(spark, sf), runs=_runs(spark, sf))


@register(f"with {_D18} select league, date, {', '.join(f'count(*) filter (where streak = {n}) as streak_{n}' for n in range(9, 31))}, count(*) filter (where streak > 30) as streak_longer from r9 group by 1, 2")
def daily_streak_summary(spark, sf):
    return streak_tables.daily_streak_summary(_daily(spark, sf), runs=_runs(spark, sf))


@register(f"with {_D18} select league, date, player, played, draws, {_TOP} as max_no_draw_streak from d18")
def streak_records(spark, sf):
    return streak_tables.streak_records(_daily(spark, sf))


@register(f"with {_D18} select league, date, player, played, draws from d18")
def draw_records_lowest(spark, sf):
    return streak_tables.draw_records(_daily(spark, sf), lowest=True)


@register(f"with {_D18} select league, date, player, played, draws from d18")
def draw_records_highest(spark, sf):
    return streak_tables.draw_records(_daily(spark, sf), lowest=False)


# --- opportunities -----------------------------------------------------------------------------------

_RUNS = q.runs("ops_p", K, "result <> 'E'")


@register(f"""with {q.PERSPECTIVES}, {T}, {_OPS_P}, {_RUNS}
select {K}, v as drawless, len as length, last_rn = n as is_last, count(*) as n from runs group by all""")
def no_draw_run_histogram(spark, sf):
    rows = filters.operational(fx.perspectives(spark, sf), filters.excluded_keys(fx.tracked(spark)))
    return opportunity.no_draw_histogram(rows)


@register(f"""with {q.PERSPECTIVES}, {T}, {_OPS_P}, {_RUNS}, g as (select {K}, count(*) filter (where v and len >= 4) as samples,
  count(*) filter (where v and len between 4 and 11 and last_rn < n) as hits from runs group by 1, 2)
select *, {q.pct2('hits', 'samples')} as hit_pct from g""")
def entry_backtest(spark, sf):
    rows = filters.operational(fx.perspectives(spark, sf), filters.excluded_keys(fx.tracked(spark)))
    return opportunity.entry_results(rows, 4)


@register(f"""with {q.PERSPECTIVES}, {T}, {_OPS_P}, {_RUNS},
cur as (select {K}, coalesce(max(len) filter (where v and last_rn = n), 0) as c from runs group by 1, 2),
g as (select {K}, c as current_streak_real, cast(sum(len) as bigint) as matches, cast(coalesce(sum(len) filter (where not v), 0) as bigint) as draws,
  cast(coalesce(sum(len) filter (where v), 0) as bigint) as ln, count(*) filter (where v) as rs,
  count(*) filter (where v and c > 0 and len >= c) as samples, count(*) filter (where v and c > 0 and len between c and c + 7 and last_rn < n) as hits
  from runs join cur using ({K}) semi join (from tracked where bettable) t using ({K}) group by 1, 2, 3),
h as (select league, upper(player_key) as player, matches, draws, {q.pct2('draws', 'matches')} as draw_pct, current_streak_real,
  {_r2('ln', 'rs')} as avg_streak, samples, {q.pct2('hits', 'samples')} as prob_next_8 from g)
select *, array_to_string(list_filter([case when draw_pct >= 17 then 'DRAW_OK' end, case when prob_next_8 >= 85 then 'PROB_OK' end,
  case when samples >= 30 then 'SAMPLES_OK' end, case when current_streak_real >= avg_streak then 'STREAK_OK' end], lambda x: x is not null), '|') as reason,
  case when draw_pct >= 17 and prob_next_8 >= 85 and samples >= 30 and current_streak_real >= avg_streak then 'BET'
    when draw_pct >= 15 and prob_next_8 >= 80 and samples >= 20 then 'WATCH' else 'SKIP' end as recommendation from h""")
def betting_opportunities(spark, sf):
    t = fx.tracked(spark)
    return opportunity.opportunities(fx.perspectives(spark, sf), filters.bettable_keys(t), filters.excluded_keys(t))


@register(f"""with {q.PERSPECTIVES}, {T}, {_OPS_P},
m as (select {K}, date_trunc('month', ts)::date as slice, count(*) as n, {q.seq()} as sequence from ops_p group by all)
select {K}, 'all' as grain, null::date as slice, count(*) as n, {q.seq()} as sequence, 1 as sequence_part, 1 as sequence_parts from ops_p group by 1, 2
union all select {K}, 'month', slice, n, sequence, cast(row_number() over (partition by {K} order by slice nulls first) as int), cast(count(*) over (partition by {K}) as int) from m""")
def operational_sequences(spark, sf):
    """All operational results of every player as text, whole and in its parts by month."""
    return opportunity.player_text_parts(fx.perspectives(spark, sf), filters.excluded_keys(fx.tracked(spark)))


@register(f"with {q.PERSPECTIVES}, {T}, {_OPS_P} select {K}, date_trunc('month', ts)::date as slice, count(*) as n, {q.seq()} as seq from ops_p group by all")
def operational_month_sequences(spark, sf):
    """The same by month."""
    return opportunity.player_sequences(fx.perspectives(spark, sf), filters.excluded_keys(fx.tracked(spark)))
