"""SQL fragments shared by the reference SQL of the registered queries (DuckDB)."""

from __future__ import annotations

ORDER = "ts, match_id, perspective_id"
DESC = "ts desc, match_id desc, perspective_id desc"

RAW = """raw as (
  select case when l_returnflag = 'R' then 'EADRIATIC' else 'GT' end as league,
    l_orderkey * 10 + l_linenumber as match_no, l_suppkey % 40 as home_no, l_partkey % 40 as away_no,
    cast(floor(l_quantity) as int) % 4 as home_score, cast(floor(l_extendedprice) as int) % 4 as away_score,
    l_shipdate as ts, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax
  from lineitem where l_suppkey % 40 <> l_partkey % 40),
rawm as (select *, lower(league) || ':' || match_no as match_id, 'P' || home_no as home, 'P' || away_no as away,
  row_number() over (partition by lower(league) || ':' || match_no
    order by ts, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as copy from raw)"""

_HOME = "case when home_score > away_score then 'V' when home_score < away_score then 'D' else 'E' end"
_AWAY = "case when home_score > away_score then 'D' when home_score < away_score then 'V' else 'E' end"


def sides(source: str, extra: str = "") -> str:
    """Both perspectives of every match of ``source``."""
    return f"""select league, match_id, match_id || ':' || lower(home) as perspective_id, home as player,
    lower(home) as player_key, away as rival, lower(away) as rival_key, {_HOME} as result, ts, 'home' as home_away,
    home_score, away_score{extra} from {source}
  union all
  select league, match_id, match_id || ':' || lower(away), away, lower(away), home, lower(home), {_AWAY}, ts, 'away',
    home_score, away_score{extra} from {source}"""


MATCHES = RAW + ",\nmatches as (select * from rawm where copy = 1)"
PERSPECTIVES = MATCHES + f",\np as ({sides('matches', ', match_no')})"

EVENTS = """ev as (select 'GT' as league, 'gt:' || event_id as match_id,
    'gt:' || event_id || ':p' || (user_id % 12) as perspective_id,
    'P' || (user_id % 12) as player, 'p' || (user_id % 12) as player_key,
    'P' || ((user_id // 12) % 12) as rival, 'p' || ((user_id // 12) % 12) as rival_key,
    case when event_type in ('purchase', 'click') then 'V' when event_type = 'view' then 'E' else 'D' end as result, ts
  from events)"""

TRACKED = """tracked as (select l.league, l.base + n as pos, 'P' || n as player, 'p' || n as player_key,
    n % 7 <> 3 as bettable, cast(n // 5 as int) as group_index
  from range(40) r(n), (values ('GT', 0), ('EADRIATIC', 40)) l(league, base))"""

# Operational event rows: no player and no rival barred from betting.
OPERATIONAL = """ops as (select * from ev
  where not exists (select 1 from tracked t where not t.bettable and t.league = ev.league and t.player_key = ev.player_key)
    and not exists (select 1 from tracked t where not t.bettable and t.league = ev.league and t.player_key = ev.rival_key))"""


def pct2(n: str, d: str) -> str:
    """n/d*100 to two decimals, half-even in integers; 0 when d = 0."""
    top, two = f"(20000 * cast({n} as bigint) + cast({d} as bigint))", f"(2 * cast({d} as bigint))"
    return (f"case when {d} = 0 then 0::double else cast(({top} // {two}) - case when {top} % {two} = 0 "
            f"and ({top} // {two}) % 2 = 1 then 1 else 0 end as double) / 100 end")


def pct(n: str, d: str) -> str:
    return f"case when {d} = 0 then 0::double else cast({n} as double) / cast({d} as double) * 100 end"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def counts(result: str = "result", where: str = "") -> str:
    f = f" and {where}" if where else ""
    return (f"count(*) filter (where {result} = 'V'{f}) as wins, count(*) filter (where {result} = 'E'{f}) as draws, "
            f"count(*) filter (where {result} = 'D'{f}) as losses")


def pcts(total: str, prefix: str = "") -> str:
    return ", ".join(f"{pct2(prefix + c, total)} as {n}_pct" for n, c in (("win", "wins"), ("draw", "draws"), ("loss", "losses")))


def seq(order: str = ORDER) -> str:
    return f"string_agg(result, '' order by {order})"


def runs(source: str, keys: str, value: str = "result", name: str = "runs", order: str = ORDER) -> str:
    """CTEs with every maximal run: keys, v, len, last_rn, n (rows of the key)."""
    return f"""{name}_r as (select *, {value} as v, row_number() over (partition by {keys} order by {order}) as rn,
    row_number() over (partition by {keys}, {value} order by {order}) as rr, count(*) over (partition by {keys}) as n from {source}),
{name} as (select {keys}, v, count(*) as len, max(rn) as last_rn, max(n) as n from {name}_r group by {keys}, v, rn - rr)"""


def zulu(ts: str) -> str:
    """ISO text with Z; microseconds only when present."""
    return (f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({ts}) % 1000000 = 0 then '' "
            f"else strftime({ts}, '.%f') end || 'Z'")


def madrid(ts: str) -> str:
    return f"timezone('Europe/Madrid', timezone('UTC', {ts}))"


def madrid_iso(ts: str) -> str:
    hours = f"date_diff('hour', {ts}, {madrid(ts)})"
    return (f"strftime({madrid(ts)}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({ts}) % 1000000 = 0 then '' "
            f"else strftime({ts}, '.%f') end || '+0' || {hours} || ':00'")


def trailing(sequence: str, pattern: str) -> str:
    return f"length(regexp_extract({sequence}, '{pattern}'))"


def trend(delta: str, available: str, threshold: str = "5") -> str:
    return (f"case when {available} = 0 then null when {delta} > 0 and {delta} >= {threshold} then 'UP' "
            f"when {delta} < 0 and {delta} <= -{threshold} then 'DOWN' else 'STABLE' end")


INDICATOR = "case when wins >= draws + losses then 'GREEN' when losses >= wins + draws then 'RED' else 'NONE' end"
