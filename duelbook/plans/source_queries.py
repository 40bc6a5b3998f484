"""Registered queries that write source documents from the tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelbook.functions.times import local_day_range
from duelbook.operators import daily as d
from duelbook.plans import fixture_map as fx
from duelbook.plans import oracle as q
from duelbook.plans.registry import registry
from duelbook.sources import fixtures_html, fixtures_json, reports

QUERIES, ORACLE, register = registry()


# --- daily text reports -----------------------------------------------------------

def _reports(spark, sf):
    ev = fx.event_perspectives(spark, sf)
    return reports.render_reports(d.daily_players(ev, text=True), d.daily_rivals(ev, text=True))


_DLY = f"""dly as (select strftime(cast({q.madrid('ts')} as date), '%Y%m%d') as date, player, count(*) as played, {q.counts()}, {q.seq()} as seq from ev group by 1, 2)"""
_RIV = f"""riv as (select strftime(cast({q.madrid('ts')} as date), '%Y%m%d') as date, player, rival, {q.counts()}, {q.seq()} as seq from ev group by 1, 2, 3)"""


@register(f"""with {q.EVENTS}, {_DLY} select date, row_number() over (partition by date order by played desc, player) - 1 as row_no,
  player, wins, draws, losses, played, seq from dly""")
def report_summary_rows(spark, sf):
    """Summary table of every report, read back from its text."""
    return reports.daily_table(_reports(spark, sf).select("file_name", "text")).drop("file_name")


@register(f"with {q.EVENTS}, {_RIV} select * from riv")
def report_rival_rows(spark, sf):
    """Rivals section of every report, read back from its text."""
    return reports.daily_rival_table(_reports(spark, sf).select("file_name", "text")).drop("file_name")


@register(f"""with {q.EVENTS}, {_DLY} select date, player, row_number() over (partition by date order by played desc, player) - 1 as row_no from dly""")
def report_listed_players(spark, sf):
    return reports.listed_players(_reports(spark, sf).select("file_name", "text")).drop("file_name")


@register(f"with {q.EVENTS}, {_DLY} select count(distinct date) as files_count, min(date) as data_from, max(date) as data_to from dly")
def reports_metadata(spark, sf):
    return reports.reports_metadata(_reports(spark, sf))


@register(f"with {q.EVENTS}, {_DLY} select max(date) || '_player_stats.txt' as file_name from dly")
def latest_report(spark, sf):
    return reports.latest_report(_reports(spark, sf)).select("file_name")


# --- JSON fixtures ---------------------------------------------------------------------

def fixture_lines(spark, sf):
    """Raw fixture objects of the GT matches: three kickoff styles, some damaged, copies kept."""
    raw = fx.raw_matches(spark, sf).filter("league = 'GT'")
    n = F.col("match_no")
    minute = F.format_string("%02d:%02d", F.floor(n / 60) % 24, n % 60)
    day = F.col("ts").cast("date").cast("string")
    kickoff = F.when(n % 3 == 0, F.concat(day, F.lit("T"), minute, F.lit(":30Z"))).when(
        n % 3 == 1, F.concat(day, F.lit("T"), minute, F.lit("+02:00"))).otherwise(F.concat(day, F.lit(" "), minute))

    def person(side, no):
        name = F.concat(F.lit(" P"), no.cast("string"), F.lit(" "))
        return F.struct(F.lit(side).alias("side"), F.struct(F.struct(name.alias("nickname")).alias("player")).alias("participant"))

    away = person("away", F.col("away_no"))
    people = F.when(n % 41 == 0, F.array(away)).otherwise(F.array(away, person("home", F.col("home_no"))))
    score = F.when(n % 43 == 0, F.lit("-1")).when(n % 47 == 0, F.lit("true")).otherwise(F.col("home_score").cast("string"))
    body = F.to_json(F.struct(
        n.alias("id"), kickoff.alias("kickoff"), people.alias("participants"),
        F.struct(F.struct(F.lit(7777).alias("home_score"), F.col("away_score")).alias("stats")).alias("result")))
    text = F.replace(body, F.lit('"home_score":7777'), F.concat(F.lit('"home_score":'), score))
    return raw.select(text.alias("json"), F.lit("table").alias("source_file"), *fx.FIRST_WINS)


_FIX = q.RAW + f""", ok as (select *, row_number() over (partition by match_no order by ts, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as c
  from rawm where league = 'GT' and match_no % 41 <> 0 and match_no % 43 <> 0 and match_no % 47 <> 0),
k as (select * replace (cast(cast(ts as date) as timestamp) + to_minutes(match_no // 60 % 24 * 60 + match_no % 60) as ts) from ok where c = 1),
u as (select *, case match_no % 3 when 0 then ts + interval 30 seconds when 1 then ts - interval 2 hours
   else timezone('UTC', timezone('Europe/Madrid', ts)) end as utc from k)"""


@register(f"""with {_FIX}, f as ({q.sides('u', ', match_no, utc')})
select perspective_id, player, player_key, rival, result, home_away, home_score, away_score,
  case match_no % 3 when 0 then 'second' else 'minute' end as timestamp_precision,
  case match_no % 3 when 0 then 'UTC' when 1 then 'UTC+02:00' else 'Europe/Madrid' end as timezone, match_no % 3 = 2 as timezone_inferred,
  case match_no % 3 when 2 then 'inferred' else 'complete' end as data_quality,
  case match_no % 3 when 0 then strftime(utc, '%Y-%m-%dT%H:%M:%SZ') else strftime(utc, '%Y-%m-%dT%H:%MZ') end as timestamp_utc,
  case match_no % 3 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:30+00:00') when 1 then strftime(ts, '%Y-%m-%dT%H:%M+02:00')
    else strftime({q.madrid('utc')}, '%Y-%m-%dT%H:%M') || '+0' || date_diff('hour', utc, {q.madrid('utc')}) || ':00' end as timestamp
from f""")
def perspectives_from_json_fixtures(spark, sf):
    f = fixtures_json.parse_fixtures(fixture_lines(spark, sf))
    return fixtures_json.perspectives_from_fixtures(f, order=list(fx.FIRST_WINS)).select(
        "perspective_id", "player", "player_key", "rival", "result", "home_away", "home_score", "away_score", "timestamp_precision",
        "timezone", "timezone_inferred", "data_quality", "timestamp_utc", "timestamp")


@register("""select distinct strftime(d, '%Y-%m-%d') as day,
  strftime(timezone('UTC', timezone('Europe/Madrid', cast(d as timestamp))), '%Y-%m-%dT%H:%M:%S.000Z') as starts,
  strftime(timezone('UTC', timezone('Europe/Madrid', cast(d + 1 as timestamp))), '%Y-%m-%dT%H:%M:%S.000Z') as ends
from (select cast(l_shipdate as date) as d from lineitem)""")
def local_day_bounds(spark, sf):
    """UTC range of every local calendar day that occurs in the table."""
    days = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    start, end = local_day_range(F.col("d"))
    return days.select(F.col("d").cast("string").alias("day"), start.alias("starts"), end.alias("ends"))


# --- HTML pages ----------------------------------------------------------------------------

def result_pages(spark, sf):
    """One page per day of the second league: two rounds, clock headings, some unplayed or odd rows."""
    m = fx.matches(spark, sf).filter("league = 'EADRIATIC'").withColumn("date", F.col("ts").cast("date"))
    n = F.col("match_no")
    score = F.when(n % 13 == 0, F.lit("vs")).otherwise(F.concat_ws(" - ", "home_score", "away_score"))
    row = F.concat(
        F.lit('<tr class="m" data-match-href="/match/'), n.cast("string"), F.lit('.html"><td><b>Team A</b> ('), F.col("home"),
        F.lit(")</td><td> "), score, F.lit(" </td><td>"), F.when(n % 17 == 0, F.lit("P1 (Some Esport")).otherwise(F.concat(F.lit("B&amp;B ("), F.col("away"))),
        F.lit(")</td></tr>"))
    rounds = (n % 2).alias("round")
    per = m.groupBy("date", rounds).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("match_no", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    heading = F.concat(
        F.lit('<span class="fg-heading">FC26 R'), (F.col("round") + 1).cast("string"), F.lit("(INTERNATIONAL)"), F.date_format("date", "dd.MM.yyyy"),
        F.lit('</span><span class="time-heading">'), F.format_string("%02d:15", F.lit(10) + F.col("round")), F.lit("</span>\n"), F.col("rows"))
    return per.groupBy("date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("round", heading.alias("h")))), lambda x: x["h"]), "\n").alias("b")) \
        .select(F.col("date").cast("string").alias("page_id"), F.concat(F.lit("<html><body>"), F.col("b"), F.lit("</body></html>")).alias("html"))


_PAGE = q.MATCHES + """, pm as (select *, cast(ts as date) as d, match_no % 2 as rnd,
    dense_rank() over (partition by cast(ts as date) order by match_no % 2) - 1 as block,
    row_number() over (partition by cast(ts as date), match_no % 2 order by match_no) - 1 as ord
  from matches where league = 'EADRIATIC'),
pk as (select *, timezone('UTC', timezone('Europe/Madrid', cast(d as timestamp) + to_minutes((10 + rnd) * 60 + 15))) as utc from pm
  where match_no % 13 <> 0 and match_no % 17 <> 0)"""


@register(f"""with {_PAGE}, f as ({q.sides('pk', ', match_no, utc, d, rnd, block, ord')})
select strftime(d, '%Y-%m-%d') as page_id, perspective_id, player, rival, result, home_away, home_score, away_score,
  strftime(utc, '%Y-%m-%dT%H:%MZ') as timestamp_utc, strftime({q.madrid('utc')}, '%Y-%m-%dT%H:%M') || '+0' || date_diff('hour', utc, {q.madrid('utc')}) || ':00' as timestamp,
  'FC26 R' || (rnd + 1) as round, 'INTERNATIONAL' as competition, 'eadriatic:fc26-r' || (rnd + 1) || '-international:' || strftime(d, '%Y-%m-%d') as group_key,
  block as source_block_order, ord as source_row_order from f""")
def perspectives_from_html_pages(spark, sf):
    p = fixtures_html.perspectives_from_pages(result_pages(spark, sf))
    return p.select("page_id", "perspective_id", "player", "rival", "result", "home_away", "home_score", "away_score", "timestamp_utc", "timestamp",
                    "round", "competition", "group_key", "source_block_order", "source_row_order")


@register(f"with {_PAGE} select strftime(d, '%Y-%m-%d') as page_id, home, home_score, away_score, away from pk")
def match_rows_of_html_pages(spark, sf):
    return fixtures_html.match_rows(result_pages(spark, sf)).drop("pos")
