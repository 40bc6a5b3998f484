"""Registered queries against their reference SQL (a spread of them; set ALL_QUERIES=1 for every one)."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPREAD = (
    "player_history_totals", "player_recent_forms", "h2h_recent_against_history", "merged_history", "repaired_history", "player_sessions",
    "coincident_matches_full_history", "upcoming_predictions", "player_streak_risk", "betting_opportunities", "closed_day_groups", "h2h_alerts",
    "report_rival_rows", "perspectives_from_html_pages", "stream_running_streaks",
)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return int(v) if isinstance(v, float) and v.is_integer() else v


def test_every_query_is_described():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()) if os.environ.get("ALL_QUERIES") else SPREAD)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(map(str, rows)) == sorted(map(str, want))
