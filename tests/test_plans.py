"""What queries shuffle, sort and read again, seen in their plans; and the values behind them."""

from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from duelbook.functions.times import local_offset
from duelbook.operators import merge
from duelbook.plans import fixture_map as fx
from duelbook.plans import group_queries
from duelbook.sources import fixtures_html

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_kept_by_number(spark):
    kept = plan(fx.matches(spark, SF))
    aggregate = next(line for line in kept.splitlines() if "Aggregate" in line)
    assert "match_no" in aggregate and "match_id" not in aggregate and "min_by" not in aggregate


def test_first_per_key_without_order_of_other_columns(spark):
    df = spark.sql("select * from values (1, 2, map('a', 1)), (1, 1, map('b', 2)), (2, 5, null) as t(k, at, m)")
    got = {r["k"]: (r["at"], r["m"]) for r in merge.first_per_key(df, ["k"], ["at", "k"]).collect()}
    assert got == {1: (1, {"b": 2}), 2: (5, None)}


def test_repair_counts_shuffle_only_what_decides(spark):
    stored = fx.perspectives(spark, SF).withColumns({"round": F.lit("R1"), "note": F.concat("player", F.lit("unused"))})
    new = stored.filter("home_score > 0").withColumn("round", F.lit("R2"))
    counts = merge.repair_counts(merge.reconcile_repair(stored, new))
    assert "unused" not in plan(counts)
    assert {r["action"] for r in counts.collect()} == {"stored", "updated"}


def test_daily_counts_are_read_once(spark):
    groups = entry.queries()["day_group_overlap_totals"](spark, SF)
    assert "l_suppkey" not in plan(groups)
    assert "l_suppkey" not in plan(group_queries._overlap(spark, SF))


def test_offset_of_zones_with_seconds(spark):
    df = spark.createDataFrame([(datetime(1890, 1, 1),), (datetime(2024, 7, 1),), (datetime(2024, 1, 1, 23, 59, 59, 1),)], "ts timestamp_ntz")
    shown = df.select(local_offset(F.col("ts")), local_offset(F.col("ts"), "Asia/Kolkata"), local_offset(F.col("ts"), "America/St_Johns"))
    assert "lambda" not in plan(shown)
    rows = shown.collect()
    assert [r[0] for r in rows] == ["-00:15", "+02:00", "+01:00"]
    assert rows[1][1] == "+05:30" and rows[1][2] == "-02:30"


def test_clock_of_a_part_is_read_once(spark):
    """The clock's expression stands beside the rows of its part, not inside the loop over them."""
    row = '<tr data-match-href="/match/{}.html"><td>A (P1)</td><td>1 - 0</td><td>B (P2)</td></tr>'
    html = ('<span class="fg-heading">FC26 R1(INT)05.01.2024</span>' + row.format(1) + '<span class="time-heading">10:15</span>' + row.format(2)
            + row.format(3) + '<span class="time-heading">11:15</span>' + row.format(4))
    pages = spark.createDataFrame([("a", html)], "page_id string, html string")
    parsed = fixtures_html.parsed_pages(pages)
    assert [r["clock"] for r in parsed.select(F.explode("_b")).select(F.explode("col.rows").alias("r")).select("r.clock").collect()] == [
        None, "10:15", "10:15", "11:15"]
    text = fixtures_html._blocks(F.col("html"))._jc.toString()
    assert text.count("</span>)") == 2  # a heading's and a part's
