from datetime import datetime

import pytest
from pyspark.sql import functions as F

from duelbook.functions import names, params, results, times


def one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [
    ("2026-07-14T10:00:15+02:00", datetime(2026, 7, 14, 8, 0, 15)),
    ("2026-07-14T08:00Z", datetime(2026, 7, 14, 8, 0)),
    ("2026-07-14 08:00", datetime(2026, 7, 14, 8, 0)),
    ("2026-07-14", datetime(2026, 7, 14)),
    ("2026-07-14T08:00:00.25Z", datetime(2026, 7, 14, 8, 0, 0, 250000)),
    ("yesterday", None), ("", None), (None, None),
])
def test_parse_utc(spark, text, expected):
    assert one(spark, times.parse_utc, text) == expected


def test_parse_does_not_depend_on_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, times.parse_utc, "2026-07-14T10:00:00+02:00") == datetime(2026, 7, 14, 8)
        assert one(spark, times.iso_z, datetime(2026, 7, 14, 8), "timestamp_ntz") == "2026-07-14T08:00:00Z"
        # 02:30 does not exist in New York on this day.
        gap = datetime(2026, 3, 8, 2, 30, 0, 5)
        assert one(spark, times.iso_local, gap, "timestamp_ntz") == "2026-03-08T03:30:00.000005+01:00"
        assert one(spark, lambda c: times.from_micros(times.micros(c)), gap, "timestamp_ntz") == gap
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("text,stamp,utc,precision,zone,inferred", [
    ("2026-07-14T10:00:00+02:00", "2026-07-14T10:00:00+02:00", "2026-07-14T08:00:00Z", "second", "UTC+02:00", False),
    ("2026-07-14T08:00Z", "2026-07-14T08:00+00:00", "2026-07-14T08:00Z", "minute", "UTC", False),
    ("2026-01-14T10:00", "2026-01-14T10:00+01:00", "2026-01-14T09:00Z", "minute", "Europe/Madrid", True),
    ("2026-07-14 10:00:30", "2026-07-14T10:00:30+02:00", "2026-07-14T08:00:30Z", "second", "Europe/Madrid", True),
])
def test_parse_kickoff(spark, text, stamp, utc, precision, zone, inferred):
    k = one(spark, times.parse_kickoff, text)
    assert (k.timestamp, k.timestamp_utc, k.precision, k.zone, k.inferred) == (stamp, utc, precision, zone, inferred)


def test_local_days_across_clock_changes(spark):
    # 2026-03-29 has 23 local hours, 2026-10-25 has 25.
    df = spark.createDataFrame([(datetime(2026, 3, 28, 23, 30),), (datetime(2026, 3, 29, 21, 59),), (datetime(2026, 3, 29, 22, 0),),
                                (datetime(2026, 10, 24, 22, 0),), (datetime(2026, 10, 25, 22, 59),)], "t timestamp_ntz")
    got = [str(r[0]) for r in df.select(times.local_date(F.col("t"))).collect()]
    assert got == ["2026-03-29", "2026-03-29", "2026-03-30", "2026-10-25", "2026-10-25"]
    start, end = times.local_day_range(F.to_date(F.lit("2026-03-29")))
    assert tuple(df.limit(1).select(start, end).first()) == ("2026-03-28T23:00:00.000Z", "2026-03-29T22:00:00.000Z")


def test_instants_before_1970(spark):
    assert one(spark, times.iso_z, datetime(1965, 1, 1, 0, 0, 0, 500000), "timestamp_ntz") == "1965-01-01T00:00:00.500000Z"


def test_names_fold_unicode(spark):
    df = spark.createDataFrame([("  Álex ",), ("straße",), ("STRASSE",), ("ＡＢ",), ("  ",), (None,)], "x string")
    got = [tuple(r) for r in df.select(names.clean_name("x"), names.name_key("x")).collect()]
    assert got == [("Álex", "álex"), ("straße", "strasse"), ("STRASSE", "strasse"), ("AB", "ab"), (None, None), (None, None)]


@pytest.mark.parametrize("label,player", [
    ("England (Dexter)", "Dexter"), ("Dexter (England Esports)", None), ("Dexter", None), ("A ()", None), ("A (B) x", "B x")])
def test_player_in_parentheses(spark, label, player):
    assert one(spark, names.player_in_parentheses, label) == player


def test_percentages_round_half_even(spark):
    df = spark.createDataFrame([(n, d) for d in range(0, 130) for n in range(0, d + 1)], "n long, d long")
    for r in df.select("n", "d", results.pct2(F.col("n"), F.col("d")).alias("p")).collect():
        assert r.p == (round(r.n / r.d * 100, 2) if r.d else 0.0), (r.n, r.d)


def test_sequence_helpers(spark):
    df = spark.createDataFrame([("VVEDDVV",), ("",), ("EEE",), ("VDVD",)], "s string")
    c = F.col("s")
    got = df.select(results.win_run(c), results.unbeaten_run(c), results.winless_run(c), results.drawless_run(c), results.same_run(c),
                    results.best_run(c, "V"), results.tail(c, 3), results.count_in(c, "D")).collect()
    assert [tuple(r) for r in got] == [(2, 2, 0, 4, 2, 2, "DVV", 2), (0, 0, 0, 0, 0, 0, "", 0),
                                       (0, 3, 3, 0, 3, 0, "EEE", 0), (0, 0, 1, 4, 1, 1, "DVD", 2)]


def test_trend_edges(spark):
    df = spark.createDataFrame([(5.0, 3), (-5.0, 3), (0.0, 3), (4.9, 3), (9.0, 0)], "d double, n int")
    assert [r[0] for r in df.select(results.trend(F.col("d"), F.col("n"), 5.0)).collect()] == ["UP", "DOWN", "STABLE", "STABLE", None]
    assert [r[0] for r in df.select(results.trend(F.col("d"), F.col("n"), 0.0)).collect()][2] == "STABLE"


@pytest.mark.parametrize("call", [
    lambda: params.positive_int(True, "w"), lambda: params.positive_int(0, "w"), lambda: params.positive_int(2.0, "w"),
    lambda: params.non_negative_int(-1, "l"), lambda: params.non_negative_number(-0.1, "t"), lambda: params.non_negative_number(True, "t"),
    lambda: params.number_between(49, 50, 100, "p"), lambda: params.non_blank("  ", "n"), lambda: params.window_sizes([5, 0])])
def test_bad_parameters(call):
    with pytest.raises(ValueError):
        call()


def test_window_sizes_are_distinct_and_sorted():
    assert params.window_sizes([20, 5, 5, 10]) == [5, 10, 20]


@pytest.mark.parametrize("text,shown,utc", [
    ("1999-10-31 02:47", "1999-10-31T02:47+01:00", "1999-10-31T01:47Z"),  # comes twice: the second one
    ("1995-03-26 02:11", "1995-03-26T03:11+02:00", "1995-03-26T01:11Z"),  # left out
    ("1999-10-31 01:47", "1999-10-31T01:47+02:00", "1999-10-30T23:47Z"),
    ("1999-10-31 03:00", "1999-10-31T03:00+01:00", "1999-10-31T02:00Z"),
    ("1999-10-30 02:47:05", "1999-10-30T02:47:05+02:00", "1999-10-30T00:47:05Z")])
def test_kickoffs_on_days_of_clock_changes(spark, text, shown, utc):
    k = one(spark, times.parse_kickoff, text)
    assert (k.timestamp, k.timestamp_utc, k.inferred) == (shown, utc, True)
