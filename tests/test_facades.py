"""Load-and-compute facades, the candidate mode, and the order of landed fixtures."""

import json
from datetime import timedelta

from conftest import START, by, row

from duelbook.functions.times import iso_z
from duelbook.operators import alerts, groups
from duelbook.operators.merge import conform
from duelbook.sources import facades, fixtures_json
from duelbook.sources.history import write_history
from pyspark.sql import functions as F


def stored(spark, scratch, name, players, n=40):
    rows = [row(i, players[i % len(players)], "Z", "V", 5 * i) for i in range(n)]
    df = spark.createDataFrame(rows, "league string, match_id string, perspective_id string, player string, player_key string, rival string, rival_key string, result string, ts timestamp_ntz")
    df = df.withColumns({"timestamp_utc": iso_z(F.col("ts")), "timestamp": iso_z(F.col("ts")), "timestamp_precision": F.lit("minute")})
    path = f"{scratch}/{name}"
    write_history(conform(df), path)
    return path


def test_facades_and_mode(spark, scratch):
    players = [f"P{i}" for i in range(10)]
    path = stored(spark, scratch, "facade-history", players)
    at = START + timedelta(hours=4)
    listed = "".join(f"GT|{p}\n" for p in players)
    lists = {"auto": listed, "manual": listed + "@COINCIDENT_SELECT||" + ",".join(f"GT|{p}" for p in players) + "\n@COINCIDENT_EXCLUDE||GT|P3\n"}
    for mode, text in lists.items():
        with open(f"{scratch}/{mode}.txt", "w") as f:
            f.write(text)
        headers, matches, meta = facades.load_coincident_pairs(spark, path, f"{scratch}/{mode}.txt", reference_time=at)
        one = meta.first()
        if mode == "manual":  # nine stay, and a manual list has no limit
            assert (one.selection_mode, one.selected_candidates, headers.count()) == ("manual", 9, 36)
            assert "p3" not in {r.key_a for r in headers.collect()} | {r.key_b for r in headers.collect()}
        else:
            assert one.selection_mode == "automatic" and one.selected_candidates <= 8
        assert matches.count() >= 0
    streaks = by(facades.load_current_streaks(spark, path, f"{scratch}/auto.txt", reference_time=at), "player_key")
    assert set(streaks) == {p.lower() for p in players} and all(r.session_number == 1 for r in streaks.values())


def test_the_first_copy_of_a_landed_fixture_wins(spark, scratch):
    def line(score):
        people = [{"side": s, "participant": {"player": {"nickname": s}}} for s in ("home", "away")]
        return json.dumps({"id": 7, "kickoff": "2026-07-14T10:00:00+02:00", "participants": people, "result": {"stats": {"home_score": score, "away_score": 1}}})

    for name, scores in (("up", [0, 5, 3]), ("down", [5, 3, 0])):
        with open(f"{scratch}/{name}.json", "w") as f:
            f.write("\n".join(map(line, scores)) + "\n")
        p = fixtures_json.perspectives_from_fixtures(fixtures_json.read_fixtures(spark, f"{scratch}/{name}.json"))
        assert {r.home_score for r in p.collect()} == {scores[0]}


def test_alerts_meet_by_folded_keys(spark, history):
    rows = [(f"gt:{i}", "Straße", "strasse", "Rival", "rival", "V") for i in range(30)]
    h = history([("GT", m, f"{m}:{k}", p, k, r, rk, res, START + timedelta(minutes=5 * i)) for i, (m, p, k, r, rk, res) in enumerate(rows)])
    targets = spark.createDataFrame([("GT", 0, 2, "Straße", 1), ("GT", 0, 2, "Rival", 2)], "league string, group_no int, group_size int, player string, slot int")
    from duelbook.operators import daily

    h2h = groups.group_h2h(targets, daily.daily_rivals(groups.among_targets(targets, h), F.col("ts").cast("date")))
    bettable = spark.createDataFrame([("GT", "strasse")], "league string, player_key string")
    got = alerts.h2h_alerts(h2h, groups.group_names(targets), h, bettable=bettable).collect()
    assert len(got) == 1 and got[0].recent_available == 20
    barred = spark.createDataFrame([("GT", "rival")], "league string, player_key string")
    assert alerts.h2h_alerts(h2h, groups.group_names(targets), h, excluded=barred).count() == 0


def test_leagues_stay_apart_in_streak_tables(spark):
    from duelbook.operators import streak_tables

    day = [(league, "20260714", "P", 30, 1, 0, 31 + 5, "V" * n + "E" + "V" * 5) for league, n in (("GT", 30), ("EADRIATIC", 40))]
    df = spark.createDataFrame(day, "league string, date string, player string, wins int, draws int, losses int, played int, seq string")
    assert {(r.league, r.max_streak) for r in streak_tables.player_risk(df).collect()} == {("GT", 30), ("EADRIATIC", 40)}
    summary = by(streak_tables.daily_streak_summary(df), "league")
    assert (summary["GT"].streak_30, summary["GT"].streak_longer, summary["EADRIATIC"].streak_longer) == (1, 0, 1)
