from datetime import timedelta

import pytest
from conftest import START, by, row

from duelbook.operators import pairing, predictions, sessions, snapshot, streak_tables
from duelbook.sources.sinks import snapshot_payload, streak_reports, write_streak_reports

REF = START + timedelta(hours=8)


@pytest.fixture()
def tracked(spark):
    rows = [("GT", i, f"P{i}", f"p{i}", True, False, i != 3, i // 5) for i in range(10)]
    return spark.createDataFrame(rows, "league string, pos int, player string, player_key string, tracked boolean, selected boolean, bettable boolean, group_index int")


def series(player, rival, text, first=0, step=10):
    return [row(f"{player}-{i + first}", player, rival, r, (i + first) * step) for i, r in enumerate(text)]


def test_snapshot_indicator_prefers_green_and_excludes(history, tracked):
    rows = series("P0", "P1", "VD") + series("P1", "P2", "DDE") + series("P2", "P4", "EEV") + series("P3", "P4", "VVV") + series("P4", "P3", "DDD") + series("X", "P0", "V")
    s = by(snapshot.snapshot(history(rows), tracked, reference_time=REF), "player")
    assert set(s) == {"P0", "P1", "P2"}  # P3 is not bettable, P4 only met P3, X is not tracked
    assert [s[p].indicator for p in ("P0", "P1", "P2")] == ["GREEN", "RED", "NONE"]
    assert (s["P1"].last_24, s["P1"].current_streak_result, s["P1"].current_streak, s["P1"].balance) == ("DDE", "E", 1, "🔴")
    p = by(snapshot_payload(snapshot.snapshot(history(rows), tracked, reference_time=REF)), "league")
    assert p["EADRIATIC"].rows is None and [r.player for r in p["GT"].rows] == ["P0", "P2", "P1"]


def test_candidates_are_capped_after_exclusion(spark, history, tracked):
    rows = []
    for i in (0, 1, 2, 4, 5, 6, 7, 8, 9):
        rows += series(f"P{i}", "Z", "V" * (5 + i) + "D")
    snap = snapshot.snapshot(history(rows), tracked, reference_time=REF)
    all_names = [r.player for r in snapshot.candidates(snap).collect()]
    assert len(all_names) == 8 and "P0" not in all_names
    barred = spark.createDataFrame([("GT", "p9")], "league string, player_key string")
    assert "P0" in [r.player for r in snapshot.candidates(snap, barred).collect()]
    meta = pairing.selection_metadata(snapshot.candidates(snap, barred, limit=None), snapshot.candidates(snap, barred), excluded=barred).first()
    assert (meta.eligible_players, meta.selected_candidates, meta.excluded_candidates) == (8, 8, 1)
    chosen = spark.createDataFrame([("GT", "p1"), ("GT", "p3"), ("GT", "p9")], "league string, player_key string")
    assert [r.player for r in snapshot.manual_candidates(tracked, chosen, snap, barred).collect()] == ["P1"]


def test_empty_pairs_keep_their_header(spark, history, tracked):
    rows = series("P0", "Z", "VVVVV") + series("P1", "Z", "VVVVV", first=40)
    snap = snapshot.snapshot(history(rows), tracked, reference_time=REF)
    headers, matched = pairing.coincident_analysis(history(rows), snapshot.candidates(snap), reference_time=REF)
    assert [(r.player_a, r.player_b, r.matches) for r in headers.collect()] == [("P0", "P1", 0)] and matched.count() == 0
    r = pairing.pair_reliability(headers.drop("matches"), matched, snap).first()
    assert (r.score, r.level, r.indicator_strength) == (20.0, "LOW", 100.0)


def test_session_row(history, tracked):
    rows = series("P0", "Z", "VVD")
    s = sessions.player_sessions(history(rows), tracked, reference_time=START + timedelta(minutes=200)).first()
    assert (s.session_id, s.start_timestamp, s.end_local, s.duration_minutes, s.active, s.balance) == (
        "gt:p0:20260714T080000Z", "2026-07-14T08:00:00Z", "2026-07-14T10:20:00+02:00", 20, True, "🟢")
    late = sessions.player_sessions(history(rows), tracked, reference_time=START + timedelta(minutes=201)).first()
    assert late.active is False


def test_predictions(history, tracked):
    rows = series("P0", "P1", "V" * 25) + series("P1", "P0", "D" * 25)
    p = predictions.predictions(history(rows), tracked).first()
    assert (p.predicted_player, p.opponent, p.confidence, p.h2h_matches, p.recent_player_matches) == ("P0", "P1", "HIGH", 25, 24)
    h2h, recent, form, overall = (100 * 25 + 600) / 37, (100 * 20 + 300) / 26, (100 * 24 + 400) / 32, (100 * 25 + 2000) / 65
    assert p.estimated_win_pct == round(h2h * 0.4 + recent * 0.25 + form * 0.25 + overall * 0.1, 2)
    assert predictions.predictions(history(series("P0", "P1", "V" * 9)), tracked, min_estimated_win_pct=50).count() == 0
    with pytest.raises(ValueError):
        predictions.predictions(history(rows), tracked, min_estimated_win_pct=49)


def test_streak_tables(spark, scratch):
    days = [("20260401", "A", "V" * 20 + "E" + "D" * 9), ("20260402", "A", "VE" * 9), ("20260402", "B", "V" * 17)]
    daily = spark.createDataFrame([(d, p, s.count("V"), s.count("E"), s.count("D"), len(s), s) for d, p, s in days],
                                  "date string, player string, wins int, draws int, losses int, played int, seq string")
    risk = streak_tables.player_risk(daily).first()
    assert (risk.player, risk.max_streak, risk.recommended_entry, risk.streaks_20_plus, risk.stability, risk.danger_days_pct, risk.safe_for_strategy) == (
        "A", 20, 13, 1, "MEDIUM", 50.0, "YES")
    dist = by(streak_tables.streak_distribution(daily), "streak")
    assert (dist[20].ended_same_day, dist[20].finished_day_with_streak) == (1, 0)
    assert (dist[9].ended_same_day, dist[9].finished_day_with_streak) == (0, 1)
    summary = streak_tables.daily_streak_summary(daily).first()
    assert (summary.date, summary.streak_9, summary.streak_20, summary.streak_30) == ("20260401", 1, 1, 0)
    assert len(streak_reports(daily)) == 9
    write_streak_reports(daily, f"{scratch}/csv")
    assert spark.read.option("header", True).csv(f"{scratch}/csv/player_summary").first().player == "A"
