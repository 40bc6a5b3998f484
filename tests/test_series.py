"""Ordered operators against plain Python on random series, for several ways of cutting time."""

import itertools
import random
from collections import defaultdict
from datetime import timedelta

import pytest
from conftest import START, by, row
from pyspark.sql import functions as F

from duelbook.functions.times import time_slice
from duelbook.operators import filters, h2h, opportunity, pairing, recent, runs, segments, sessions, totals


def random_history(seed, players=3, n=120, spread=6000, invalid=0.05):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # The first player holds most of the rows.
        p = 0 if rng.random() < 0.6 else rng.randrange(1, players)
        res = "X" if rng.random() < invalid else rng.choice("VVED")
        rows.append(row(i, f"P{p}", f"R{rng.randrange(2)}", res, rng.randrange(spread)))
    return rows


def ordered(rows, player):
    own = [r for r in rows if r[4] == player and r[7] in "VED"]
    return sorted(own, key=lambda r: (r[8], r[1], r[2]))


def run_lengths(seq):
    return [(k, len(list(g))) for k, g in itertools.groupby(seq)]


CUTS = [("month", 0), ("day", 0), ("hour", 0), ("minute", 0), ("stamp", 4)]


@pytest.mark.parametrize("cut,tie", CUTS)
def test_totals_and_streaks(history, cut, tie):
    rows = random_history(1)
    got = by(totals.player_totals(history(rows), slice_by=cut, tie_prefix=tie), "player")
    for p in ("P0", "P1", "P2"):
        seq = [r[7] for r in ordered(rows, p.lower())]
        rl = run_lengths(seq)
        assert (got[p].played, got[p].wins, got[p].draws, got[p].losses) == (len(seq), seq.count("V"), seq.count("E"), seq.count("D"))
        assert (got[p].current_streak_result, got[p].current_streak) == rl[-1]
        assert got[p].best_win_streak == max([n for k, n in rl if k == "V"], default=0)
        assert got[p].best_loss_streak == max([n for k, n in rl if k == "D"], default=0)
        assert got[p].win_pct == round(seq.count("V") / len(seq) * 100, 2)


@pytest.mark.parametrize("cut,tie", CUTS)
def test_run_table(history, cut, tie):
    rows = random_history(2, invalid=0)
    r = runs.runs(history(rows), ["player_key"], F.col("result") != "E", slice_by=cut, tie_prefix=tie).collect()
    for p in ("p0", "p1", "p2"):
        want = run_lengths([x[7] != "E" for x in ordered(rows, p)])
        mine = sorted((x for x in r if x.player_key == p), key=lambda x: x["last"])
        assert [(x.value, x.length) for x in mine] == want
        assert [x.is_last for x in mine] == [False] * (len(want) - 1) + [True]


def test_slices_follow_the_order(history):
    rows = random_history(3, spread=200)
    df = history(rows).filter("player_key = 'p0'")
    for cut, tie in CUTS:
        s = [r["s"] for r in df.orderBy(*runs.ORDER).select(time_slice(cut, tie).alias("s")).collect()]
        assert s == sorted(s)


def test_identity_without_valid_result_keeps_a_zero_row(history):
    got = by(totals.player_totals(history([row(1, "A", "B", "?"), row(2, "B", "A", "V")])), "player")
    assert got["A"].played == 0 and got["A"].current_streak_result is None and got["A"].win_pct == 0.0
    assert got["B"].current_streak == 1


def test_same_name_in_two_leagues_is_two_players(history):
    got = totals.player_totals(history([row(1, "A", "B", "V"), row(2, "A", "B", "D", league="EADRIATIC")])).collect()
    assert sorted((r.league, r.wins, r.losses) for r in got) == [("EADRIATIC", 0, 1), ("GT", 1, 0)]


def test_result_does_not_depend_on_input_order(history):
    rows = random_history(4)
    shuffled = rows[:]
    random.Random(9).shuffle(shuffled)
    a, b = (sorted(map(tuple, totals.player_totals(history(x)).collect())) for x in (rows, shuffled))
    assert a == b


def test_windows_drop_invalid_rows_before_the_cut(history):
    rows = [row(i, "A", "B", r) for i, r in enumerate("VVDX?EV")]
    w = by(recent.player_windows(history(rows), [3, 10]), "window")
    assert (w[3].sequence, w[3].available) == ("DEV", 3)
    assert (w[10].sequence, w[10].available, w[10].current_streak_result, w[10].current_streak) == ("VVDEV", 5, "V", 1)


def test_long_windows_go_by_days(spark, history):
    """Beyond Spark's limit of ranks, the latest rows come from the days that hold them: the same rows, and no window over a whole player."""
    rows = random_history(11, n=400, spread=12000)
    df = history(rows)
    want = sorted((r.perspective_id, r.rn) for r in runs.last_n(df, ["player_key"], 90).collect())
    forms = sorted(map(tuple, recent.player_windows(df, [7, 90]).collect()))
    assert "_day" in runs.last_n(df, ["player_key"], 5000)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        assert sorted((r.perspective_id, r.rn) for r in runs.last_n(df, ["player_key"], 90).collect()) == want
        assert sorted(map(tuple, recent.player_windows(df, [7, 90]).collect())) == forms
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_positions_are_those_of_a_global_sort(history):
    rows = random_history(12, n=150, spread=3000)
    got = {r.perspective_id: r.position for r in filters.numbered(history(rows)).collect()}
    assert [got[r[2]] for r in sorted(rows, key=lambda r: (r[8], r[1], r[4], r[2]))] == list(range(1, 151))


def test_recent_forms_keep_request_order_and_repeats(history):
    rows = [row(i, "A", "B", r) for i, r in enumerate("DDDDVVVV")]
    got = sorted(recent.recent_forms(history(rows), [4, 2, 4]).collect(), key=lambda r: r.ord)
    assert [r.window_size for r in got] == [4, 2, 4]
    assert got[0].trend == "UP" and got[0].win_pct_delta == 50.0 and got[0].best_win_streak == 4 and got[0].window_complete


@pytest.mark.parametrize("cut,tie", CUTS)
def test_summaries_are_those_of_the_whole_series(history, cut, tie):
    """However a series is sliced, the merged summary says what the text would; texts of a calendar slice put together are the whole."""
    rows = random_history(5, players=3, n=150, spread=3000, invalid=0) + [row(900 + i, "Q", "Z", "VED"[i % 3 if i < 4 else 0], i * 500) for i in range(40)]
    s = by(segments.summary(history(rows), ["player_key"], cut, tie).select(
        "*", segments.win_run().alias("v"), segments.unbeaten_run().alias("nd"), segments.winless_run().alias("nv"), segments.drawless_run().alias("ne"),
        segments.same_run().alias("same"), segments.last_result().alias("at_end")), "player_key")
    whole = by(segments.joined_text(segments.sequences(history(rows), ["player_key"], "month"), ["player_key"]), "player_key")
    for p in ("p0", "p1", "p2", "q"):
        text = "".join(r[7] for r in ordered(rows, p))
        r = s[p]
        assert whole[p].sequence == text
        assert (r.played, r.wins, r.draws, r.losses, r.last_24, r.at_end) == (len(text), text.count("V"), text.count("E"), text.count("D"), text[-24:], text[-1])
        assert (r.v, r.nd, r.nv, r.ne, r.same) == tuple(len(text) - len(text.rstrip(x)) for x in ("V", "VE", "ED", "VD", text[-1]))
        assert r.calm == max(map(len, text.split("E"))) and [r[f"first_{v}"] or 0 for v in "VED"] == [text.find(v) + 1 for v in "VED"]


def test_summary_of_a_text_is_that_of_its_rows(spark, history):
    rows = random_history(7, players=2, n=90, spread=900, invalid=0)
    texts = {p: "".join(r[7] for r in ordered(rows, p)) for p in ("p0", "p1")} | {"x": None, "y": "VV"}
    t = by(segments.of_text(spark.createDataFrame(list(texts.items()), "player_key string, seq string")), "player_key")
    s = by(segments.summary(history(rows), ["player_key"]), "player_key")
    for p in ("p0", "p1"):
        for c in ("played", "wins", "draws", "losses", "last_24", "calm", *(f"{n}_{v}" for n in ("first", "last") for v in "VED")):
            assert t[p][c] == s[p][c], c
    assert (t["x"].played, t["x"].last_V, t["x"].calm, t["y"].last_V, t["y"].first_E, t["y"].calm) == (0, None, 0, 2, None, 2)


def test_a_day_of_very_many_results(spark):
    """A hundred thousand results in one day and one session: no value of the plan holds them all."""
    from duelbook.operators import daily

    n = 100_000
    df = spark.range(n, numPartitions=4).select(
        F.lit("GT").alias("league"), F.format_string("gt:%07d", "id").alias("match_id"), F.col("id").cast("string").alias("perspective_id"),
        F.lit("A").alias("player"), F.lit("a").alias("player_key"), F.lit("B").alias("rival"), F.lit("b").alias("rival_key"),
        F.when(F.col("id") % 1000 == 7, "E").when(F.col("id") % 3 == 0, "V").otherwise("D").alias("result"),
        F.timestamp_add("MILLISECOND", F.col("id") * 500, F.lit("2026-07-14 00:00:00").cast("timestamp_ntz")).alias("ts"))
    day = daily.daily_players(df, F.col("ts").cast("date")).first()
    assert (day.played, day.draws, day.calm, day.current_streak) == (n, 100, 999, 992)
    one = sessions.player_sessions(df, reference_time="2026-07-15T00:00:00Z").collect()
    assert [(r.played, r.draws, len(r.last_24)) for r in one] == [(n, 100, 24)]
    assert max(r.n for r in daily.daily_sequences(df, F.col("ts").cast("date")).collect()) == 7200


def test_h2h_is_directed_and_mirrored(history):
    rows = []
    for i, r in enumerate("VEDVV"):
        rows += [row(i, "A", "B", r), row(i, "B", "A", {"V": "D", "D": "V", "E": "E"}[r])]
    t = by(h2h.h2h_totals(history(rows)), "player")
    assert (t["A"].wins, t["A"].losses) == (3, 1) and (t["B"].wins, t["B"].losses) == (1, 3)
    texts = by(h2h.h2h_sequences(history(rows)), "player_key")
    assert (texts["a"].seq, texts["b"].seq, texts["a"].n) == ("VEDVV", "DEVDD", 5)
    c = by(h2h.h2h_comparison(history(rows), 2, min_historical_matches=5), "player")
    assert (c["A"].recent_win_pct, c["A"].historical_win_pct, c["A"].trend, c["A"].sample_status) == (100.0, 60.0, "UP", "COMPLETE")
    assert h2h.h2h_comparison(history(rows), 2, min_historical_matches=6).count() == 0


# --- sessions ---------------------------------------------------------------------

def test_session_gap_is_exclusive(history):
    rows = [row(i, "A", "B", "V", m) for i, m in enumerate((0, 90, 181, 200))]
    s = by(sessions.numbered_sessions(history(rows)), "session_number")
    assert {k: v.played for k, v in s.items()} == {1: 2, 2: 2}


@pytest.mark.parametrize("cut", ["month", "day", "hour"])
def test_sessions_against_a_walk(history, cut):
    rows = random_history(6, spread=20000, invalid=0)
    got = sessions.numbered_sessions(history(rows), 90, slice_by=cut).collect()
    texts = sessions.session_sequences(history(rows), 90, slice_by=cut).collect()
    for p in ("p0", "p1", "p2"):
        want, last = [], None
        for r in ordered(rows, p):
            if last is None or r[8] - last > timedelta(minutes=90):
                want.append("")
            want[-1] += r[7]
            last = r[8]
        mine = sorted((r for r in got if r.player_key == p), key=lambda r: r.session_number)
        whole = defaultdict(str)
        for t in sorted((t for t in texts if t.player_key == p), key=lambda t: t.start):
            whole[t.session_number] += t.seq
        assert [whole[r.session_number] for r in mine] == want and [(r.played, r.last_24) for r in mine] == [(len(w), w[-24:]) for w in want]
        assert [r.session_number for r in mine] == list(range(1, len(want) + 1))


# --- pairing ----------------------------------------------------------------------

def walk(a, b, gap):
    """Plain two-stack walk: (match of a, match of b)."""
    line = sorted([(r[8], 0, r[1], r[2]) for r in a] + [(r[8], 1, r[1], r[2]) for r in b])
    stacks, out = ([], []), []
    for t, s, m, p in line:
        other = stacks[1 - s]
        if other and t - other[-1][0] <= timedelta(minutes=gap):
            e = other.pop()
            out.append((m, e[1]) if s == 0 else (e[1], m))
        else:
            stacks[s].append((t, m))
    return sorted(out)


def two_players(seed, n, spread):
    rng = random.Random(seed)
    return [row(i, "AB"[rng.random() < 0.5], "Z", rng.choice("VED"), rng.randrange(spread)) for i in range(n)]


def pair_of(spark):
    c = spark.createDataFrame([("GT", "a", "A", "GREEN"), ("GT", "b", "B", "RED")], "league string, player_key string, player string, indicator string")
    return pairing.candidate_pairs(c)


@pytest.mark.parametrize("seed,n,spread,gap", [(1, 60, 900, 30), (2, 200, 4000, 30), (3, 300, 9000, 45), (4, 120, 12000, 600), (5, 90, 9000, 2000)])
def test_pairing_against_a_walk(spark, history, seed, n, spread, gap):
    rows = two_players(seed, n, spread)
    want = walk([r for r in rows if r[4] == "a"], [r for r in rows if r[4] == "b"], gap)
    m = pairing.coincident_matches(history(rows), pair_of(spark), max_gap_minutes=gap).collect()
    assert sorted((r.player_a_match_id, r.player_b_match_id) for r in m) == want
    assert sorted(r.pair_order for r in m) == list(range(1, len(want) + 1))
    used = [r.player_a_match_id for r in m] + [r.player_b_match_id for r in m]
    assert len(used) == len(set(used)) and all(0 <= r.gap_minutes <= gap for r in m)


def test_stretches_are_cut_at_pauses(spark, history):
    """A timeline of many days is dealt by its pauses, across midnight too; stretches of several batches are walked as one."""
    rows = two_players(6, 400, 20_000)
    gap = 30
    events = pairing.components(pairing.pair_events(history(rows), pair_of(spark)), gap * 60_000_000).collect()
    at = sorted(e.at for e in events)
    start, want = None, {}
    for i, t in enumerate(at):
        start = t if i == 0 or t - at[i - 1] > gap * 60_000_000 else start
        want[t] = start
    assert len(events) == 400 and len(set(want.values())) > 20 and all(e.component == want[e.at] for e in events)
    dense = two_players(7, 500, 900)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = pairing.coincident_matches(history(dense), pair_of(spark)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.player_a_match_id, r.player_b_match_id) for r in got) == walk([r for r in dense if r[4] == "a"], [r for r in dense if r[4] == "b"], gap)


def test_pairing_gap_is_inclusive(spark, history):
    for minutes, expected in ((30, 1), (31, 0)):
        rows = [row(1, "A", "Z", "V", 0), row(2, "B", "Z", "D", minutes)]
        m = pairing.coincident_matches(history(rows), pair_of(spark)).collect()
        assert len(m) == expected
    assert pairing.coincident_matches(history([row(1, "A", "Z", "V", 0), row(2, "B", "Z", "D", 5)]), pair_of(spark)).first().confirmation == "MIXED"


def test_direct_match_pairs_with_itself_unless_told_otherwise(spark, history):
    rows = [row(1, "A", "B", "V", 0), row(1, "B", "A", "D", 0)]
    assert pairing.coincident_matches(history(rows), pair_of(spark)).count() == 1
    assert pairing.coincident_matches(history(rows), pair_of(spark), exclude_same_match=True).count() == 0


def test_a_manual_list_has_no_limit(spark):
    c = spark.createDataFrame([("GT", f"p{i}", f"P{i}", None) for i in range(12)] * 2, "league string, player_key string, player string, indicator string")
    got = [(r.key_a, r.key_b) for r in pairing.candidate_pairs(c).collect()]
    assert len(got) == len(set(got)) == 66 and all(a < b for a, b in got)
    assert pairing.candidate_pairs(c.limit(0)).count() == 0


def test_trailing_runs_of_a_long_text(spark):
    from duelbook.functions import results

    long = "E" + "V" * 100_000 + "D" * 100_000
    df = spark.createDataFrame([(long,), ("",), ("VED",), ("DEV",), ("VVE",), ("EE",)], "s string")
    f = (results.win_run, results.unbeaten_run, results.winless_run, results.drawless_run, results.same_run)
    got = [tuple(r) for r in df.select(*[x(F.col("s")).alias(str(i)) for i, x in enumerate(f)]).collect()]
    assert got == [(0, 0, 100_000, 200_000, 100_000), (0, 0, 0, 0, 0), (0, 0, 2, 1, 1), (1, 2, 0, 1, 1), (0, 3, 1, 0, 1), (0, 2, 2, 0, 2)]


# --- opportunity ------------------------------------------------------------------

def test_entry_backtest_against_a_walk(history):
    rows = random_history(8, players=2, n=400, invalid=0)
    for entry in (0, 1, 3, 6):
        got = by(opportunity.entry_results(history(rows), entry), "player_key")
        for p in ("p0", "p1"):
            seq, run, samples, hits = [r[7] for r in ordered(rows, p)], 0, 0, 0
            for i, ch in enumerate(seq):
                run = 0 if ch == "E" else run + 1
                if ch != "E" and run == entry:
                    samples += 1
                    hits += "E" in seq[i + 1:i + 9]
            assert (got[p].samples, got[p].hits) == (samples, hits), (entry, p)


def test_opportunity_row(history):
    rows = [row(i, "A", "B", r) for i, r in enumerate("VVEVEDDE" + "VV")]
    o = opportunity.opportunities(history(rows)).first()
    assert (o.matches, o.draws, o.current_streak_real, o.avg_streak, o.samples, o.prob_next_8) == (10, 3, 2, 1.75, 3, 66.67)
    assert (o.reason, o.recommendation) == ("DRAW_OK|STREAK_OK", "SKIP")


# --- filters ----------------------------------------------------------------------

def test_filters_reject_blank_arguments(history):
    df = history([row(1, "A", "B", "V")])
    for call in (lambda: filters.by_league(df, " "), lambda: filters.by_player(df, ""), lambda: filters.latest(df, -1),
                 lambda: filters.latest(df, True), lambda: filters.by_time(df, "2026-02-01", "2026-01-01"), lambda: filters.by_time(df, "nonsense")):
        with pytest.raises(ValueError):
            call()


def test_window_edges_are_inclusive(history):
    ref = START + timedelta(hours=8)
    rows = [row(1, "A", "B", "V", START), row(2, "A", "B", "V", START - timedelta(seconds=1)),
            row(3, "A", "B", "V", ref), row(4, "A", "B", "V", ref + timedelta(seconds=1))]
    assert {r.match_id for r in filters.trailing_hours(history(rows), ref, 8).collect()} == {"gt:1", "gt:3"}


def test_latest_zero_is_empty(history):
    assert filters.latest(history([row(1, "A", "B", "V")]), 0).count() == 0


def test_exclusion_hits_player_and_rival(spark, history):
    rows = [row(1, "A", "B", "V"), row(2, "B", "A", "D"), row(3, "A", "C", "V"), row(4, "A", "B", "V", league="EADRIATIC")]
    ex = spark.createDataFrame([("GT", "b")], "league string, player_key string")
    assert {r.match_id for r in filters.operational(history(rows), ex).collect()} == {"gt:3", "eadriatic:4"}


def test_whole_texts_beside_the_totals(history):
    """Totals, days, sessions and groups give all their results as text, beyond what a summary holds."""
    from duelbook.operators import daily, groups

    text = "".join("VED"[(i * i + i // 7) % 3] for i in range(120))
    rows = [row(i, "A", "B", v, START + timedelta(minutes=20 * i + (7 * 24 * 60 if i >= 70 else 0))) for i, v in enumerate(text)]
    df = history(rows)
    assert [r.sequence for r in h2h.h2h_totals(df, text=True).collect()] == [text]
    wanted = df.select("league", "player", "player_key", "rival", "rival_key").distinct().union(
        df.limit(1).selectExpr("league", "player", "player_key", "'Nobody'", "'nobody'"))
    assert sorted(r.sequence for r in h2h.h2h_for(df, wanted, text=True).collect()) == ["", text]
    assert [r.sequence for r in opportunity.player_texts(df).collect()] == [text]
    for slice_by in ("hour", "day"):
        s = sessions.player_sessions(df, reference_time=START, text=True, slice_by=slice_by).orderBy("session_number").collect()
        assert [r.sequence for r in s] == [text[:70], text[70:]]
    day = F.col("ts").cast("date")
    days = [r.seq for r in daily.daily_players(df, day, text=True).orderBy("date").collect()]
    assert len(days) > 2 and "".join(days) == text
    targets = df.sparkSession.createDataFrame([("GT", 0, 2, "A", 1), ("GT", 0, 2, "B", 2)], "league string, group_no int, group_size long, player string, slot int")
    assert [r.seq for r in groups.group_h2h(targets, daily.daily_rivals(df, day, text=True), text=True).collect()] == [text]


def test_player_texts_are_whole_and_in_numbered_parts(history):
    """The whole text as one part of one, and a numbered part with its count for every month."""
    days = (0, 1, 17, 18, 30, 90, 91)
    df = history([row(i, "A", "B", v, START + timedelta(days=d)) for i, (d, v) in enumerate(zip(days, "VEDVVED"))] + [row(99, "C", "D", "E")])
    got = [tuple(r)[1:] for r in opportunity.player_text_parts(df).orderBy("player_key", "grain", "slice").collect()]
    month = START.date().replace(day=1)
    assert got == [
        ("a", "all", None, 7, "VEDVVED", 1, 1), ("a", "month", month, 3, "VED", 1, 3), ("a", "month", month.replace(month=8), 2, "VV", 2, 3),
        ("a", "month", month.replace(month=10), 2, "ED", 3, 3), ("c", "all", None, 1, "E", 1, 1), ("c", "month", month, 1, "E", 1, 1)]
