import json
from datetime import date, datetime

import pytest
from conftest import by, row
from pyspark.sql import functions as F

from duelbook.operators import merge, quality
from duelbook.operators.groups import day_groups, target_groups
from duelbook.schemas import HISTORY_SCHEMA
from duelbook.sources import fixtures_html, fixtures_json, history as store, reports, tracked


def record(mid="gt:1", player="Álex", rival="João", result="V", side="home", home=2, away=1, **extra):
    key, rkey = player.casefold(), rival.casefold()
    return {"schema_version": 1, "league": "GT", "match_id": mid, "perspective_id": f"{mid}:{key}", "player": player, "player_key": key,
            "rival": rival, "rival_key": rkey, "result": result, "timestamp": "2026-07-14T10:00:00+02:00", "timestamp_utc": "2026-07-14T08:00:00Z",
            "timestamp_precision": "second", "timezone": "UTC+02:00", "timezone_inferred": False, "home_away": side, "home_score": home,
            "away_score": away, "source_type": "gt_api", "source_file": "gt_api:2026-07-14", "data_quality": "complete", **extra}


def pair(mid="gt:1", **kw):
    return [record(mid, **kw), record(mid, "João", "Álex", "D", "away", **kw)]


@pytest.fixture()
def records(spark):
    def make(rows):
        filled = [{f.name: r.get(f.name) for f in HISTORY_SCHEMA} for r in rows]
        return store.with_instant(spark.createDataFrame(filled, HISTORY_SCHEMA))
    return make


# --- validation ---------------------------------------------------------------------

def test_valid_pair_has_no_errors(records):
    assert quality.split_valid(records(pair()))[1].count() == 0
    assert quality.pair_errors(records(pair())).count() == 0
    assert quality.require_valid(records(pair())).count() == 2


@pytest.mark.parametrize("change,rule", [
    ({"schema_version": 2}, "schema_version"), ({"league": "NBA"}, "league"), ({"result": "X"}, "result"), ({"home_away": "left"}, "home_away"),
    ({"home_score": -1}, "scores"), ({"home_score": None}, "missing home_score"), ({"player": " Álex"}, "names not normalized"),
    ({"player_key": "Álex"}, "keys not normalized"), ({"perspective_id": "gt:1:x"}, "perspective_id"), ({"match_id": "xx:1"}, "match_id prefix"),
    ({"source_file": ""}, "source"), ({"timestamp": "2026-07-14T10:00:00"}, "timestamp"), ({"timestamp_utc": "2026-07-14T08:00:00+00:00"}, "timestamp_utc"),
    ({"timestamp_utc": "2026-07-14T08:00:01Z"}, "instants differ"), ({"result": "E"}, "result against score"), ({"timezone": ""}, "timezone"),
    ({"data_quality": "perfect"}, "data_quality"), ({"timestamp_precision": "day"}, "timestamp_precision")])
def test_every_rule_is_reported(records, change, rule):
    bad = quality.record_errors(records([{**record(), **change}])).first()
    assert rule in bad.errors
    with pytest.raises(Exception, match="invalid record"):
        quality.require_valid(records([{**record(), **change}])).collect()


def test_pair_errors(records):
    a, b = pair()
    got = by(quality.pair_errors(records([a, {**b, "timezone": "UTC"}] + [{**r, "match_id": "gt:2"} for r in (a, a, b)] + [{**a, "match_id": "gt:3"}])), "match_id")
    assert got["gt:1"].errors == ["disagree on timezone"]
    assert "not two perspectives" in got["gt:2"].errors and "not one home and one away" in got["gt:3"].errors
    half = [{**a, "round": "R1"}, b]
    assert quality.pair_errors(records(half)).first().errors == ["disagree on round"]


# --- merge and repair ------------------------------------------------------------------

def test_merge_fills_gaps_keeps_old_values_and_raises_quality(records):
    old = record(data_quality="partial", round=None, competition="Cup", collected_at="1")
    new = record(data_quality="inferred", round="R1", competition="League", collected_at="2", source_file="other")
    merged = merge.upsert(records([old]), records([new])).first()
    assert (merged.round, merged.competition, merged.data_quality, merged.collected_at, merged.source_file) == (
        "R1", "Cup", "inferred", "1", "gt_api:2026-07-14")
    both = records([old]).withColumn("arrival", F.lit(0).cast("long")).unionByName(records([new]).withColumn("arrival", F.lit(1).cast("long")))
    c = merge.merge_conflicts(both).collect()
    assert [(r.field, r.kept) for r in c] == [("competition", "Cup")]


def test_merge_is_idempotent(records):
    first = merge.upsert(records(pair()), records(pair("gt:2")))
    again = merge.upsert(first, records(pair("gt:2")))
    assert sorted(map(tuple, first.select("perspective_id", "result").collect())) == sorted(map(tuple, again.select("perspective_id", "result").collect()))
    assert again.count() == 4



def test_upsert_of_many_copies_is_that_of_all_rows_at_once(spark):
    """Sides merged by themselves first: copies, equal places, blanks, columns that one side lacks, repeated merges and null ids."""
    import random

    rng = random.Random(8)

    def side(n, **more):
        names = ["perspective_id", "player", "round", "data_quality", "ts", *more]
        rows = [(rng.choice([None, *"abcdefgh"]), rng.choice([None, "", "P", "Q"]), rng.choice([None, "", "1", "2"]), rng.choice([None, *merge.QUALITY_ORDER]),
                 rng.choice([None, datetime(2026, 7, 14), datetime(2026, 7, 15)]), *[rng.choice([None, 1, 2]) for _ in more]) for _ in range(n)]
        return spark.createDataFrame(rows, ", ".join(f"{c} {dict(ts='timestamp_ntz', **more).get(c, 'string')}" for c in names))

    def at_once(old, new):
        both = old.withColumn("_class", F.lit(0)).unionByName(new.withColumn("_class", F.lit(1)), allowMissingColumns=True)
        fields = [c for c in both.columns if c not in ("perspective_id", "_class")]
        found = {}
        for r in sorted(both.collect(), key=lambda r: (r["_class"], r["ts"] is not None, r["ts"] or datetime.min)):
            found.setdefault(r.perspective_id, []).append(r)
        rows = set()
        for pid, copies in found.items():
            values = []
            for f in fields:
                there = [r for r in copies if r[f] not in (None, "")]
                if f == "data_quality":
                    values.append(max((r[f] for r in there), key=merge.QUALITY_ORDER.index, default=None))
                else:
                    values.append(min((r[f] for r in there if (r["_class"], r["ts"]) == (there[0]["_class"], there[0]["ts"])), default=None))
            rows.add((pid, *values))
        return ["perspective_id", *fields], rows

    for n, m in ((60, 60), (6, 40), (0, 30)):
        old, new = side(n, home_score="int"), side(m, away_score="int")
        got = merge.upsert(old, new)
        names, want = at_once(old, new)
        assert {tuple(r[c] for c in names) for r in got.collect()} == want and got.count() == len(want) and sorted(got.columns) == sorted(names)
        again = merge.upsert(got, new).collect()
        assert {tuple(r[c] for c in names) for r in again} == at_once(got, new)[1] and len(again) == len(want)


def test_upsert_shuffles_a_side_once(spark):
    """Sides that are merged lie together by id: nothing is shuffled after they are put together, nor the candidates again by a second merge."""
    rows = spark.range(100).selectExpr("concat('p', id) as perspective_id", "'P' as player", "timestamp_ntz'2026-07-14' as ts")
    df = merge.upsert(merge.upsert(rows.where("player > 'A'"), rows), rows).select("perspective_id", "player")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" not in plan[:plan.index("Union")] and plan.count(" Exchange hashpartitioning(perspective_id") <= 3 and "ReusedExchange" in plan


def test_lone_rows_merge_as_in_the_upsert_without_a_sort_per_field(records):
    stored = [record("gt:1", round="", competition="Cup", data_quality="partial"), record("gt:2"), record("gt:4", data_quality=None, group_players=[])]
    new = [record("gt:1", round="R1", competition="League", data_quality="inferred"), record("gt:3", rival=""), record("gt:4", group_players=["a"]),
           {**record("gt:5"), "perspective_id": None, "round": "R5"}]
    stored.append({**record("gt:5"), "perspective_id": None, "data_quality": "perfect"})
    got, want = merge.upsert_lone(records(stored), records(new)), merge.upsert(records(stored), records(new))
    assert got.columns == want.columns and got.dtypes == want.dtypes and want.count() == 5
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_repair_actions(records):
    stored = records([record("gt:1"), record("gt:2", round="R1", competition="Cup"), record("gt:3"), record("gt:4")])
    new = records([record("gt:2", round="R2", source_file="repair", collected_at="now"), record("gt:3"), record("gt:4", away=0), record("gt:5")])
    r = by(merge.reconcile_repair(stored, new), "match_id")
    assert {k: v.action for k, v in r.items()} == {"gt:1": "stored", "gt:2": "updated", "gt:3": "unchanged", "gt:4": "conflict", "gt:5": "added"}
    assert (r["gt:2"].round, r["gt:2"].competition, r["gt:2"].source_file, r["gt:2"].collected_at) == ("R2", None, "repair", "now")
    assert r["gt:4"].away_score == 1
    assert merge.repair_candidates(new, date(2026, 7, 13)).count() == 4 and merge.repair_candidates(new, date(2026, 7, 15)).count() == 0


# --- store ------------------------------------------------------------------------------

def test_jsonl_reading(spark, scratch):
    path = f"{scratch}/history.jsonl"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(r, ensure_ascii=False) for r in pair()) + "\n\n")
    df = store.read_validated_jsonl(spark, path, f"{scratch}/missing.jsonl")
    assert sorted(r.player_key for r in df.collect()) == ["joão", "álex"] and df.first().ts == datetime(2026, 7, 14, 8)
    assert store.read_jsonl(spark, f"{scratch}/missing.jsonl").count() == 0
    bad = f"{scratch}/bad.jsonl"
    with open(bad, "w") as f:
        f.write('{"league": \n')
    with pytest.raises(Exception, match="bad.jsonl"):
        store.read_jsonl(spark, bad).select("league").collect()


def test_update_merges_repeated_copies_field_by_field(spark, scratch, records):
    """Ids that a side has several times, beside ids that neither has: the rows of the upsert, and an index entry each."""
    path = f"{scratch}/repeated"
    old = [record("gt:1", round="R1"), record("gt:1", competition="Cup"), record("gt:2"), record("gt:3", rival="")]
    new = [record("gt:2", round="b"), record("gt:2", round="a", competition="z"), record("gt:3"), record("gt:4"), record("gt:4"), record("gt:5")]
    store.write_history(records(old), path)
    store.update_history(spark, path, records(new), f"{scratch}/repeated-staging")
    got = store.read_history(spark, path)
    want = merge.upsert(records(old), records(new)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 5
    assert {r.match_id: (r.round, r.competition) for r in got.collect()}["gt:2"] == ("a", "z")
    index = spark.read.parquet(store.store_index.folder(path))
    assert sorted(r.perspective_id for r in index.collect()) == sorted(r.perspective_id for r in got.collect())


def test_update_looks_nothing_up_on_the_days_of_its_own_rows(spark, scratch, records, monkeypatch):
    """No index is built or joined for days that are read anyway; it is written once, at the end, and follows later updates."""
    path, index = f"{scratch}/own-days", store.store_index
    later = {"timestamp": "2026-07-15T10:00:00+02:00", "timestamp_utc": "2026-07-15T08:00:00Z"}
    store.write_history(records(pair() + pair("gt:9", **later)), path)
    built = []
    rebuild = index.rebuild
    monkeypatch.setattr(index, "rebuild", lambda *a: (built.append(a), rebuild(*a)))
    whole = records(pair() + pair("gt:2", **later))
    days = store.touched_days(spark, path, whole)
    assert sorted(days) == [("GT", date(2026, 7, 14)), ("GT", date(2026, 7, 15))] and not built
    store.update_history(spark, path, whole, f"{scratch}/own-days-1")
    assert len(built) == 1
    store.update_history(spark, path, records(pair("gt:3") + pair("gt:9")), f"{scratch}/own-days-2")  # gt:9 lies a day later
    at = {r.perspective_id.rsplit(":", 1)[0]: r.match_date.day for r in spark.read.parquet(index.folder(path)).collect()}
    assert at == {"gt:1": 14, "gt:2": 15, "gt:3": 14, "gt:9": 15} and len(built) == 1
    assert spark.read.parquet(index.folder(path)).count() == store.read_history(spark, path).count() == 8


def test_update_keeps_stored_rows_without_an_instant(spark, scratch, records):
    path = f"{scratch}/no-instant"
    bare = {"timestamp": None, "timestamp_utc": None}
    store.write_history(records(pair(**bare)), path)
    store.update_history(spark, path, records(pair("gt:2", **bare)), f"{scratch}/no-instant-staging")
    assert sorted(r.match_id for r in store.read_history(spark, path).collect()) == ["gt:1", "gt:1", "gt:2", "gt:2"]


def test_update_history_twice_changes_nothing(spark, scratch, records):
    path, staging = f"{scratch}/store", f"{scratch}/staging"
    store.update_history(spark, path, records(pair()), staging)
    store.update_history(spark, path, records(pair("gt:2")), staging)
    before = sorted(map(tuple, store.read_history(spark, path).select("perspective_id", "result", "ts").collect()))
    store.update_history(spark, path, records(pair("gt:2") + pair()), staging)
    after = store.read_history(spark, path, "gt")
    assert sorted(map(tuple, after.select("perspective_id", "result", "ts").collect())) == before and len(before) == 4
    plan = after.filter("league = 'GT'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(league" in plan
    store.export_jsonl(after, f"{scratch}/export")
    assert store.read_jsonl(spark, f"{scratch}/export/*.json").count() == 4
    assert store.load_player_totals(spark, path).count() == 2 and store.load_h2h(spark, path).count() == 2


# --- fixtures -----------------------------------------------------------------------------

def fixture(n=1, kickoff="2026-07-14T10:00:00+02:00", home="Álex", away="João", hs=2, as_=1):
    people = [{"side": s, "participant": {"player": {"nickname": p}}} for s, p in (("away", away), ("home", home)) if p is not None]
    return json.dumps({"id": n, "kickoff": kickoff, "participants": people, "result": {"stats": {"home_score": hs, "away_score": as_}}}, ensure_ascii=False)


def test_json_fixtures(spark):
    lines = [fixture(1), fixture(1, hs=9), fixture(2, hs=True), fixture(3, hs=-1), fixture(4, home=None), fixture(5, kickoff="soon"),
             fixture(6, home="  "), fixture(7, "2026-07-14T10:00", hs=0, as_=0), fixture(None)]
    df = spark.createDataFrame(list(enumerate(lines)), "source_order long, json string")
    p = fixtures_json.perspectives_from_fixtures(fixtures_json.parse_fixtures(df), "day")
    got = by(p, "perspective_id")
    assert set(got) == {"gt:1:álex", "gt:1:joão", "gt:7:álex", "gt:7:joão"}
    assert (got["gt:1:álex"].result, got["gt:1:joão"].result, got["gt:1:álex"].home_score) == ("V", "D", 2)
    assert (got["gt:7:álex"].data_quality, got["gt:7:álex"].timestamp, got["gt:7:álex"].result) == ("inferred", "2026-07-14T10:00+02:00", "E")
    assert quality.split_valid(merge.conform(p))[1].count() == 0 and quality.pair_errors(p).count() == 0


def page(*blocks):
    out = []
    for label, rows in blocks:
        out.append(f'<div><span class="x fg-heading">{label}</span></div>')
        for clock, n, score in rows:
            out.append(f'<span class="time-heading"> {clock} </span><tr class="r" data-match-href="/match/{n}.html">'
                       f"<td>England <b>(Dexter)</b></td><td>{score}</td><td>Belgium (Eric)</td></tr>")
    return "<html>" + "\n".join(out) + "</html>"


def test_html_page(spark):
    html = page(("FC26 R475(INTERNATIONAL)13.07.2026", [("23:55", 1, "2 - 0"), ("23:59", 2, "v"), ("23:59", 1, "5 - 5")]))
    p = fixtures_html.perspectives_from_pages(spark.createDataFrame([("a", html)], "page_id string, html string"))
    got = by(p, "perspective_id")
    d = got["eadriatic:1:dexter"]
    assert set(got) == {"eadriatic:1:dexter", "eadriatic:1:eric"}
    assert (d.timestamp, d.timestamp_utc, d.round, d.competition, d.group_key) == (
        "2026-07-13T23:55+02:00", "2026-07-13T21:55Z", "FC26 R475", "INTERNATIONAL", "eadriatic:fc26-r475-international:2026-07-13")
    assert (d.source_block_order, d.source_row_order, d.home_score, d.away_score) == (0, 0, 2, 0)
    assert quality.split_valid(merge.conform(p))[1].count() == 0
    assert fixtures_html.match_rows(spark.createDataFrame([("a", html)], "page_id string, html string")).count() == 1


def test_html_dates_are_recovered(spark):
    html = page(
        ("FC26 R1(A)12.07.2026", [("23:50", 1, "1 - 0")]),
        ("FC26 R2(A)12.07.2026", [("00:10", 2, "1 - 0")]),      # belongs to the 13th
        ("FC26 R3(A)13.07.202", [("01:00", 3, "1 - 0")]),       # year completed from the right
        ("FC26 R4(A)13.07.2026", [("20:00", 4, "1 - 0")]),
        ("FC26 R9(A)14.07.2026", [("00:10", 5, "1 - 0")]),      # not the following round
    )
    p = fixtures_html.page_matches(spark.createDataFrame([("a", html)], "page_id string, html string"))
    days = {r.native_match_id: r.group_key[-10:] for r in p.collect()}
    assert days == {"1": "2026-07-12", "2": "2026-07-13", "3": "2026-07-13", "4": "2026-07-13", "5": "2026-07-14"}


# --- reports --------------------------------------------------------------------------------

T1 = """ESTADÍSTICAS 2026-04-01

   player  W  D  L  played                       seq
   Bruno 7  2  1  0       3                       VEV
      Lio  0  1  2       3                       DED


VS RIVALES

Bruno 7
Lio: 3 (66.7%/33.3%/0.0%)

Lio
Bruno 7: 3 (0.0%/33.3%/66.7%)
"""
T3 = """ESTADÍSTICAS 2026-07-14

player         W   D   L played  stk seq
David          1   0   1      2    2 VD
Seoul          0   0   0      0    0 


VS RIVALES

David
Lio: 2 (50.0%/0.0%/50.0%) [VD]

Seoul

"""


def test_report_layouts(spark):
    df = spark.createDataFrame([("20260401_player_stats.txt", T1), ("20260714_player_stats.txt", T3)], "file_name string, text string")
    t = by(reports.daily_table(df), "date", "player")
    assert tuple(t["20260401", "Bruno 7"])[3:] == ("Bruno 7", 2, 1, 0, 3, "VEV")
    assert tuple(t["20260714", "David"])[3:] == ("David", 1, 0, 1, 2, "VD")
    assert tuple(t["20260714", "Seoul"])[3:] == ("Seoul", 0, 0, 0, 0, "")
    r = by(reports.daily_rival_table(df), "player")
    assert (r["Bruno 7"].wins, r["Bruno 7"].draws, r["Bruno 7"].losses, r["Bruno 7"].seq) == (2, 1, 0, "")
    assert (r["Lio"].wins, r["Lio"].draws, r["Lio"].losses) == (0, 1, 2) and r["David"].seq == "VD"
    assert [x.player for x in reports.listed_players(df).filter("date = '20260714'").orderBy("row_no").collect()] == ["David", "Seoul"]
    assert reports.latest_report(df).first().file_name == "20260714_player_stats.txt"
    assert tuple(reports.reports_metadata(df).first()) == (2, "20260401", "20260714")


# --- tracked list ---------------------------------------------------------------------------

TRACKED = ["GT|Álex", " gt | Fox* ", "GT|", "GT|fox", "GT|D", "GT|E", "GT|F", "", "EADRIATIC|Álex", "@COINCIDENT_SELECT||GT|Fox, eadriatic|ÁLEX", "@COINCIDENT_EXCLUDE||"]


def lines(spark, rows):
    return spark.createDataFrame([(i, r.strip()) for i, r in enumerate(rows)], "pos int, line string")


def test_tracked_list(spark):
    t = tracked.parse_tracked(lines(spark, TRACKED))
    got = by(t.filter("tracked"), "league", "player_key")
    assert set(got) == {("GT", "álex"), ("GT", "fox"), ("GT", "d"), ("GT", "e"), ("GT", "f"), ("EADRIATIC", "álex")}
    assert (got["GT", "fox"].player, got["GT", "fox"].bettable) == ("Fox", False)
    assert (got["GT", "d"].group_index, got["GT", "e"].group_index, got["EADRIATIC", "álex"].group_index) == (0, 1, 0)
    assert t.filter("empty_slot").count() == 1
    d = tracked.parse_directives(lines(spark, TRACKED)).collect()
    assert {tuple(r) for r in d} == {("selected", "GT", "fox"), ("selected", "EADRIATIC", "álex")}
    with pytest.raises(Exception, match="line 1"):
        tracked.parse_tracked(lines(spark, ["nobody"])).collect()
    with pytest.raises(Exception, match="directive"):
        tracked.parse_directives(lines(spark, ["@COINCIDENT_SELECT||nobody"])).collect()


def test_target_groups_count_slots_after_merging_and_restart_per_league(spark):
    t = tracked.parse_tracked(lines(spark, TRACKED))
    g = {}
    for r in target_groups(t).orderBy("slot").collect():
        g.setdefault((r.league, r.group_no), []).append(r.player)
    assert g == {("GT", 0): ["Álex", "Fox", "D", "E"], ("GT", 1): ["F"], ("EADRIATIC", 0): ["Álex"]}


def test_day_groups_are_closed_and_greedy(spark):
    edges = [("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("E", "F")]
    rows = [("GT", "d", a, b) for x, y in edges for a, b in ((x, y), (y, x))]
    daily = spark.createDataFrame(rows, "league string, date string, player string, rival string")
    order = spark.createDataFrame([("GT", "d", p, i) for i, p in enumerate("ABCDEFS")], "league string, date string, player string, row_no int")
    got = {}
    for r in day_groups(daily, order).collect():
        got.setdefault(r.group_seed, set()).add(r.member)
    # D's neighbourhood {C, D} is closed as well, D is not used by the first group.
    assert got == {"A": {"A", "B", "C"}, "D": {"C", "D"}, "E": {"E", "F"}, "S": {"S"}}


def test_counts_of_a_rival_line_are_those_of_its_sequence(spark):
    """One decimal of a percentage can't tell 1,388 wins of 2,777 from 1,389; the sequence can. A line without one has its percentages only."""
    from duelbook.sources import reports

    seq = "V" * 1388 + "E" * 700 + "D" * 689
    text = f"T\n\nVS RIVALES\n\nP1\nP2: 2777 (50.0%/25.2%/24.8%) [{seq}]\nP3: 7 (57.1%/0.0%/42.9%)\n"
    got = by(reports.daily_rival_table(spark.createDataFrame([("20260714_player_stats.txt", text)], "file_name string, text string")), "rival")
    assert [(got[r].wins, got[r].draws, got[r].losses) for r in ("P2", "P3")] == [(1388, 700, 689), (4, 0, 3)]


def test_rules_are_checked_once_a_row(spark, records):
    """Counting errors by rule must not check all rules again in the filter that the explosion brings."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = quality.error_counts(records(pair()))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("instants differ") == 1
