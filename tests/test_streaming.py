from datetime import timedelta

from conftest import HISTORY, START, row
from pyspark.sql import functions as F

from duelbook.sources.history import read_history, with_instant
from duelbook.streaming import ingest, windows


def folder(history, rows, path):
    history(rows).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(HISTORY).parquet(path)


def drain(df, scratch, name):
    out = f"{scratch}/{name}"
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_duplicates_are_dropped(spark, history, scratch):
    path = f"{scratch}/dup"
    folder(history, [row(1, "A", "B", "V"), row(2, "A", "B", "D")], path)
    folder(history, [row(1, "A", "B", "V")], path)
    assert drain(ingest.unique_perspectives(stream(spark, path)), scratch, "dup-out").count() == 2


def test_closed_sessions_match_the_batch(spark, history, scratch):
    path = f"{scratch}/sess"
    rows = [row(i, "A", "B", "V", m) for i, m in enumerate((0, 90, 181, 200))]
    flush = row(99, "Z", "Y", "V", START + timedelta(days=30))
    folder(history, rows + [flush], path)
    got = drain(windows.streaming_sessions(stream(spark, path)).drop("s"), scratch, "sess-out").orderBy("start").collect()
    assert [(r.player_key, r.played) for r in got] == [("a", 2), ("a", 2)]


def test_stream_merges_into_the_store_once(spark, history, scratch):
    path, out = f"{scratch}/in", f"{scratch}/merged"
    full = history([row(1, "A", "B", "V"), row(1, "B", "A", "D")])
    full.write.parquet(path)
    src = stream(spark, path)
    for attempt in ("c1", "c2"):  # the second query replays the same input
        ingest.merge_into(src, out, f"{scratch}/stage-{attempt}", f"{scratch}/{attempt}").awaitTermination()
        assert sorted(r.perspective_id for r in read_history(spark, out).collect()) == ["gt:1:a", "gt:1:b"]


def test_stream_repair_moves_a_row_to_the_right_day(spark, history, scratch):
    path, out = f"{scratch}/repair-in", f"{scratch}/repair-store"
    stamp = lambda df: df.withColumns({"timestamp": F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00")),
                                       "timestamp_utc": F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))})
    wrong = stamp(history([row(1, "A", "B", "V", START)])).drop("ts")
    right = stamp(history([row(1, "A", "B", "V", START + timedelta(days=1))])).drop("ts")
    wrong.write.parquet(path)
    read = lambda p: with_instant(spark.readStream.schema(wrong.schema).parquet(p))
    ingest.merge_into(read(path), out, f"{scratch}/s1", f"{scratch}/r1").awaitTermination()
    right.write.parquet(path + "2")
    ingest.repair_from(read(path + "2"), "2026-07-14", out, f"{scratch}/s2", f"{scratch}/r2").awaitTermination()
    got = read_history(spark, out).collect()
    assert [(r.perspective_id, r.ts) for r in got] == [("gt:1:a", START + timedelta(days=1))]


class FakeState:
    """A processor's handle and states in memory, counting the rows that are read."""

    def __init__(self):
        self.slices, self.value, self.timers, self.read = {}, None, set(), 0

    def getMapState(self, name, key, value):
        return self

    def getValueState(self, name, schema):
        return self

    def containsKey(self, key):
        return key in self.slices

    def getValue(self, key):
        self.read += len(self.slices[key][0])
        return self.slices[key]

    def updateValue(self, key, value):
        self.slices[key] = value

    def removeKey(self, key):
        del self.slices[key]

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)


class FakeTimer:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_a_timer_reads_its_own_slice_only():
    """A hundred thousand waiting rows of one player: every row is read about once, whatever waits beside it."""
    import random

    import pandas as pd

    from duelbook.streaming import stateful

    rng = random.Random(3)
    n = 100_000
    rows = [(i * 1_700_000, f"m{i:06d}", f"p{i}", rng.choice("VED")) for i in range(n)]
    state, p = FakeState(), stateful.RunningStreak()
    p.init(state)
    mixed = rows[:]
    rng.shuffle(mixed)
    columns = ["at", "match_id", "perspective_id", "result"]
    for part in (mixed[:n // 2], mixed[n // 2:]):
        assert not list(p.handleInputRows(("GT", "a"), iter([pd.DataFrame(part, columns=columns)]), None))
    assert len(state.timers) == len(state.slices) > 2000
    out = [r for at in sorted(state.timers) for f in p.handleExpiredTimer(("GT", "a"), None, FakeTimer(at)) for r in f.itertuples(index=False)]
    assert [r.match_id for r in out] == [r[1] for r in rows] and out[-1].played == n and not state.slices
    assert state.read < 2 * n
    text = "".join(r[3] for r in rows)
    assert all(out[i].last_24 == text[max(0, i - 23):i + 1] for i in range(0, n, 997))


def test_the_store_is_read_by_index(spark, history, scratch):
    """An update by few ids reads their buckets and the days they lie on, and no others."""
    from duelbook.operators.merge import conform
    from duelbook.sources import store_index
    from duelbook.sources.history import touched_rows, update_history, write_history

    path = f"{scratch}/indexed"
    rows = [row(i, "A", "B", "V", START + timedelta(days=i % 30)) for i in range(300)]
    write_history(conform(history(rows)), path)
    store_index.rebuild(spark, path)
    new = conform(history([row(7, "A", "B", "V", START + timedelta(days=3))]))  # stored on another day
    found = store_index.read(spark, path, new)
    def pruned_by(df, column):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return column in plan.split("PartitionFilters: [")[1].split("]")[0]

    assert found.select("bucket").distinct().count() == 1 and pruned_by(found, "bucket")
    days = store_index.days(spark, path, new).unionByName(new.select("league", F.col("ts").cast("date").alias("match_date")))
    touched = store_index.on_days(spark.read.parquet(path), days)
    assert {r.match_date for r in touched.collect()} == {(START + timedelta(days=d)).date() for d in (3, 7)} and pruned_by(touched, "match_date")
    assert touched_rows(spark, path, new).count() == 20
    update_history(spark, path, new, f"{scratch}/indexed-staging")
    assert sorted(r.perspective_id for r in read_history(spark, path).collect()) == sorted(r[2] for r in rows)
    index = spark.read.parquet(store_index.folder(path))
    assert index.count() == 300 and index.where("perspective_id = 'gt:7:a'").first().match_date == (START + timedelta(days=7)).date()
    moved = conform(history([row(999, "C", "D", "D", START + timedelta(days=40))]))
    update_history(spark, path, moved, f"{scratch}/indexed-staging2")
    assert spark.read.parquet(store_index.folder(path)).count() == 301


def test_panes_give_every_window(spark, history, scratch):
    path = f"{scratch}/panes"
    rows = [row(i, "AB"[i % 2], "C", "VED"[i % 3], i * 37) for i in range(60)]
    flush = row(999, "Z", "Y", "V", START + timedelta(days=30))
    folder(history, [*rows, flush], path)
    got = drain(windows.sliding_snapshot(stream(spark, path), 2, 30).select("player_key", F.col("window.start").alias("s"), "played", "wins", "draws", "losses"), scratch, "panes-out")
    want = {}
    for r in rows:
        at = r[8] - timedelta(minutes=r[8].minute % 30)
        for k in range(4):
            key = (r[4], at - timedelta(minutes=30 * k))
            n = want.setdefault(key, [0, 0, 0, 0])
            n[0] += 1
            n[1 + "VED".index(r[7])] += 1
    assert {(r.player_key, r.s): [r.played, r.wins, r.draws, r.losses] for r in got.collect()} == want


def test_slices_of_the_streams_are_hours():
    """The streams' processors wait by the hour, and the batches of a key are put together: a timer an hour, a write a slice."""
    import pandas as pd

    from duelbook.streaming import stateful

    n = 20_000
    rows = pd.DataFrame([(i * 7_000_000, f"m{i:06d}", f"p{i}", "VED"[i % 3]) for i in range(n)], columns=["at", "match_id", "perspective_id", "result"])
    state, p = FakeState(), stateful.RunningStreak(stateful.HOUR)
    p.init(state)
    assert not list(p.handleInputRows(("GT", "a"), iter([rows.iloc[i::10] for i in range(10)]), None))
    assert len(state.timers) == len(state.slices) == 39 and not state.read
    out = [r for at in sorted(state.timers) for f in p.handleExpiredTimer(("GT", "a"), None, FakeTimer(at)) for r in f.itertuples(index=False)]
    assert [r.match_id for r in out] == rows["match_id"].tolist() and out[-1].played == n and state.read == n


def walked(timeline, gap):
    """(a_at, a_match_id, b_at, b_match_id) of (at, side, match_id) rows, one at a time."""
    waiting, found = ([], []), []
    for r in sorted(timeline):
        other = waiting[1 - r[1]]
        if other and r[0] - other[-1][0] <= gap:
            a, b = sorted((r, other.pop()), key=lambda x: x[1])
            found.append((a[0], a[2], b[0], b[2]))
        else:
            waiting[r[1]].append(r)
    return found


def test_pairs_get_packed_hours(monkeypatch):
    """Hours in batches: the pairs of a walk, one state write a batch at most, and no hour unpacked that has nothing near it on the other side."""
    import random

    import pandas as pd

    from duelbook.streaming import stateful

    rng, hour, minute = random.Random(11), stateful.HOUR, 60_000_000
    for busy in (range(0, 60), range(40, 45)):  # the hours in which the second side plays
        timeline = [(rng.randrange(60 * 60) * minute, 0, f"a{i:04d}") for i in range(900)]
        timeline += [(rng.choice(busy) * hour + rng.randrange(60) * minute, 1, f"b{i:04d}") for i in range(600)]
        state, p, opened, writes = FakeState(), stateful.RunningPairs(30), [], []
        monkeypatch.setattr(state, "update", lambda v, s=state: (writes.append(1), setattr(s, "value", v)))
        monkeypatch.setattr(state, "clear", lambda s=state: setattr(s, "value", None), raising=False)
        unpack = stateful.unpack
        with monkeypatch.context() as m:
            m.setattr(stateful, "unpack", lambda packed: opened.append(1) or unpack(packed))
            p.init(state)
            got = []
            for batch in (range(0, 7), range(7, 30), range(30, 60)):
                rows = []
                for h in batch:
                    for side in (0, 1):
                        part = sorted((at, mid, "V") for at, s, mid in timeline if s == side and at // hour == h)
                        if part:
                            rows.append((side, h * hour, stateful.pack(part)))
                rng.shuffle(rows)
                frame = pd.DataFrame(rows, columns=["side", "hour", "packed"])
                for f in p.handleInputRows(("x",), iter([frame.iloc[::2], frame.iloc[1::2]]), None):
                    got += [(r.a_at, r.a_match_id, r.b_at, r.b_match_id) for r in f.itertuples(index=False)]
        assert got == walked(timeline, 30 * minute) and len(got) > 50 and len(writes) <= 3
        assert len(busy) == 60 or len(opened) < 25


def test_running_pairs_over_several_batches(spark, history, scratch):
    """A file a batch, ties and rows on hour borders, a player who never plays."""
    import random

    from duelbook.plans import stream_queries
    from duelbook.streaming import stateful

    rng, path, rows = random.Random(4), f"{scratch}/pairs-in", []
    for day in range(0, 12, 3):
        part = [row(1000 * day + i, "ABC"[i % 3], "Z", "VED"[i % 3], 24 * 60 * day + 15 * rng.randrange(24)) for i in range(60)]
        folder(history, part, path)
        rows += part
    folder(history, [row(99_999, "Q", "Z", "V", START + timedelta(days=90))], path)
    names = "league_a string, key_a string, league_b string, key_b string"
    pairs = spark.createDataFrame([("GT", "a", "GT", "b"), ("GT", "b", "GT", "c"), ("GT", "a", "GT", "nobody")], names)
    source = spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", 1).parquet(path)
    found = stream_queries._with_rocksdb(spark, lambda: drain(stateful.running_pairs(source, pairs), scratch, "pairs-out")).collect()

    def micros(at):
        return (at - START.replace(year=1970, month=1, day=1, hour=0)) // timedelta(microseconds=1)

    for a, b in (("a", "b"), ("b", "c"), ("a", "nobody")):
        timeline = [(micros(r[8]), side, r[1]) for side, key in enumerate((a, b)) for r in rows if r[4] == key]
        got = [(r.a_at, r.a_match_id, r.b_at, r.b_match_id) for r in found if r.pair_id == f"GT|{a}|GT|{b}"]
        assert sorted(got) == sorted(walked(timeline, 30 * 60_000_000)) and (got or b == "nobody")
