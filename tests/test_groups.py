"""Relations of target groups of any number of results."""

import random
from datetime import timedelta

import pytest
from conftest import START, by, row
from pyspark.sql import functions as F

from duelbook.operators import alerts, daily, groups

TARGETS = [("GT", 0, 2, "A", 1), ("GT", 0, 2, "B", 2)]


@pytest.fixture()
def targets(spark):
    return spark.createDataFrame(TARGETS, "league string, group_no int, group_size int, player string, slot int")


def results(text, per_day=9):
    """Results of A against B, and mirrored, ``per_day`` on each day."""
    rows = []
    for i, r in enumerate(text):
        at = START + timedelta(days=i // per_day, minutes=i % per_day)
        rows += [row(i, "A", "B", r, at), row(i, "B", "A", {"V": "D", "D": "V", "E": "E"}[r], at)]
    return rows


def h2h_of(targets, df):
    return groups.group_h2h(targets, daily.daily_rivals(groups.among_targets(targets, df), F.col("ts").cast("date")))


def test_alerts_and_totals_carry_no_text(history, targets):
    rng = random.Random(3)
    text = "".join(rng.choice("VVVED") for _ in range(395))
    df = history(results(text))
    got = alerts.h2h_alerts(h2h_of(targets, df), groups.group_names(targets), df)
    assert [(r.player, r.last10, r.matches) for r in got.collect()] == [("A", text[-10:], 395)]
    assert not {"seq", "sequence_part"} & {*got.columns, *h2h_of(targets, df).columns} and h2h_of(targets, df).count() == 2
    months = sorted((r for r in groups.group_sequences(targets, df).collect() if r.player == "A"), key=lambda r: r.slice)
    assert "".join(r.seq for r in months) == text and len(months) == 2


@pytest.mark.parametrize("text", [
    "V" * 30 + "D" + "V" * 43,  # a run over several parts and days, broken within a day
    "D" * 60 + "VEV",  # the last day holds three results
    "VE" * 33 + "E",  # never beaten
    "V" * 45 + "D" * 18,  # broken at the very end
])
def test_the_end_of_a_relation_is_that_of_the_whole_sequence(history, targets, text):
    a = [r for r in h2h_of(targets, history(results(text))).collect() if r.player == "A"]
    want = (text[-5:], text[-10:], len(text) - len(text.rstrip("V")), len(text) - len(text.rstrip("VE")))
    assert a and all((r.last5, r.last10, r.win_run, r.unbeaten_run) == want for r in a)
