import os
import sys
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duelbook.plans.runtime import prepare  # noqa: E402

HISTORY = ("league string, match_id string, perspective_id string, player string, player_key string, rival string, "
           "rival_key string, result string, ts timestamp_ntz")


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="duelbook-tests-", dir="/tmp")


START = datetime(2026, 7, 14, 8, 0)


def row(n, player, rival, result, at=None, league="GT"):
    """A light perspective: ``at`` is minutes after the start or a datetime."""
    at = START + timedelta(minutes=n if at is None else at) if not isinstance(at, datetime) else at
    mid = f"{league.lower()}:{n}"
    return (league, mid, f"{mid}:{player.lower()}", player, player.lower(), rival, rival.lower(), result, at)


@pytest.fixture(scope="session")
def history(spark):
    return lambda rows: spark.createDataFrame(rows, HISTORY)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
