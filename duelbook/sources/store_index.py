"""Where each perspective of a stored history lies: an index by id beside the partitioned store (SNK2, STR2, STR5).

The store is cut by league and day, but updates come by id. The index is a small table (perspective_id, league, match_date) in buckets of the
id's hash, each a partition of its own: an update reads the buckets of its ids and the days they point to, and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.sources.paths import exists

BUCKETS = 256


def folder(path: str) -> str:
    return f"{path.rstrip('/')}_index"


def bucket(perspective_id: Column) -> Column:
    return F.pmod(F.xxhash64(perspective_id), F.lit(BUCKETS)).cast("int")


def entries(rows: DataFrame) -> DataFrame:
    """The index rows of history rows (with ``ts``)."""
    return rows.select("perspective_id", "league", F.col("ts").cast("date").alias("match_date"), bucket(F.col("perspective_id")).alias("bucket"))


def _write(index: DataFrame, path: str) -> None:
    (index.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder(path)))


def rebuild(spark: SparkSession, path: str) -> None:
    """The index of a whole store, for one that has none yet."""
    _write(entries(spark.read.parquet(path)), path)


def buckets(ids: DataFrame) -> list[int]:
    """The buckets that ``ids`` (perspective_id) fall into."""
    return [r[0] for r in ids.select(bucket(F.col("perspective_id"))).distinct().collect()]  # BUCKETS numbers at most


def read(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The index rows of the buckets that ``ids`` (perspective_id) fall into."""
    if not exists(spark, folder(path)):
        rebuild(spark, path)
    return spark.read.parquet(folder(path)).where(F.col("bucket").isin(buckets(ids)))


def days(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(league, match_date) of the days on which ``ids`` are stored."""
    return read(spark, path, ids).join(ids.select("perspective_id").distinct(), "perspective_id", "left_semi").select("league", "match_date").distinct()


def other_days(spark: SparkSession, path: str, ids: DataFrame, own: list[tuple]) -> list[tuple]:
    """(league, match_date) of the days besides ``own`` on which ``ids`` are stored; what lies on ``own`` days is not looked at.

    A store that has no index yet is looked through itself.
    """
    index = read(spark, path, ids) if exists(spark, folder(path)) else spark.read.parquet(path)
    rest = index.where(~among(own)).select("perspective_id", "league", "match_date")
    if rest.isEmpty():
        return []
    found = rest.join(ids.select("perspective_id").distinct(), "perspective_id", "left_semi")
    return [tuple(r) for r in found.select("league", "match_date").distinct().collect()]  # as many as the calendar has days


def among(wanted: list[tuple]) -> Column:
    """Whether (league, match_date) is one of some days, never null: a filter that prunes a scan of the store to their folders."""
    by_league: dict = {}
    for league, date in wanted:
        by_league.setdefault(league, []).append(date)
    cond = F.lit(False)
    for league, dates in by_league.items():
        known = F.coalesce(F.col("match_date").isin([d for d in dates if d is not None]), F.lit(False))
        on = known | F.col("match_date").isNull() if None in dates else known
        cond = cond | (F.col("league").eqNullSafe(F.lit(league)) & on)
    return cond


def on_days(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored rows of some days (league, match_date)."""
    return stored.where(among([tuple(r) for r in wanted.distinct().collect()]))  # as many as the calendar has days


def refresh(spark: SparkSession, path: str, ids: DataFrame, rows: DataFrame, touched: list[tuple], staging: str) -> None:
    """Set the entries of ``ids`` to where they lie now. ``rows`` are all rows that the ``touched`` days held or hold, as written.

    An id lay on touched days only, so in its bucket the entries of these days make way for those of ``rows``; none is looked up.
    Running it twice changes nothing.
    """
    if not exists(spark, folder(path)):
        rebuild(spark, path)
        return
    wanted = F.col("bucket").isin(buckets(ids))
    old, new = spark.read.parquet(folder(path)).where(wanted & ~among(touched)), entries(rows).where(wanted)
    old.select(*new.columns).unionByName(new).write.mode("overwrite").parquet(staging)
    _write(spark.read.schema(new.schema).parquet(staging), path)
