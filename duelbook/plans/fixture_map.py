"""The given tables read as match histories (FIXTURES.md part B)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.functions.names import perspective_id
from duelbook.functions.results import home_result, mirrored
from duelbook.operators.merge import first_per_key

REFERENCE_TIME = datetime(2024, 1, 15, 20, 0, 0)


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with two different sides; match ids repeat."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    league = F.when(F.col("l_returnflag") == "R", F.lit("EADRIATIC")).otherwise(F.lit("GT"))
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    home, away = _sides()
    named = li.select("*", league.alias("league"), number.alias("match_no"))
    return named.select(
        "league", _match_id().alias("match_id"), "match_no", home.alias("home_no"), away.alias("away_no"), *_scores(),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    ).filter("home_no <> away_no")


def _match_id() -> Column:
    return F.concat(F.lower("league"), F.lit(":"), F.col("match_no").cast("string"))


def _sides() -> tuple[Column, Column]:
    """Numbers of the home and the away player."""
    return F.col("l_suppkey") % 40, F.col("l_partkey") % 40


def _scores() -> list[Column]:
    return [(F.floor(c).cast("int") % 4).alias(side) for side, c in (("home_score", "l_quantity"), ("away_score", "l_extendedprice"))]


FIRST_WINS = ("ts", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct matches: the first row of each match id in source order.

    The id is the league and the number, so these are the key; what follows from the source columns is made afterwards.
    """
    kept = first_per_key(raw_matches(spark, sf_dir).select("match_no", "league", *FIRST_WINS), ["match_no", "league"], FIRST_WINS)
    return described(kept)


def described(rows: DataFrame, *carry: str) -> DataFrame:
    """Match rows with number, league and source columns, with what follows from these."""
    return rows.select(
        "league", _match_id().alias("match_id"), "match_no", "ts", *carry, *_scores(),
        *[F.concat(F.lit("P"), no.cast("string")).alias(side) for side, no in zip(("home", "away"), _sides())],
    )


def as_perspectives(matches_df: DataFrame, *carry: str) -> DataFrame:
    """Two rows per match, one for each side; ``carry``: further columns of the match that both get."""
    home = home_result(F.col("home_score"), F.col("away_score"))
    sides = F.array(
        F.struct(F.col("home").alias("player"), F.col("away").alias("rival"),
                 F.lit("home").alias("home_away"), home.alias("result")),
        F.struct(F.col("away").alias("player"), F.col("home").alias("rival"),
                 F.lit("away").alias("home_away"), mirrored(home).alias("result")),
    )
    one = matches_df.withColumn("s", F.explode(sides))
    key = F.lower("s.player")
    return one.select(
        "league", "match_id", perspective_id(F.col("match_id"), key).alias("perspective_id"),
        "s.player", key.alias("player_key"), "s.rival", F.lower("s.rival").alias("rival_key"),
        "s.result", "ts", "s.home_away", "home_score", "away_score", *carry,
    )


def perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_perspectives(matches(spark, sf_dir))


def event_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_perspectives(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_as_perspectives(events: DataFrame) -> DataFrame:
    number = (F.col("user_id") % 12).cast("string")
    opponent = (F.floor(F.col("user_id") / 12) % 12).cast("string")
    result = (
        F.when(F.col("event_type").isin("purchase", "click"), F.lit("V"))
        .when(F.col("event_type") == "view", F.lit("E"))
        .otherwise(F.lit("D"))
    )
    match_id = F.concat(F.lit("gt:"), F.col("event_id").cast("string"))
    key = F.concat(F.lit("p"), number)
    return events.select(
        F.lit("GT").alias("league"), match_id.alias("match_id"),
        perspective_id(match_id, key).alias("perspective_id"),
        F.concat(F.lit("P"), number).alias("player"), key.alias("player_key"),
        F.concat(F.lit("P"), opponent).alias("rival"), F.concat(F.lit("p"), opponent).alias("rival_key"),
        result.alias("result"), F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


def tracked(spark: SparkSession, group_size: int = 5) -> DataFrame:
    """The tracked list of FIXTURES.md B3: P0..P39, first GT, then EADRIATIC."""
    n = F.col("id")
    leagues = F.explode(F.array(F.struct(F.lit("GT").alias("name"), F.lit(0).alias("first")),
                                F.struct(F.lit("EADRIATIC").alias("name"), F.lit(40).alias("first"))))
    return spark.range(40).select("id", leagues.alias("l")).select(
        F.col("l.name").alias("league"), (F.col("l.first") + n).alias("pos"),
        F.concat(F.lit("P"), n.cast("string")).alias("player"), F.concat(F.lit("p"), n.cast("string")).alias("player_key"),
        F.lit(True).alias("tracked"), F.lit(False).alias("selected"),
        (n % 7 != 3).alias("bettable"), F.floor(n / group_size).cast("int").alias("group_index"),
    )
