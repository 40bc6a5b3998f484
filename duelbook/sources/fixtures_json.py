"""Raw JSON fixtures to perspectives (SRC11, AGG12, SC6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.functions.binding import select_once
from duelbook.functions.names import clean_name, name_key, perspective_id
from duelbook.functions.results import home_result, mirrored
from duelbook.functions.times import parse_kickoff
from duelbook.operators.merge import first_per_key
from duelbook.schemas import FIXTURE_SCHEMA

LEAGUE, SOURCE_TYPE = "GT", "gt_api"


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Landed fixture objects; ``source_file`` and ``source_order`` come from the file.

    The order is the file, the block of the file, and the row: a task reads a block from its start on, so row numbers rise
    with the lines of a block, however the files are dealt to tasks.
    """
    return spark.read.schema(FIXTURE_SCHEMA).json(path).select("*", F.col("_metadata.file_name").alias("source_file"), F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")).alias("source_order"))


def parse_fixtures(lines: DataFrame, column: str = "json") -> DataFrame:
    """The same from a text column holding one JSON object per row."""
    rest = [c for c in lines.columns if c != column]
    return select_once(lines, *rest, F.from_json(F.col(column), FIXTURE_SCHEMA).alias("_f")).select(*rest, "_f.*")


def _nickname(side: str) -> Column:
    first = F.get(F.filter("participants", lambda p: p["side"] == side), 0)
    return first["participant"]["player"]["nickname"]


def _score(name: str) -> Column:
    """A non-negative whole number; booleans and other text give NULL, fractions are cut off."""
    return F.regexp_extract(F.col(f"result.stats.{name}"), r"^\s*\+?(\d+)(?:\.\d*)?\s*$", 1).try_cast("int")


def perspectives_from_fixtures(fixtures: DataFrame, source_file: str | None = None, order=("source_order",)) -> DataFrame:
    """Two perspectives per valid fixture; the first copy of a match id wins in ``order``."""
    native = F.trim(F.col("id"))
    m = select_once(
        fixtures, native.alias("native_match_id"), F.concat(F.lit(f"{LEAGUE.lower()}:"), native).alias("match_id"),
        _nickname("home").alias("_h"), _nickname("away").alias("_a"),
        _score("home_score").alias("home_score"), _score("away_score").alias("away_score"),
        parse_kickoff(F.col("kickoff")).alias("k"),
        (F.col("source_file") if source_file is None else F.lit(source_file)).alias("source_file"), *order,
    ).filter("native_match_id <> '' AND home_score IS NOT NULL AND away_score IS NOT NULL AND k.ts IS NOT NULL")
    m = m.filter("trim(_h) <> '' AND trim(_a) <> ''")
    m = first_per_key(m, ["match_id"], list(order))
    return two_sides(m, LEAGUE, F.col("_h"), F.col("_a"), {
        "ts": F.col("k.ts"), "timestamp": F.col("k.timestamp"), "timestamp_utc": F.col("k.timestamp_utc"),
        "timestamp_precision": F.col("k.precision"), "timezone": F.col("k.zone"), "timezone_inferred": F.col("k.inferred"),
        "source_type": F.lit(SOURCE_TYPE), "source_file": F.col("source_file"),
        "data_quality": F.when(F.col("k.inferred"), F.lit("inferred")).otherwise(F.lit("complete")),
        "native_match_id": F.col("native_match_id"),
    })


def two_sides(matches: DataFrame, league: str, home: Column, away: Column, common: dict[str, Column]) -> DataFrame:
    """Explode matches into home and away perspectives sharing the ``common`` fields."""
    named = matches.withColumns({"_hn": clean_name(home), "_an": clean_name(away)}).filter("_hn IS NOT NULL AND _an IS NOT NULL")
    named = named.withColumns({"_hk": name_key("_hn"), "_ak": name_key("_an")})
    result = home_result(F.col("home_score"), F.col("away_score"))

    def side(p, pk, r, rk, where, res):
        return F.struct(F.col(p).alias("player"), F.col(pk).alias("player_key"), F.col(r).alias("rival"),
                        F.col(rk).alias("rival_key"), F.lit(where).alias("home_away"), res.alias("result"))

    sides = F.explode(F.array(side("_hn", "_hk", "_an", "_ak", "home", result),
                              side("_an", "_ak", "_hn", "_hk", "away", mirrored(result))))
    flat = named.select(F.lit(1).alias("schema_version"), F.lit(league).alias("league"), "match_id", "home_score", "away_score",
                        *[c.alias(n) for n, c in common.items()], sides.alias("s"))
    return flat.select(*[c for c in flat.columns if c != "s"], "s.*").withColumn(
        "perspective_id", perspective_id(F.col("match_id"), F.col("player_key")))
