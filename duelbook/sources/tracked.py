"""Tracked-player list and pairing directives (SRC14, SRC15).

The list is one hand-written text file whose line order matters; it is read as one
document and exploded with line numbers, so order never depends on file splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelbook.functions.names import name_key
from duelbook.sources.paths import exists

GROUP_SIZE = 5
_DIRECTIVE = "@COINCIDENT_"
# Directive prefixes.
DIRECTIVES = {"selected": "@COINCIDENT_SELECT||", "excluded": "@COINCIDENT_EXCLUDE||"}


def list_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of the list file; no rows when it does not exist."""
    if not exists(spark, path):
        return spark.createDataFrame([], "pos int, line string")
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))


def _failing(cond, message: str):
    return F.when(cond, F.raise_error(F.concat(F.lit(f"{message} at line "), (F.col("pos") + 1).cast("string"))))


def parse_tracked(lines: DataFrame, group_size: int = GROUP_SIZE) -> DataFrame:
    """(league, pos, player, player_key, tracked, selected, bettable, empty_slot, group_index).

    ``LEAGUE|Name`` lines, a trailing ``*`` for tracked but not bettable, ``LEAGUE|`` for an
    empty slot that keeps its position.  Positions are counted per league before repeated
    names are merged (first spelling and position kept, bettable only if every mention is).
    """
    rows = lines.filter((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit(_DIRECTIVE)))
    cut = F.instr("line", "|")
    league = F.upper(F.trim(F.substring(F.col("line"), F.lit(1), cut - 1)))
    name = F.trim(F.substring(F.col("line"), cut + 1, F.length("line")))
    starred = F.endswith(name, F.lit("*"))
    rows = rows.select(
        "pos", F.coalesce(_failing(cut == 0, "tracked player needs LEAGUE|Name"), league).alias("league"),
        F.trim(F.when(starred, F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name)).alias("player"),
        (~starred).alias("bettable"),
    ).withColumn("league", F.coalesce(_failing(F.col("league") == "", "tracked player league is empty"), F.col("league")))
    w = Window.partitionBy("league").orderBy("pos")
    rows = rows.withColumn("group_index", F.floor((F.row_number().over(w) - 1) / group_size).cast("int"))
    rows = rows.withColumn("empty_slot", F.col("player") == "").withColumn(
        "player_key", F.when(F.col("empty_slot"), F.lit("")).otherwise(name_key("player")))
    # Empty slots are positions, not identities: they are never merged.
    merge_on = F.when(F.col("empty_slot"), F.col("pos")).otherwise(F.lit(-1))
    g = rows.groupBy("league", "player_key", merge_on.alias("_slot")).agg(
        F.min("pos").alias("pos"), F.min_by("player", "pos").alias("player"), F.min("bettable").alias("bettable"),
        F.min_by("group_index", "pos").alias("group_index"), F.min("empty_slot").alias("empty_slot"))
    return g.select(
        "league", "pos", "player", "player_key", (~F.col("empty_slot")).alias("tracked"), F.lit(False).alias("selected"),
        (F.col("bettable") & ~F.col("empty_slot")).alias("bettable"), "empty_slot", "group_index")


def load_tracked(spark: SparkSession, path: str) -> DataFrame:
    return parse_tracked(list_lines(spark, path))


def parse_directives(lines: DataFrame) -> DataFrame:
    """(kind, league, player_key): identities named by the select and exclude directives."""
    kind = F.lit(None).cast("string")
    payload = F.lit(None).cast("string")
    for k, prefix in DIRECTIVES.items():
        here = F.startswith(F.col("line"), F.lit(prefix))
        kind = F.when(here, F.lit(k)).otherwise(kind)
        payload = F.when(here, F.substring(F.col("line"), F.lit(len(prefix) + 1), F.length("line"))).otherwise(payload)
    items = lines.select("pos", kind.alias("kind"), F.explode(F.split(payload, ",")).alias("item")).filter(
        "kind is not null and trim(item) <> ''")
    league = F.upper(F.trim(F.split_part("item", F.lit("|"), F.lit(1))))
    name = F.trim(F.regexp_extract("item", r"\|(.*)$", 1))
    bad = ~F.contains(F.col("item"), F.lit("|")) | (league == "") | (name == "")
    return items.select(
        "kind", F.coalesce(_failing(bad, "invalid coincident directive"), league).alias("league"), name.alias("player")
    ).withColumn("player_key", name_key("player")).select("kind", "league", "player_key").distinct()


def load_directives(spark: SparkSession, path: str) -> DataFrame:
    return parse_directives(list_lines(spark, path))
