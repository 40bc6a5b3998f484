"""Reading and writing the match history (SRC1-SRC4, SRC16, SNK1, SNK2).

The working format is Parquet partitioned by league and match_date: league and time
filters prune files.  JSON lines are read for exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duelbook.functions.names import name_key
from duelbook.functions.times import event_time
from duelbook.operators import quality
from duelbook.operators.h2h import h2h_comparison
from duelbook.operators.merge import conform, id_hash, repeated, upsert, upsert_lone
from duelbook.operators.recent import player_windows, recent_forms
from duelbook.operators.totals import player_totals
from duelbook.schemas import HISTORY_SCHEMA
from duelbook.sources import store_index
from duelbook.sources.paths import exists

_CORRUPT = "_corrupt"


def with_instant(df: DataFrame) -> DataFrame:
    """Add ``ts`` (UTC) parsed from the stored stamps, and missing name keys."""
    out = df.withColumn("ts", event_time(F.col("timestamp_utc"), F.col("timestamp")))
    for name in ("player", "rival"):
        if f"{name}_key" not in out.columns:
            out = out.withColumn(f"{name}_key", name_key(name))
    return out


def _parsed_lines(spark: SparkSession, found: list[str]) -> DataFrame:
    """Lines of JSON files with what they hold: path, block (of the file), line, record; blank lines have none."""
    schema = StructType([*HISTORY_SCHEMA.fields, StructField(_CORRUPT, StringType())])
    lines = spark.read.text(found).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    record = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return lines.withColumn("record", F.when(F.trim("line") != "", record))


def _bad() -> Column:
    return F.col("record").isNotNull() & F.col(f"record.{_CORRUPT}").isNotNull()


def invalid_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line_no, line) of every malformed line of the existing paths, folders included, in one pass.

    A task reads a block of a file in order, so a line's number is its distance from the block's first line plus the lines of the
    blocks before, which are counted along the way: a row per block.
    """
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "path string, line_no long, line string")
    rows = _parsed_lines(spark, found).withColumn("at", F.monotonically_increasing_id())
    blocks = rows.groupBy("path", "block").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.collect_list(F.when(_bad(), F.struct("at", "line"))).alias("bad"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bad = blocks.withColumn("before", before).select("path", "before", "first", F.explode("bad").alias("x"))
    return bad.select("path", (F.col("before") + F.col("x.at") - F.col("first") + 1).alias("line_no"), "x.line")


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """History lines of the existing paths.  Blank lines are skipped; a malformed line fails
    the query, naming its file; ``invalid_lines`` has the line numbers."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return with_instant(spark.createDataFrame([], HISTORY_SCHEMA))
    message = F.concat(F.lit("invalid JSON record in "), F.col("path"), F.lit(": "), F.substring("line", 1, 200))
    rows = _parsed_lines(spark, found).filter("record IS NOT NULL")
    guarded = rows.select(F.when(_bad(), F.raise_error(message)).otherwise(F.lit(True)).alias("_sound"), "record.*")
    return with_instant(guarded.filter("_sound").drop("_sound", _CORRUPT))


def read_validated_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """The same, failing at once with path and line number of a malformed line, and later on any record that breaks a validation rule."""
    first = invalid_lines(spark, *paths).orderBy("path", "line_no").limit(1).collect()
    if first:
        raise ValueError(f"invalid JSON record in {first[0]['path']} line {first[0]['line_no']}: {first[0]['line'][:200]}")
    return quality.require_valid(read_jsonl(spark, *paths))


def read_history(spark: SparkSession, path: str, league: str | None = None) -> DataFrame:
    """Partitioned Parquet history; a league reads only its own partitions."""
    if not exists(spark, path):
        return with_instant(spark.createDataFrame([], HISTORY_SCHEMA))
    df = spark.read.parquet(path).drop("match_date")
    return df if league is None else df.filter(F.col("league") == league.strip().upper())


def write_history(df: DataFrame, path: str, *, rows_per_file: int = 5_000_000) -> None:
    """Replace exactly the (league, match_date) partitions present in ``df``.

    Rows are rebalanced on the partition columns: AQE splits a partition value that holds
    very many rows over several tasks and merges small ones, so no file writer is hot.
    """
    out = df.withColumn("match_date", F.col("ts").cast("date")).hint("rebalance", "league", "match_date")
    (out.sortWithinPartitions("league", "match_date", "player_key", "ts", "match_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
        .partitionBy("league", "match_date").parquet(path))


def update_history(spark: SparkSession, path: str, new: DataFrame, staging: str) -> None:
    """Merge candidates into the stored history; running it twice changes nothing.

    The index beside the store says on which days the candidates' stored copies lie; only those days and the candidates' own are
    read and rewritten. The merged rows go to ``staging`` (a folder all executors see) first, because a Parquet
    table cannot be overwritten while it is being read.
    """
    if not exists(spark, path):
        write_history(staged_upsert(conform(read_history(spark, path)), new, staging), path)
        store_index.rebuild(spark, path)
        return
    days = touched_days(spark, path, new)
    ready = staged_upsert(conform(rows_of(spark, path, days)), new, staging)
    write_history(ready, path)
    store_index.refresh(spark, path, new, ready, days, f"{staging}/index")


def staged_upsert(existing: DataFrame, new: DataFrame, staging: str) -> DataFrame:
    """The rows of ``upsert``, written below ``staging``: field by field only for ids that a side has several times, else by a join."""
    spark = existing.sparkSession

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{staging}/{name}")
        return spark.read.schema(df.schema).parquet(f"{staging}/{name}")

    several = staged(repeated(existing, new), "repeated")
    if several.isEmpty():
        return staged(upsert_lone(existing, new), "rows")

    def part(df: DataFrame, how: str) -> DataFrame:
        return df.withColumn("_hash", id_hash()).join(several, "_hash", how).drop("_hash")

    lone = staged(upsert_lone(part(existing, "left_anti"), part(new, "left_anti")), "rows")
    return lone.unionByName(staged(upsert(part(existing, "left_semi"), part(new, "left_semi")), "mixed"))


def touched_days(spark: SparkSession, path: str, new: DataFrame) -> list[tuple]:
    """(league, match_date) of the days on which rows of ``new`` lie or their stored copies do: as many as the calendar has."""
    own = [tuple(r) for r in new.select("league", F.col("ts").cast("date").alias("match_date")).distinct().collect()]
    return own + store_index.other_days(spark, path, new, own)


def rows_of(spark: SparkSession, path: str, days: list[tuple]) -> DataFrame:
    """All stored rows of some days."""
    return spark.read.parquet(path).where(store_index.among(days)).drop("match_date")


def touched_rows(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """All stored rows of the days on which rows of ``new`` lie or their stored copies do."""
    return rows_of(spark, path, touched_days(spark, path, new))


def export_jsonl(df: DataFrame, path: str) -> None:
    """Time-ordered JSON lines, one object per perspective, absent fields left out."""
    df.orderBy("timestamp_utc", "league", "match_id", "player_key").drop("ts").write.mode("overwrite").json(path)


# --- load and compute ---------------------------------------------------------

def load_player_totals(spark: SparkSession, path: str, league: str | None = None) -> DataFrame:
    return player_totals(read_history(spark, path, league))


def load_player_windows(spark: SparkSession, path: str, windows=(5, 10, 20), league: str | None = None) -> DataFrame:
    return player_windows(read_history(spark, path, league), windows)


def load_h2h(spark: SparkSession, path: str, window: int = 20, league: str | None = None, **kwargs) -> DataFrame:
    return h2h_comparison(read_history(spark, path, league), window, **kwargs)


def load_recent_forms(spark: SparkSession, path: str, window: int, league: str | None = None, **kwargs) -> DataFrame:
    return recent_forms(read_history(spark, path, league), [window], **kwargs)
