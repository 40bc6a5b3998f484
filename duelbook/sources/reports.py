"""Daily text reports: reading the three layouts and writing them (SRC5-SRC10, SNK4).

A report is one small document (file_name, text).  Lines are exploded with their position
inside the row and headers are carried within it, so reading needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.functions.results import DRAW, WIN, count_in
from duelbook.operators.daily import rival_line

TITLE = "ESTADÍSTICAS"
RIVALS = "VS RIVALES"
# Line shapes. The stk column is present in newer layouts only.
_ROW_STK = r"^\s*(.+?)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)(?:\s+([VED]+))?\s*$"
_ROW_PLAIN = r"^\s*(.+?)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)(?:\s+([VED]+))?\s*$"
_RIVAL = r"^(.*?):\s+(\d+)\s+\(([\d.]+)%/([\d.]+)%/([\d.]+)%\)(?:\s+\[([VED]*)\])?$"
_STAMP = r"^(\d{8})"
_TITLE_START = r"(?md)^(?=[^:\n]*[^\s:][^:\n]*$)"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of every report below a path or glob."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def report_date(file_name: Column) -> Column:
    """The date named by the file, ``yyyyMMdd``; the heading inside is not reliable."""
    return F.nullif(F.regexp_extract(file_name, _STAMP, 1), F.lit(""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda line: F.rtrim(line))


def _is_header(line: Column) -> Column:
    return F.contains(line, F.lit("player")) & F.contains(line, F.lit("played")) & F.contains(line, F.lit("seq"))


def daily_table(reports: DataFrame) -> DataFrame:
    """(file_name, date, row_no, player, wins, draws, losses, played, seq): summary rows (SRC5-SRC7).

    The header decides whether a streak column precedes the sequence; a player without
    matches has an empty one.
    """
    lines = _lines(F.col("text"))
    r = reports.select("*", lines.alias("_l"))
    heads = F.filter(F.transform("_l", lambda x, i: F.when(_is_header(x), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform("_l", lambda x, i: F.when(F.startswith(x, F.lit(RIVALS)), i)), lambda i: i.isNotNull())
    r = r.withColumns({"_h": F.get(heads, F.lit(0)), "_e": F.coalesce(F.get(ends, F.lit(0)), F.size("_l"))})
    r = r.filter("_h IS NOT NULL AND _e > _h").withColumn("_stk", F.array_contains(F.split(F.get("_l", F.col("_h")), r"\s+"), "stk"))
    keep = [c for c in reports.columns if c != "text"]
    rows = r.select(*keep, "_stk", F.posexplode(F.slice("_l", F.col("_h") + 2, F.col("_e") - F.col("_h") - 1)).alias("row_no", "line"))
    rows = rows.filter(F.when(F.col("_stk"), F.regexp_like("line", F.lit(_ROW_STK))).otherwise(F.regexp_like("line", F.lit(_ROW_PLAIN))))

    def group(i: int, stk_i: int | None = None) -> Column:
        return F.when(F.col("_stk"), F.regexp_extract("line", _ROW_STK, stk_i or i)).otherwise(F.regexp_extract("line", _ROW_PLAIN, i))

    return rows.select(
        *keep, report_date(F.col("file_name")).alias("date"), "row_no", F.trim(group(1)).alias("player"),
        *[group(i).cast("int").alias(n) for i, n in enumerate(("wins", "draws", "losses", "played"), 2)],
        group(6, 7).alias("seq"))


def daily_rival_table(reports: DataFrame) -> DataFrame:
    """(file_name, date, player, rival, wins, draws, losses, seq) of the rivals section (SRC8).

    Counts are those of the printed sequence; a line without one (older layouts) gives them by its percentages, losses as the
    remainder, which is exact up to 500 matches only, as one decimal can't tell more apart.
    """
    keep = [c for c in reports.columns if c != "text"]
    body = F.split_part(F.col("text"), F.lit(f"\n{RIVALS}"), F.lit(2))
    # Cut at the titles, the lines without a colon; what stands before the first one has no player.
    parts = reports.select(*keep, F.explode(F.split(body, _TITLE_START)).alias("part"))
    player = F.trim(F.regexp_extract("part", r"^([^:\r\n]*)(?:\r?\n|$)", 1))
    rows = parts.select(*keep, player.alias("player"), F.explode(_lines(F.col("part"))).alias("line")).filter("player <> ''").filter(F.contains("line", F.lit(":")))
    rows = rows.select(*keep, F.struct("player", "line").alias("x"))
    part = [F.regexp_extract("x.line", _RIVAL, i) for i in range(7)]
    rows = rows.filter(part[0] != "").select(
        *keep, report_date(F.col("file_name")).alias("date"), F.col("x.player").alias("player"), F.trim(part[1]).alias("rival"),
        part[2].cast("int").alias("n"), part[3].cast("double").alias("w"), part[4].cast("double").alias("d"), part[6].alias("seq"))
    printed = F.length("seq") == F.col("n")
    wins, draws = (F.when(printed, count_in(F.col("seq"), v).cast("int")).otherwise(F.bround(F.col("n") * F.col(c) / 100.0).cast("int"))
                   for c, v in (("w", WIN), ("d", DRAW)))
    return rows.select(*keep, "date", "player", "rival", wins.alias("wins"), draws.alias("draws"),
                       (F.col("n") - wins - draws).alias("losses"), "seq")


def listed_players(reports: DataFrame) -> DataFrame:
    """(file_name, date, player, row_no): players with a heading in the rivals section, in file order."""
    keep = [c for c in reports.columns if c != "text"]
    body = F.split_part(F.col("text"), F.lit(f"\n{RIVALS}"), F.lit(2))
    titles = F.filter(_lines(body), lambda x: ~F.contains(x, F.lit(":")) & (F.trim(x) != ""))
    return reports.select(*keep, report_date(F.col("file_name")).alias("date"), F.posexplode(titles).alias("row_no", "player")) \
        .withColumn("player", F.trim("player"))


def latest_report(reports: DataFrame) -> DataFrame:
    """The report with the newest date in its name (SRC9)."""
    return reports.orderBy(report_date(F.col("file_name")).desc_nulls_last(), "file_name").limit(1)


def reports_metadata(reports: DataFrame) -> DataFrame:
    """File count and first and last date (SRC10)."""
    day = report_date(F.col("file_name"))
    return reports.agg(F.count("*").alias("files_count"), F.min(day).alias("data_from"), F.max(day).alias("data_to"))


# --- writing -------------------------------------------------------------------

def render_reports(players: DataFrame, rivals: DataFrame) -> DataFrame:
    """(league, date, file_name, text): the daily report of every league and day (SNK4).

    One report lists each player and each pair of the day once: its size is set by how many
    different players meet in a day, not by the number of matches behind it.
    """
    width = F.rpad("player", 12, " ")
    width = F.when(F.length("player") > 12, F.col("player")).otherwise(width)
    row = F.concat(width, F.format_string(" %3d %3d %3d %6d %4d ", "wins", "draws", "losses", "played", "current_streak"), F.col("seq"))
    lines = rivals.groupBy("league", "date", "player").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("played")).alias("k"), "rival", rival_line().alias("line")))).alias("v"))
    lines = lines.select("league", "date", "player", F.array_join(F.transform("v", lambda x: x["line"]), "\n").alias("vs"))
    p = players.join(lines, ["league", "date", "player"], "left").groupBy("league", "date").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("played")).alias("k"), "player", row.alias("row"), F.coalesce("vs", F.lit("")).alias("vs")))).alias("v"))
    head = F.format_string("%-12s %3s %3s %3s %6s %4s seq", *map(F.lit, ("player", "W", "D", "L", "played", "stk")))
    text = F.concat(
        F.lit(f"{TITLE} "), F.col("date").cast("string"), F.lit("\n\n"), head, F.lit("\n"),
        F.array_join(F.transform("v", lambda x: F.concat(x["row"], F.lit("\n"))), ""), F.lit(f"\n\n{RIVALS}\n"),
        F.array_join(F.transform("v", lambda x: F.concat(F.lit("\n"), x["player"], F.lit("\n"), x["vs"], F.lit("\n"))), ""))
    infix = F.when(F.col("league") == "GT", F.lit("")).otherwise(F.concat(F.lower("league"), F.lit("_")))
    name = F.concat(F.date_format("date", "yyyyMMdd"), F.lit("_"), infix, F.lit("player_stats.txt"))
    return p.select("league", "date", name.alias("file_name"), text.alias("text"))


def write_reports(rendered: DataFrame, path: str) -> None:
    """One text file per league and day, below ``league=.../report=<file name>``."""
    rendered.select("league", F.col("file_name").alias("report"), F.col("text").alias("value")).write.mode("overwrite") \
        .partitionBy("league", "report").text(path)
