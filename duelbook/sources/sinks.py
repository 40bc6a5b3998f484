"""CSV tables, payload tables and nested JSON (SNK3, SNK5, SNK6, SRC17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelbook import schemas
from duelbook.operators.alerts import alert_order
from duelbook.operators import streak_tables as st

# Scope and version that readers of the payload check.
ANALYSIS_SCOPE = "historical TXT; h2h_alerts are operational JSONL-filtered"
PAYLOAD_VERSION = 2


def streak_reports(daily: DataFrame) -> dict[str, DataFrame]:
    """The nine tables of the streak analysis, in their report order."""
    return {
        "player_summary": st.player_summary(daily).orderBy(F.desc("draw_pct"), "player"),
        "daily_streaks": st.daily_streaks(daily).orderBy("date", "player"),
        "player_risk_analysis": st.player_risk(daily).orderBy("recommended_entry", "danger_days_pct", F.desc("draw_pct"), "player"),
        "streak_distribution_global": st.streak_distribution(daily).orderBy("streak"),
        "streak_distribution_by_day": st.streak_distribution_by_day(daily).orderBy("date", "streak"),
        "daily_streak_summary": st.daily_streak_summary(daily).orderBy("date"),
        "streak_records": st.streak_records(daily),
        "draw_records_lowest": st.draw_records(daily, lowest=True),
        "draw_records_highest": st.draw_records(daily, lowest=False),
    }


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_streak_reports(daily: DataFrame, path: str) -> None:
    for name, table in streak_reports(daily).items():
        write_csv(table, f"{path}/{name}")


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written table with its types; a value that doesn't fit its type fails the query."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def snapshot_payload(snap: DataFrame, leagues: tuple[str, ...] = ("GT", "EADRIATIC")) -> DataFrame:
    """(league, rows): snapshot rows as one sorted array per league, empty leagues included.

    A snapshot has one row per tracked player, so the array is as long as the list.
    """
    key = F.struct((-F.col("wins")).alias("w"), (-F.col("win_pct")).alias("p"), (-F.col("played")).alias("n"),
                   F.lower("player").alias("k"), F.struct(*schemas.SNAPSHOT).alias("row"))
    g = snap.groupBy("league").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["row"]).alias("rows"))
    base = snap.sparkSession.createDataFrame([(x,) for x in leagues], "league string")
    return base.join(g, "league", "full_outer")


def groups_payload(names: DataFrame, h2h: DataFrame, power: DataFrame, dominance: DataFrame, ranking: DataFrame,
                   picks: DataFrame, matchups: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """One nested row per target group, ready for ``to_json`` (SNK5).

    Every array holds group members or pairs of members: at most a few per list block.
    """
    key = ["league", "group_no"]

    def nested(df: DataFrame, order: list[str], columns: list[str], name: str, extra: list[str] | None = None) -> DataFrame:
        by = key + (extra or [])
        rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("r"))))
        return df.groupBy(*by).agg(F.transform(rows, lambda x: x["r"]).alias(name))

    cell = ["rival", "wins", "draws", "losses", "matches", "win_pct", "draw_pct", "loss_pct",
            "last5", "last10", "win_run", "unbeaten_run"]
    matrix = nested(nested(h2h, ["rival"], cell, "rivals", ["player"]), ["player"], ["player", "rivals"], "h2h_matrix")
    up = nested(matchups, ["place"], ["rival", "win_pct", "matches"], "matchups", ["side"])
    bets = nested(picks.join(up, key + ["side"], "left"), ["side"], ["side", "player", "score", "matches", "weighted_score", "matchups"], "betting")
    per_kind = nested(totals, ["player"], ["player", "wins", "draws", "losses", "win_pct", "loss_pct"], "totals", ["kind"])
    parts = [
        counts.select(*key, "exact_matches", "near_matches"),
        nested(power, ["position"], ["position", "player", "score"], "power_ranking"),
        nested(dominance, ["player"], ["player", "wins", "rivals"], "dominance"),
        nested(ranking, ["position"], ["player", "score", "matches", "weighted_score"], "h2h_ranking"),
        bets, nested(per_kind, ["kind"], ["kind", "totals"], "overlap_totals"), matrix,
    ]
    out = names
    for p in parts:
        out = out.join(p, key, "left")
    return out


def payload_tables(names: DataFrame, h2h: DataFrame, power: DataFrame, dominance: DataFrame, ranking: DataFrame, picks: DataFrame, matchups: DataFrame,
                   counts: DataFrame, totals: DataFrame, alerts: DataFrame, metadata: DataFrame) -> dict[str, DataFrame]:
    """The payload as flat tables with their league: what the nested document holds, a row per item and none that grows with a league.

    ``metadata``: league, files_count, data_from, data_to. Alerts and rankings carry their place in presentation order.
    """
    key = ["league", "group_no"]
    order = Window.partitionBy("league").orderBy(*alert_order(), "group_id")
    about = [F.lit(PAYLOAD_VERSION).alias("schema_version"), F.lit(ANALYSIS_SCOPE).alias("analysis_scope"),
             F.lit(48).alias("h2h_alert_threshold"), F.lit(20).alias("min_h2h_alert_matches")]
    return {
        "metadata": metadata.select("*", *about),
        "groups": names.join(counts.select(*key, "exact_matches", "near_matches"), key, "left"),
        "cells": h2h.select(*key, "player", "rival", "wins", "draws", "losses", "matches", "win_pct", "draw_pct", "loss_pct", "last5", "last10", "win_run", "unbeaten_run"),
        "power_ranking": power, "dominance": dominance, "h2h_ranking": ranking, "betting": picks, "matchups": matchups, "overlap_totals": totals,
        "alerts": alerts.withColumn("position", F.row_number().over(order)),
    }


def write_payload(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines below ``<table>/league=...``; a large league is written by several tasks."""
    for name, table in tables.items():
        table.hint("rebalance", "league").write.mode("overwrite").partitionBy("league").json(f"{path}/{name}")


def read_payload(spark: SparkSession, path: str, table: str, schema=None) -> DataFrame:
    """A table of a written payload; with the schema it was written with, types are not guessed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{path}/{table}")
