"""Shrinkage-weighted match-up estimates inside tracked groups (AGG27, JN6, SRT6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook import schemas
from duelbook.functions.params import number_between
from duelbook.functions.results import LOSS, WIN, count_of, pct2, shrunk
from duelbook.operators import filters
from duelbook.operators.runs import ORDER, last_n, latest_first
from duelbook.operators.totals import KEYS

FORM_WINDOW = 24
H2H_WINDOW = 20
MIN_ESTIMATE = 65.0
# Fictitious matches and weight of each component.
PRIORS = {"h2h": 12, "recent_h2h": 6, "form": 8, "overall": 40}
WEIGHTS = {"h2h": 0.40, "recent_h2h": 0.25, "form": 0.25, "overall": 0.10}
CONFIDENCE_ORDER = ("HIGH", "MEDIUM", "LOW")
RELATION = ["league", "player_key", "rival_key"]


def group_pairs(tracked: DataFrame) -> DataFrame:
    """Unordered pairs of bettable players in the same positional group.

    A group is one block of list positions (five by default), so the member list built
    per group is as small as the block, whatever the size of the history.
    """
    members = tracked.filter(F.col("tracked") & F.coalesce("bettable", F.lit(True)) & (F.trim("player_key") != ""))
    members = members.groupBy(*KEYS, "group_index").agg(F.min_by(F.trim("player"), "pos").alias("player"))
    order = F.array_sort(F.collect_list(F.struct(F.lower("player").alias("k"), "player_key", "player")))
    g = members.groupBy("league", "group_index").agg(order.alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(
        F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return g.select("league", "group_index", F.explode(pairs).alias("p")).select(
        "league", "group_index", F.col("p.a.player").alias("player_a"), F.col("p.a.player_key").alias("key_a"),
        F.col("p.b.player").alias("player_b"), F.col("p.b.player_key").alias("key_b"))


def evidence(rows: DataFrame) -> DataFrame:
    """(league, player_key, whole, other) with wins and losses of all matches and of the late ones, in two passes over the rows.

    ``whole`` rows are a player's: overall, and the form of the last FORM_WINDOW matches; the others are a relation's to ``other``: all, and the
    last H2H_WINDOW. Relation sums give the players' sums. A player's late matches are among the late ones of their relations,
    which Spark limits per map task, so ranking a player sees few rows however long the history is.
    """
    c = F.col
    sums = [F.count("*").alias("n"), count_of(WIN).alias("w"), count_of(LOSS).alias("l")]
    levels = F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit("").alias("other")), F.struct(F.lit(False).alias("whole"), c("rival_key").alias("other"))))
    every = rows.groupBy(*RELATION).agg(*sums).select(*KEYS, levels.alias("x"), "n", "w", "l").select(
        *KEYS, "x.*", *[c(m).alias(f"all_{m}") for m in "nwl"], *[F.lit(0).cast("long").alias(f"late_{m}") for m in "nwl"])
    late = last_n(rows.select(*RELATION, *ORDER, "result"), RELATION, max(FORM_WINDOW, H2H_WINDOW)).withColumn(
        "form", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*latest_first())))
    late = late.select(*KEYS, "result", "rn", "form", levels.alias("x")).where(F.when(c("x.whole"), c("form") <= FORM_WINDOW).otherwise(c("rn") <= H2H_WINDOW))
    late = late.select(*KEYS, "x.*", *[F.lit(0).cast("long").alias(f"all_{m}") for m in "nwl"], F.lit(1).cast("long").alias("late_n"),
                       *[(c("result") == v).cast("long").alias(f"late_{m}") for m, v in (("w", WIN), ("l", LOSS))])
    return every.unionByName(late).groupBy(*KEYS, "whole", "other").agg(*[F.sum(f"{p}_{m}").alias(f"{p}_{m}") for p in ("all", "late") for m in "nwl"])


def _both_ways(pairs: DataFrame) -> DataFrame:
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("key_a").alias("player_key"), F.col("key_b").alias("rival_key"),
                 F.col("player_a").alias("player"), F.col("player_b").alias("rival")),
        F.struct(F.lit(1).alias("side"), F.col("key_b").alias("player_key"), F.col("key_a").alias("rival_key"),
                 F.col("player_b").alias("player"), F.col("player_a").alias("rival")),
    ))
    return pairs.withColumn("s", sides).select("league", "group_index", "player_a", "player_b", "s.*")


def side_estimates(df: DataFrame, pairs: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Both directed estimates of every pair, with their evidence.

    The history is cut to the wanted players by a semi-join before it is counted; each side then looks up three rows of the
    evidence: its player, its rival, and their relation.
    """
    sides = _both_ways(pairs)
    rows = filters.only_identities(filters.operational_results(df, excluded), sides.select(*KEYS).distinct())
    side = ["league", "group_index", "player_a", "player_b", "side", "player_key", "rival_key", "player", "rival"]
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(k).alias("who"), F.lit(r != "d").alias("whole"), (F.col("rival_key") if r == "d" else F.lit("")).alias("other"))
                                for r, k in (("p", "player_key"), ("r", "rival_key"), ("d", "player_key"))]))
    found = evidence(rows).withColumnRenamed("player_key", "who")
    looked = sides.select(*side, roles.alias("x")).select(*side, "x.*").join(found, ["league", "who", "whole", "other"], "left")
    names = {"p": ("all", "form"), "r": ("rival_all", "rival_form"), "d": ("h2h", "rh2h")}
    sums = [F.coalesce(F.max(F.when(F.col("role") == r, F.col(f"{p}_{m}"))), F.lit(0)).alias(f"{name}_{m}")
            for r, pair in names.items() for p, name in zip(("all", "late"), pair) for m in "nwl"]
    j = looked.groupBy(*side).agg(*sums)
    j = j.withColumns({f"{name}_{full}": pct2(F.col(f"{name}_{m}"), F.col(f"{name}_n")) for pair in names.values() for name in pair for m, full in (("w", "win"), ("l", "loss"))})
    c = F.col

    def mean(name: str, key: str) -> Column:
        a = shrunk(c(f"{key}_win"), c(f"{key}_n"), PRIORS[name])
        return (a + shrunk(c(f"rival_{key}_loss"), c(f"rival_{key}_n"), PRIORS[name])) / 2

    estimate = (
        shrunk(c("h2h_win"), c("h2h_n"), PRIORS["h2h"]) * WEIGHTS["h2h"]
        + shrunk(c("rh2h_win"), c("rh2h_n"), PRIORS["recent_h2h"]) * WEIGHTS["recent_h2h"]
        + mean("form", "form") * WEIGHTS["form"] + mean("overall", "all") * WEIGHTS["overall"]
    )

    def at_least(h2h_n: int, form_n: int) -> Column:
        return (c("h2h_n") >= h2h_n) & (c("form_n") >= form_n) & (c("rival_form_n") >= form_n)

    return j.select(
        "league", "group_index", "player_a", "player_b", "side",
        c("player").alias("predicted_player"), c("rival").alias("opponent"),
        F.round(estimate, 2).alias("estimated_win_pct"),
        F.when(at_least(20, 12), F.lit("HIGH")).when(at_least(10, 8), F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("confidence"),
        c("h2h_n").alias("h2h_matches"), c("h2h_win").alias("h2h_win_pct"),
        c("rh2h_n").alias("recent_h2h_matches"), c("rh2h_win").alias("recent_h2h_win_pct"),
        c("form_n").alias("recent_player_matches"), c("form_win").alias("recent_player_win_pct"),
        c("rival_form_n").alias("recent_opponent_matches"), c("rival_form_loss").alias("recent_opponent_loss_pct"),
        c("all_n").alias("overall_player_matches"), c("all_win").alias("overall_player_win_pct"),
        c("rival_all_n").alias("overall_opponent_matches"), c("rival_all_loss").alias("overall_opponent_loss_pct"),
    )


def predictions(df: DataFrame, tracked: DataFrame, *, min_estimated_win_pct: float = MIN_ESTIMATE,
                excluded: DataFrame | None = None) -> DataFrame:
    """The better side of every pair whose estimate and confidence suffice (side A wins ties)."""
    threshold = number_between(min_estimated_win_pct, 50, 100, "min_estimated_win_pct")
    excluded = filters.excluded_keys(tracked) if excluded is None else excluded
    sides = side_estimates(df, group_pairs(tracked), excluded)
    pick = F.max_by(F.struct(*[c for c in schemas.PREDICTION if c not in ("league", "group_index", "player_a", "player_b")]),
                    F.struct("estimated_win_pct", -F.col("side")))
    best = sides.groupBy("league", "group_index", "player_a", "player_b").agg(pick.alias("m"))
    best = best.select("league", "group_index", "player_a", "player_b", "m.*").select(*schemas.PREDICTION)
    return best.filter((F.col("estimated_win_pct") >= threshold) & F.col("confidence").isin("HIGH", "MEDIUM"))


def prediction_order() -> list[Column]:
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE_ORDER)), F.col("confidence"))
    return [F.desc("estimated_win_pct"), rank, F.col("league"), F.col("group_index"),
            F.lower("predicted_player"), F.lower("opponent")]


def numbered(found: DataFrame) -> DataFrame:
    """Predictions with ``position`` in presentation order; at most a row per pair of a list block."""
    return found.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*prediction_order())))
