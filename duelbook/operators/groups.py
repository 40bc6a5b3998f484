"""Target groups against daily H2H results (AGG6-AGG9, JN7, JN13, WIN10-WIN13, SRT2, SC18, SC21).

``targets``: league, group_no, group_size, player, slot (members in list order).
``daily``: league, date, player, rival, wins, draws, losses, seq - one row per directed
pair and day, already aggregated.  Percentages here are unrounded (S5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.functions.names import group_label, group_slug
from duelbook.functions.params import positive_int
from duelbook.functions.results import RESULTS, pct_exact, tail
from duelbook.operators import filters, segments

GROUP_SIZE = 5
COUNTS = ("wins", "draws", "losses")
RELATION = ["league", "group_no", "group_size", "player", "rival"]
SUMMARY = ["played", "last_24", *[f"{name}_{v}" for v in RESULTS for name in ("first", "last")]]


def target_groups(tracked: DataFrame, group_size: int = GROUP_SIZE) -> DataFrame:
    """Positional blocks of the tracked list, in list order.

    Positions count every remaining entry, empty slots included; a league change closes the
    block; blocks without any player vanish.  ``tracked`` is the list file (bounded by its
    author), so the list-wide window is as small as the file.
    """
    positive_int(group_size, "group_size")
    by_pos = Window.partitionBy(F.lit(0)).orderBy("pos")
    t = tracked.withColumn("_chg", (~F.col("league").eqNullSafe(F.lag("league").over(by_pos))).cast("int"))
    t = t.withColumn("_stretch", F.sum("_chg").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    in_stretch = Window.partitionBy("_stretch").orderBy("pos")
    t = t.withColumn("_block", F.floor((F.row_number().over(in_stretch) - 1) / group_size))
    t = t.filter(F.trim("player") != "")
    block = Window.partitionBy("_stretch", "_block")
    per_league = Window.partitionBy("league").orderBy("_stretch", "_block")
    return t.select(
        "league", (F.dense_rank().over(per_league) - 1).alias("group_no"), F.count("*").over(block).alias("group_size"),
        "player", F.row_number().over(block.orderBy("pos")).alias("slot"))


def group_names(targets: DataFrame) -> DataFrame:
    m = F.transform(F.array_sort(F.collect_list(F.struct("slot", "player"))), lambda s: s["player"])
    return targets.groupBy("league", "group_no", "group_size").agg(m.alias("members")).select(
        "league", "group_no", "group_size", "members",
        group_slug(F.col("members")).alias("group_id"), group_label(F.col("members")).alias("label"))


def group_daily(targets: DataFrame, daily: DataFrame) -> DataFrame:
    """Daily rows whose player and rival belong to one target group: two equi-joins (JN7).

    Sides are joined to the short target list, which Spark broadcasts when its size allows.
    """
    a = targets.select("league", "group_no", "group_size", "player")
    b = targets.select("league", "group_no", F.col("player").alias("rival"))
    return daily.join(a, ["league", "player"]).join(b, ["league", "group_no", "rival"])


def among_targets(targets: DataFrame, df: DataFrame) -> DataFrame:
    """Perspectives between two members of one target group: the few pairs are picked before anything is aggregated."""
    a = targets.select("league", "group_no", "player")
    pairs = a.join(a.select("league", "group_no", F.col("player").alias("rival")), ["league", "group_no"]).filter("player <> rival")
    return df.join(pairs.select("league", "player", "rival").distinct(), ["league", "player", "rival"], "left_semi")


def relation_days(targets: DataFrame, daily: DataFrame, text: bool = False) -> DataFrame:
    """The daily rows of each directed relation of a target group as summaries, whatever the relation's size.

    ``daily``: the rows of ``daily_rivals``, or a report's with their text in ``seq``.
    """
    days = group_daily(targets, daily if "last_E" in daily.columns else segments.of_text(daily))
    return days.select(*RELATION, *[c for c in ("player_key", "rival_key") if c in daily.columns], "date", *COUNTS, *SUMMARY, *(["seq"] if text else []))


def group_h2h(targets: DataFrame, daily: DataFrame, text: bool = False) -> DataFrame:
    """Directed totals inside each target group (AGG7), one row per relation: counts, shares, last results and trailing runs.

    All of it is merged from the days' summaries; with ``text`` also ``seq``, all results, where ``daily`` has its text in ``seq``.
    """
    days = relation_days(targets, daily, text)
    h = segments.merged(days, [c for c in days.columns if c not in (*COUNTS, *SUMMARY, "date", "seq")], ["date", "played", "last_24"])
    total = F.col("wins") + F.col("draws") + F.col("losses")
    h = h.withColumns({"win_run": segments.win_run(), "unbeaten_run": segments.unbeaten_run(), "last5": tail(F.col("last_24"), 5),
                       "last10": tail(F.col("last_24"), 10), "matches": total}).drop(*SUMMARY)
    return h.filter("matches > 0").withColumns({
        f"{n}_pct": pct_exact(F.col(c), F.col("matches")) for n, c in (("win", "wins"), ("draw", "draws"), ("loss", "losses"))})


def group_sequences(targets: DataFrame, df: DataFrame) -> DataFrame:
    """(league, player_key, player, rival_key, rival, slice, n, seq): the results between members of one group as text, a row per relation and month."""
    rows = filters.valid_results(among_targets(targets, df))
    return segments.sequences(rows, ["league", "player_key", "player", "rival_key", "rival"], "month")


def _scores(targets: DataFrame, h2h: DataFrame) -> DataFrame:
    """Per member: ordered list of (rival, win_pct, wins, matches) inside the group (at most group size - 1)."""
    rivals = h2h.groupBy("league", "group_no", "player").agg(
        F.array_sort(F.collect_list(F.struct("rival", "win_pct", "wins", "matches"))).alias("r"))
    return targets.select("league", "group_no", "player").join(rivals, ["league", "group_no", "player"], "left").withColumn(
        "r", F.coalesce("r", F.array().cast("array<struct<rival:string,win_pct:double,wins:bigint,matches:bigint>>")))


def power_ranking(targets: DataFrame, h2h: DataFrame) -> DataFrame:
    """Sum of (win% - 50) over rivals met; position within the group, ties by name."""
    score = F.aggregate("r", F.lit(0.0), lambda a, x: a + (x["win_pct"] - 50.0))
    s = _scores(targets, h2h).select("league", "group_no", "player", score.alias("score"))
    w = Window.partitionBy("league", "group_no").orderBy(F.desc("score"), "player")
    return s.withColumn("position", F.row_number().over(w))


def dominance(targets: DataFrame, h2h: DataFrame) -> DataFrame:
    """Rivals beaten more often than not, and rivals met."""
    return _scores(targets, h2h).select(
        "league", "group_no", "player", F.size(F.filter("r", lambda x: x["win_pct"] > 50)).alias("wins"),
        F.size("r").alias("rivals"))


def h2h_ranking(targets: DataFrame, h2h: DataFrame) -> DataFrame:
    """Win rate over all group matches, ranked by rate x matches; members without matches stay."""
    zero = F.lit(0).cast("long")
    s = _scores(targets, h2h).select(
        "league", "group_no", "player", F.aggregate("r", zero, lambda a, x: a + x["wins"]).alias("_w"),
        F.aggregate("r", zero, lambda a, x: a + x["matches"]).alias("matches"))
    s = s.withColumn("score", pct_exact(F.col("_w"), F.col("matches"))).withColumn(
        "weighted_score", F.col("score") * F.col("matches"))
    w = Window.partitionBy("league", "group_no").orderBy(F.desc("weighted_score"), "player")
    return s.withColumn("position", F.row_number().over(w)).drop("_w")


def back_and_lay(ranking: DataFrame) -> DataFrame:
    """First highest and first lowest score in ranking order, per group."""
    row = F.struct("player", "score", "matches", "weighted_score")
    g = ranking.groupBy("league", "group_no").agg(
        F.max_by(row, F.struct("score", -F.col("position"))).alias("b"),
        F.min_by(row, F.struct("score", "position")).alias("l"))
    sides = F.explode(F.array(F.struct(F.lit("back").alias("side"), F.col("b").alias("c")),
                              F.struct(F.lit("lay").alias("side"), F.col("l").alias("c"))))
    return g.select("league", "group_no", sides.alias("x")).select("league", "group_no", "x.side", "x.c.*")


def matchups(picks: DataFrame, h2h: DataFrame, top: int = 3) -> DataFrame:
    """Best three rivals of the back pick, worst three of the lay pick, with the full record."""
    rows = picks.select("league", "group_no", "side", "player").join(h2h, ["league", "group_no", "player"])
    signed = F.when(F.col("side") == "back", -F.col("win_pct")).otherwise(F.col("win_pct"))
    w = Window.partitionBy("league", "group_no", "side").orderBy(signed, "rival")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= positive_int(top, "top"))


# --- daily groups ---------------------------------------------------------------

def day_groups(daily: DataFrame, row_order: DataFrame) -> DataFrame:
    """Closed groups of each day: (league, date, group_seed, member) (AGG9).

    A player together with all rivals is a group when everyone in it met everyone else.
    Players are taken in report order (``row_order``: league, date, player, row_no) and
    skipped once an accepted group holds them.

    Edges are distinct pairs per day.  A seed with k rivals can only be valid if each of
    those rivals met at least k players, which prunes before edges are joined to edges.
    """
    day = ["league", "date"]
    # A player with a report row but no rivals is a group of one.
    alone = row_order.select(*day, "player").join(daily.select(*day, "player").distinct(), [*day, "player"], "left_anti")
    edges = daily.select(*day, "player", "rival").distinct()
    deg = edges.groupBy(*day, "player").agg(F.count("*").alias("deg"))
    listed = row_order.select(*day, F.col("player").alias("rival"), F.lit(True).alias("listed"))
    q = edges.join(deg, [*day, "player"]).join(
        deg.select(*day, F.col("player").alias("rival"), F.col("deg").alias("rival_deg")), [*day, "rival"], "left"
    ).join(listed, [*day, "rival"], "left")
    ok = q.groupBy(*day, "player").agg(
        F.min((F.coalesce("rival_deg", F.lit(0)) >= F.col("deg")) & F.coalesce("listed", F.lit(False))).alias("ok"),
        F.collect_set("rival").alias("rivals"))
    rows = row_order.select(*day, F.col("player").alias("seed"), "row_no")
    seeds = ok.filter("ok").select(*day, F.col("player").alias("seed"),
                                   F.array_sort(F.array_append("rivals", F.col("player"))).alias("members"))
    # All members of a closed group have the same neighbourhood: check each set once, under
    # its first seed in report order.
    sets = seeds.join(rows, [*day, "seed"]).groupBy(*day, "members").agg(F.min(F.struct("row_no", "seed")).alias("s"))
    sets = sets.select(*day, "members", F.col("s.row_no").alias("row_no"), F.col("s.seed").alias("seed"))
    arms = sets.select(*day, "seed", "row_no", "members", F.explode("members").alias("player"))
    met = arms.join(edges, [*day, "player"]).filter(F.array_contains("members", F.col("rival"))).groupBy(
        *day, "seed", "row_no", "members").agg(F.count("*").alias("met"))
    size = F.size("members")
    valid = met.filter(F.col("met") == size * (size - 1)).select(*day, "row_no", "seed", "members")
    first = valid.unionByName(alone.withColumnRenamed("player", "seed").join(rows, [*day, "seed"]).select(
        *day, "row_no", "seed", F.array("seed").alias("members")))
    per_day = first.groupBy(*day).agg(F.array_sort(F.collect_list(F.struct("row_no", "seed", "members"))).alias("g"))
    zero = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("seeds"))
    pick = F.aggregate("g", zero, lambda acc, x: F.when(F.array_contains(acc["used"], x["seed"]), acc).otherwise(
        F.struct(F.array_union(acc["used"], x["members"]).alias("used"), F.array_append(acc["seeds"], x["seed"]).alias("seeds"))))
    kept = per_day.withColumn("p", pick)
    return kept.select(*day, F.explode(F.filter("g", lambda x: F.array_contains(F.col("p.seeds"), x["seed"]))).alias("x")).select(
        *day, F.col("x.seed").alias("group_seed"), F.explode("x.members").alias("member"))


def report_order(players: DataFrame) -> DataFrame:
    """Row number of each player in the daily report: most matches first, ties by name."""
    w = Window.partitionBy("league", "date").orderBy(F.desc("played"), "player")
    return players.select("league", "date", "player", F.row_number().over(w).alias("row_no"))


def group_overlap(targets: DataFrame, groups: DataFrame) -> DataFrame:
    """(league, group_no, date, group_seed, kind, common): exact = all members, near = all but one (JN13)."""
    t = targets.select("league", "group_no", "group_size", F.col("player").alias("member"))
    o = groups.join(t, ["league", "member"]).groupBy("league", "group_no", "group_size", "date", "group_seed").agg(
        F.count("*").alias("common"))
    kind = F.when(F.col("common") == F.col("group_size"), F.lit("exact")).when(
        (F.col("group_size") > 1) & (F.col("common") >= F.col("group_size") - 1), F.lit("near"))
    return o.withColumn("kind", kind).filter("kind is not null")


def overlap_counts(targets: DataFrame, overlap: DataFrame) -> DataFrame:
    """How many day groups match each target exactly or nearly."""
    n = overlap.groupBy("league", "group_no").agg(
        F.count_if(F.col("kind") == "exact").alias("exact_matches"), F.count_if(F.col("kind") == "near").alias("near_matches"))
    base = targets.select("league", "group_no", "group_size").distinct()
    return base.join(n, ["league", "group_no"], "left").fillna(0)


def overlap_totals(targets: DataFrame, groups: DataFrame, overlap: DataFrame, daily: DataFrame) -> DataFrame:
    """Per player totals over exact and near day groups, counted among the common members (AGG6)."""
    o = overlap.select("league", "group_no", "date", "group_seed", "kind")
    common = groups.join(targets.select("league", "group_no", F.col("player").alias("member")), ["league", "member"]) \
        .join(o, ["league", "group_no", "date", "group_seed"])
    a = common.withColumnRenamed("member", "player")
    b = common.select("league", "group_no", "date", "group_seed", F.col("member").alias("rival"))
    rows = daily.join(a, ["league", "date", "player"]).join(b, ["league", "group_no", "date", "group_seed", "rival"])
    g = rows.groupBy("league", "group_no", "kind", "player").agg(*[F.sum(c).alias(c) for c in COUNTS])
    played = F.col("wins") + F.col("draws") + F.col("losses")
    return g.withColumns({"win_pct": pct_exact(F.col("wins"), played), "loss_pct": pct_exact(F.col("losses"), played)})


def nested_matrix(h2h: DataFrame) -> DataFrame:
    """Directed matrix as one nested row per member, empty cells left out (AGG8)."""
    cell = F.struct("rival", "wins", "draws", "losses", "matches", "win_pct", "draw_pct", "loss_pct",
                    "last5", "last10", "win_run", "unbeaten_run")
    return h2h.groupBy("league", "group_no", "player").agg(F.array_sort(F.collect_list(cell)).alias("rivals"))
