"""First-wins dedup, field-wise merge and repair reconciliation (AGG10, AGG12, VAL5, JN11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.schemas import HISTORY_FIELDS, OPTIONAL_FIELDS

# Quality order, lowest first.
QUALITY_ORDER = ("partial", "inferred", "complete")
PROVENANCE = ("source_file", "collected_at")
# What identifies a finalized perspective, and what a repair may correct.
IDENTITY_FIELDS = ("league", "match_id", "perspective_id", "player_key", "rival_key",
                   "home_score", "away_score", "home_away")
REPAIR_FIELDS = ("timestamp", "timestamp_utc", "round", "competition", "group_key",
                 "source_block_order", "source_row_order")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an explicit order.

    An aggregation that combines map-side: a key with very many copies reaches the shuffle
    as one row per task.  Several branches of a query over the result share its shuffle.
    Rows are grouped by the keys' hash first, which sorts faster than text; places that are
    equal go to the lowest of the other columns.
    """
    order = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys]
    if any("map<" in t or "variant" in t for _, t in df.select(*rest).dtypes):  # these have no order
        first = F.min_by(F.struct(*rest), F.struct(*order))
    else:
        first = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    g = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(first.alias("_first"))
    return g.select(*keys, "_first.*").select(*df.columns)


def present(col: Column, dtype: str) -> Column:
    """Neither NULL, empty text nor an empty list."""
    if dtype == "string":
        return col.isNotNull() & (col != "")
    if dtype.startswith("array"):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    return col.isNotNull()


def quality_rank(col: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, QUALITY_ORDER)), col)


def _payload(df: DataFrame, arrival: Sequence[str]) -> list[tuple[str, str]]:
    return [(n, t) for n, t in df.dtypes if n != "perspective_id" and n != arrival[0]]


def _firsts(fields: Sequence[tuple[str, str]], order: Sequence[str]) -> list[Column]:
    """An aggregate per field: its first present value in ``order``, of the data quality the highest. Equal places go to the lowest value."""
    aggs = []
    for name, dtype in fields:
        c = F.col(name)
        if name == "data_quality":
            first = F.max_by(c, quality_rank(c))
        elif name in order[:1]:  # is its own place
            first = F.min(F.when(present(c, dtype), c))
        else:
            places = [F.col(a).alias(f"at_{i}") for i, a in enumerate(order)]
            first = F.min(F.when(present(c, dtype), F.struct(*places, c.alias("value"))))["value"]
        aggs.append(first.alias(name))
    return aggs


def _one_per_id(df: DataFrame) -> DataFrame:
    """Marks a table that has a perspective once and null for what it lacks; what is made of it doesn't have the mark."""
    df._merged_by_id = True
    return df


def merge_history(df: DataFrame, arrival: Sequence[str] = ("arrival",)) -> DataFrame:
    """One row per perspective_id: per field the first present value in arrival order.

    ``arrival`` names the ordering columns, the first of them an arrival class that is
    dropped (stored rows lowest).  Data quality only ever rises.  Everything is an
    aggregate that combines map-side, with no window over the copies, so very many copies
    of one perspective shrink to one row per task before the shuffle.
    """
    aggs = _firsts(_payload(df, arrival), arrival)
    return _one_per_id(df.groupBy("perspective_id").agg(*aggs).select(*[n for n in df.columns if n != arrival[0]]))


def merge_conflicts(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """(perspective_id, field, kept, distinct_values): fields on which copies disagree.

    Two comparable sketches per field (lowest and highest present value) decide whether
    there is a conflict at all; only disagreeing perspectives are looked at value by value.
    """
    fields = [(n, t) for n, t in _payload(df, [arrival]) if n not in PROVENANCE + ("data_quality",)]
    ranges = df.groupBy("perspective_id").agg(*[
        F.struct(
            F.min(F.when(present(F.col(n), t), F.col(n).cast("string"))).alias("lo"),
            F.max(F.when(present(F.col(n), t), F.col(n).cast("string"))).alias("hi"),
        ).alias(n) for n, t in fields
    ])
    suspects = ranges.select("perspective_id", F.explode(F.array_compact(F.array(*[
        F.when(F.col(n)["lo"] != F.col(n)["hi"], F.lit(n)) for n, _ in fields
    ]))).alias("field"))
    # Re-read only the disagreeing perspectives.
    long = df.join(suspects, "perspective_id").select(
        "perspective_id", "field", F.col(arrival).alias("arrival"),
        F.element_at(F.map_from_arrays(
            F.array(*[F.lit(n) for n, _ in fields]),
            F.array(*[F.when(present(F.col(n), t), F.col(n).cast("string")) for n, t in fields]),
        ), F.col("field")).alias("value"),
    ).filter("value is not null")
    # Distinct values first (map-side combine), so copies never pile up in one group.
    distinct = long.groupBy("perspective_id", "field", "value").agg(F.min("arrival").alias("arrival"))
    return distinct.groupBy("perspective_id", "field").agg(
        F.min_by("value", "arrival").alias("kept"), F.count("*").alias("distinct_values")
    )


def upsert(existing: DataFrame, candidates: DataFrame, candidate_order: Sequence[str] = ("ts",)) -> DataFrame:
    """Stored rows merged with candidates (SNK2): stored values win, gaps are filled.

    Candidates fill gaps in ``candidate_order``; equal places go to the lowest value. A side is merged by itself first, unless it was merged
    already: then the shuffles hold the rows of one side each, and the sides lie together by id when they meet, without places.
    """
    def side(df: DataFrame, class_: int) -> DataFrame:
        if not getattr(df, "_merged_by_id", False):
            order = [c for c in candidate_order if c in df.columns]
            fields = [(n, t) for n, t in df.dtypes if n != "perspective_id"]
            df = df.groupBy("perspective_id").agg(*_firsts(fields, order)).select(*df.columns)
        return df.withColumn("_class", F.lit(class_))

    return merge_history(side(existing, 0).unionByName(side(candidates, 1), allowMissingColumns=True), ["_class"])


def id_hash() -> Column:
    return F.xxhash64("perspective_id")


def repeated(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """(_hash): the id hashes that several stored rows or several candidates have. Only hashes are shuffled and counted."""
    both = existing.select(id_hash().alias("_hash"), F.lit(0).alias("new")).unionAll(candidates.select(id_hash().alias("_hash"), F.lit(1).alias("new")))
    counts = both.groupBy("_hash").agg(F.sum("new").alias("new"), F.count(F.lit(1)).alias("n"))
    return counts.where("new > 1 or n - new > 1").select("_hash")


def upsert_lone(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """``upsert`` of rows that are unique by perspective_id on either side: a join of whole rows, with no place per field."""
    def side(df: DataFrame, prefix: str) -> DataFrame:
        """Fields without what counts as absent, so that the join has only to choose: its code stays small."""
        fields = [F.when(present(F.col(n), t), F.col(n)) if n not in ("perspective_id", "data_quality") else F.col(n) for n, t in df.dtypes]
        return df.select(id_hash().alias(f"{prefix}_hash"), *[c.alias(f"{prefix}_{n}") for c, n in zip(fields, df.columns)])

    def value(name: str) -> Column:
        there = [F.col(f"{p}_{name}") for p, df in (("o", existing), ("c", candidates)) if name in df.columns]
        if name == "data_quality" and len(there) == 2:
            old, new = there
            better = F.coalesce(quality_rank(new), F.lit(-1)) > F.coalesce(quality_rank(old), F.lit(-1))
            return F.when(better, new).otherwise(old).alias(name)
        return F.coalesce(*there).alias(name)

    same = (F.col("o_hash") == F.col("c_hash")) & F.col("o_perspective_id").eqNullSafe(F.col("c_perspective_id"))
    names = [*existing.columns, *[c for c in candidates.columns if c not in existing.columns]]
    return side(existing, "o").join(side(candidates, "c"), same, "full_outer").select(*map(value, names))


def compatible(a: str, b: str, sep: str = ".") -> Column:
    """Null-safe agreement on every identity field of two struct columns (VAL5), or of columns with two prefixes."""
    cond = F.lit(True)
    for f in IDENTITY_FIELDS:
        cond = cond & F.col(f"{a}{sep}{f}").eqNullSafe(F.col(f"{b}{sep}{f}"))
    return cond


def reconcile_repair(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Full outer reconciliation on perspective_id (JN11), one row each with ``action``.

    Actions: stored (no candidate), added, conflict (identity differs, stored row kept),
    updated (repair fields replaced, absent ones cleared, provenance refreshed), unchanged.
    Both inputs are unique per perspective_id.
    """
    names = [n for n in existing.columns]
    extra = [n for n in candidates.columns if n not in names]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        """Flat columns, so those that nothing asks for are not shuffled; the hash leads the sort."""
        pid = F.col("perspective_id")
        return df.select(F.xxhash64(pid).alias("_hash"), pid.alias("_pid"), F.lit(True).alias(f"{prefix}_there"),
                         *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])

    j = side(existing, "o").join(side(candidates, "c"), ["_hash", "_pid"], "full_outer")
    repairable = [f for f in REPAIR_FIELDS if f in names and f in candidates.columns]
    differs = F.lit(False)
    for f in repairable:
        differs = differs | ~F.col(f"o_{f}").eqNullSafe(F.col(f"c_{f}"))
    action = (
        F.when(F.col("c_there").isNull(), F.lit("stored"))
        .when(F.col("o_there").isNull(), F.lit("added"))
        .when(~compatible("o", "c", "_"), F.lit("conflict"))
        .when(differs, F.lit("updated"))
        .otherwise(F.lit("unchanged"))
    )
    j = j.withColumn("action", action)

    def merged(name: str) -> Column:
        in_c = name in candidates.columns
        new = F.col(f"c_{name}") if in_c else F.lit(None)
        old = F.col(f"o_{name}") if name in names else F.lit(None)
        value = F.when(F.col("action") == "added", new)
        if in_c and (name in repairable or name == "ts"):
            value = value.when(F.col("action") == "updated", new)
        elif in_c and name in PROVENANCE:
            value = value.when(F.col("action") == "updated", F.coalesce(new, old))
        return value.otherwise(old).alias(name)

    return j.select("action", *[F.col("_pid").alias(n) if n == "perspective_id" else merged(n) for n in names + extra])


def repair_candidates(parsed: DataFrame, target_day) -> DataFrame:
    """Perspectives whose local date is the target day or the one after (FLT12)."""
    day = F.to_date(F.lit(str(target_day)))
    local = F.to_date(F.substring("timestamp", 1, 10))
    return parsed.filter(local.isin(day) | (local == F.date_add(day, 1)))


def repair_counts(reconciled: DataFrame) -> DataFrame:
    """How many perspectives each action touched."""
    return reconciled.groupBy("action").agg(F.count("*").alias("perspectives"))


def conform(df: DataFrame) -> DataFrame:
    """Add the optional history fields a source lacks, in contract order."""
    have = dict(df.dtypes)
    cols = [
        F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in HISTORY_FIELDS + OPTIONAL_FIELDS
    ]
    return df.select(*cols, *[c for c in df.columns if c not in {f.name for f in HISTORY_FIELDS + OPTIONAL_FIELDS}])
