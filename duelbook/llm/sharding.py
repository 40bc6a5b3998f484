"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns ``vnodes`` points of a ring of 64-bit hashes; a row belongs to the first point clockwise of its key's
hash. A shard has a bounded capacity. Rows of an arc whose shard is full continue clockwise to the next point whose
shard has room. Only counts per arc decide how many rows of an arc go where (``shards * vnodes`` numbers, whatever the
input), and the rows of an arc take their places in the order of a rank. Ranks are built from counts of small slices of
each arc, so no arc is ever sorted in one task, and a hot key is spread over the slices by a second hash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.llm.common import cut

SHARDS, VNODES, SLICES = 16, 64, 64
#: Cells of the ring by the leading bits of a hash; each cell knows its points, so finding a point is an equi-join.
CELL_BITS = 10


def ring(spark, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """arc, shard, point: the points in ring order."""
    points = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.lit("ring"), F.col("id") % shards, F.expr(f"id div {shards}")).alias("point"))
    return points.select((F.row_number().over(Window.orderBy("point", "shard")) - 1).alias("arc"), "shard", "point")


def cells(points: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(cell, its points and the first one after them as (point, arc)); points: (point, arc) in ring order."""
    width, out, at = 1 << (64 - CELL_BITS), [], 0
    for cell in range(1 << CELL_BITS):
        low, inside = (cell << (64 - CELL_BITS)) - (1 << 63), []
        while at < len(points) and points[at][0] < low + width:
            inside.append(points[at])
            at += 1
        after = points[at] if at < len(points) else (None, points[0][1])
        out.append((cell, [*inside, ((1 << 63) - 1, after[1])]))
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard takes: without slack at most one apart and ``rows`` together, else ceil((1 + slack) * rows / shards)."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flow(arcs: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, shard, first, last): places first..last of the arc go to the shard.

    arcs: (shard, rows) in ring order. In round r what is left of each arc asks the shard r points further clockwise.
    """
    room, left, done, out = list(room), [n for _, n in arcs], [0] * len(arcs), []
    for step in range(len(arcs)):
        waiting = [a for a, n in enumerate(left) if n]
        if not waiting:
            break
        for a in waiting:
            shard = arcs[(a + step) % len(arcs)][0]
            n = min(left[a], room[shard])
            if n:
                out.append((a, shard, done[a], done[a] + n - 1))
                done[a], left[a], room[shard] = done[a] + n, left[a] - n, room[shard] - n
    return out


def _literal(spark, rows: list, schema: str) -> DataFrame:
    """A small table out of a literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def bounded_ring(rows: DataFrame, key: Column, spread: Column, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard); columns of these names are replaced.

    key: what the ring hashes; rows of one key stay near each other, but a key with more rows than a shard's capacity is
    continued clockwise like everything else. spread: tells rows of one key apart; equal rows are interchangeable. Null
    keys hash like a value. An empty table gives no rows. ``rows`` should be narrow: it is written once to the checkpoint
    folder, as it is both counted and placed.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    points = [(r["point"], r["arc"], r["shard"]) for r in ring(spark, shards, vnodes).orderBy("arc").collect()]  # shards * vnodes rows
    found = [{"_cell": c, "_points": [{"p": p, "a": a} for p, a in inside]} for c, inside in cells([(p, a) for p, a, _ in points])]
    cell_table = _literal(spark, found, "_cell: bigint, _points: array<struct<p: bigint, a: bigint>>")
    hashed = rows.select(*[rows[c].alias(f"_{i}") for i, c in enumerate(names)], F.xxhash64(key).alias("_hash"),
                         F.pmod(F.xxhash64(F.lit("slice"), key, spread), F.lit(SLICES)).cast("int").alias("_slice"),
                         F.xxhash64(F.lit("order"), key, spread).alias("_order"))
    hashed = hashed.withColumn("_cell", F.shiftrightunsigned(F.col("_hash").bitwiseXOR(F.lit(-(1 << 63))), 64 - CELL_BITS))
    placed = hashed.join(F.broadcast(cell_table), "_cell").withColumn(
        "_arc", F.filter("_points", lambda x: F.col("_hash") <= x["p"])[0]["a"]).drop("_points", "_cell", "_hash")
    placed = cut(placed)
    counts = placed.groupBy("_arc", "_slice").count()
    before = Window.partitionBy("_arc").orderBy("_slice")
    offsets = counts.withColumn("_before", F.sum("count").over(before) - F.col("count")).drop("count")
    per_arc = {r["_arc"]: r["n"] for r in counts.groupBy("_arc").agg(F.sum("count").alias("n")).collect()}  # at most shards * vnodes rows
    arcs = [(s, per_arc.get(a, 0)) for _, a, s in points]
    segments = flow(arcs, capacities(sum(n for _, n in arcs), shards, slack))
    used, shard_slot = [0] * shards, []
    for a, s, first, last in segments:
        shard_slot.append({"_arc": a, "shard": s, "_first": first, "_last": last, "_slot": used[s]})
        used[s] += last - first + 1
    by_arc = _literal(spark, shard_slot, "_arc: bigint, shard: int, _first: bigint, _last: bigint, _slot: bigint").groupBy("_arc").agg(
        F.collect_list(F.struct("shard", "_first", "_last", "_slot")).alias("_segments"))
    order = Window.partitionBy("_arc", "_slice").orderBy("_order", *[f"_{i}" for i in range(len(names))])
    ranked = placed.withColumn("_rank", F.row_number().over(order) - 1).join(F.broadcast(offsets), ["_arc", "_slice"]).withColumn(
        "_place", F.col("_before") + F.col("_rank"))
    goes = ranked.join(F.broadcast(by_arc), "_arc").withColumn(
        "_to", F.filter("_segments", lambda s: (s["_first"] <= F.col("_place")) & (s["_last"] >= F.col("_place")))[0])
    return goes.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], F.col("_to.shard").alias("shard"),
                       (F.col("_to._slot") + F.col("_place") - F.col("_to._first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, shard, slot under the law ``rows``: the shards' row
    counts are at most one apart. The ring is keyed by the id; rows of equal text need not meet. Repeated rows and null
    ids are rows like any other; other columns are not read."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return bounded_ring(rows, F.col("doc_id"), F.col("text_crc32"), shards, vnodes)
