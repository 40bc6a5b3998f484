"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has a bit for each of the 64 bits of its shingles' hashes: 1 where over half of them have it. Anchors are the
words of a code that is a product of short perfect codes, so every fingerprint has exactly one anchor, its home, within the
radius of each piece. If two fingerprints differ in at most t bits, the home of one lies within each piece's radius of the
other, but for t more bits in all pieces together. So a fingerprint is copied to its home and to those of the anchors in
that reach that come before its home; a pair within the threshold meets exactly once, at the lesser of its two homes, and
copies are compared there with the fingerprints at home.

Equal fingerprints are one from the start. An anchor that is home to very many different fingerprints is not compared pair by pair:
all that reach it go to each point within half the threshold of them. At such a point at most 65 different ones can meet, all of
them are within the threshold of each other, and two fingerprints within it always share one; so a link to the least is enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import bytes_of, cut, release, tidy
from duelbook.llm.components import components

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Length, generator polynomial and covering radius of the cyclic perfect codes whose product covers 64 bits: two binary Golay codes
#: and four repetition codes, 2^28 anchors.
PIECES = ((23, 0b101011100011, 3), (23, 0b101011100011, 3), (5, 0b11111, 2), (5, 0b11111, 2), (5, 0b11111, 2), (3, 0b111, 1))
#: Fingerprints at home at one anchor that copies are compared with one by one.
HOME = 256
#: Bytes of a long text taken at once.
CHUNK = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, repeats included, a part of the text at a time."""
    before: list[bytes] = []
    at, seen = 0, 0
    while at < len(text):
        space = _SPACE.search(text, at + CHUNK)
        end = space.end() if space else len(text)
        words = before + text[at:end].lower().split()  # of bytes: A-Z only, and white space as the contract has it
        at, n = end, len(words)
        if n >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            digest = xxhash.xxh64_intdigest
            yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)),
                              np.uint64, n - size + 1)
            seen += n - size + 1
        before = words[max(0, n - size + 1):]
    if not seen and before:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), seed)], np.uint64)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, as a signed number; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size, seed):
        for part in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[part:part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (a long) of every row; a null text is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), bytes_of(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, fp long")


class Piece:
    """One short code: for each syndrome the differences between a point and the code words around it, the nearest first."""

    def __init__(self, length: int, polynomial: int, radius: int, threshold: int):
        self.length, self.mask = length, np.uint64((1 << length) - 1)
        degree = polynomial.bit_length() - 1
        residue, remainders = 1, []
        for _ in range(length):  # x^i modulo the polynomial
            remainders.append(residue)
            residue <<= 1
            if residue >> degree:
                residue ^= polynomial
        half = (length + 1) // 2
        self.low_bits = np.uint64(half)
        self.low, self.high = self._linear(remainders[:half]), self._linear(remainders[half:])
        found: dict[int, list[tuple[int, int]]] = {}
        for weight in range(min(length, radius + threshold) + 1):
            for places in combinations(range(length), weight):
                syndrome = 0
                for p in places:
                    syndrome ^= remainders[p]
                found.setdefault(syndrome, []).append((max(0, weight - radius), sum(1 << p for p in places)))
        lists = [sorted(found[s]) for s in range(1 << degree)]
        self.start = np.cumsum([0] + [len(x) for x in lists])[:-1]
        self.excess = np.array([e for x in lists for e, _ in x])
        self.difference = np.array([d for x in lists for _, d in x], np.uint64)
        #: by spare bits and syndrome: how many differences are within the radius and so many bits more
        self.within = np.array([[sum(e <= spare for e, _ in x) for x in lists] for spare in range(threshold + 1)])

    @staticmethod
    def _linear(remainders: list[int]) -> np.ndarray:
        table = np.zeros(1 << len(remainders), np.int64)
        for i, r in enumerate(remainders):
            table[1 << i:2 << i] = table[:1 << i] ^ r
        return table

    def syndrome(self, value: np.ndarray) -> np.ndarray:
        return self.low[(value & ((np.uint64(1) << self.low_bits) - np.uint64(1))).astype(np.int64)] ^ self.high[(value >> self.low_bits).astype(np.int64)]


@cache
def code(threshold: int = THRESHOLD) -> tuple[Piece, ...]:
    return tuple(Piece(*p, threshold) for p in PIECES)


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, whether it is the row's home) for each anchor within reach of each of some unsigned fingerprints."""
    row, point, spent = np.arange(len(fps)), fps.copy(), np.zeros(len(fps), np.int64)
    home = np.ones(len(fps), bool)
    shift = 0
    for piece in code(threshold):
        s = piece.syndrome((fps[row] >> np.uint64(shift)) & piece.mask)
        many = piece.within[threshold - spent, s]
        which = np.repeat(np.arange(len(row)), many)
        at = piece.start[s][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        row, point = row[which], point[which] ^ (piece.difference[at] << np.uint64(shift))
        spent, home = spent[which] + piece.excess[at], home[which] & (piece.excess[at] == 0)
        shift += piece.length
    return row, point, home


def placed(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """anchor, fp, home: every fingerprint at its home and at the anchors in reach that come before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for part in range(0, len(fp), 500):
                some = fp[part:part + 500]
                row, point, home = anchors(some, threshold)
                own = np.zeros(len(some), np.int64)
                own[row[home]] = point.view(np.int64)[home]
                keep = point.view(np.int64) <= own[row]
                yield pa.RecordBatch.from_arrays([pa.array(point.view(np.int64)[keep]), pa.array(some.view(np.int64)[row[keep]]), pa.array(home[keep])],
                                                 ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(tidy(run), "anchor long, fp long, home boolean")


def _midpoints(fp: str, distance: int):
    """All points that differ from a fingerprint in at most ``distance`` bits."""
    points = [0]
    for d in range(1, distance + 1):
        points += [sum(1 << p for p in places) for places in combinations(range(64), d)]
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    return F.explode(F.transform(F.array(*[F.lit(p).cast("long") for p in signed]), lambda p: F.col(fp).bitwiseXOR(p)))


def links(fps: DataFrame, threshold: int = THRESHOLD, home_limit: int = HOME) -> DataFrame:
    """a, b: links between different fingerprints that differ in at most ``threshold`` bits; their components are those of all such pairs.

    ``fps``: fp, each once. Around crowded anchors the links are stars through the points in between (thresholds of an even number of
    bits), elsewhere all pairs.
    """
    copies = placed(fps, threshold)
    at_home = cut(copies.where("home").select("anchor", F.col("fp").alias("at_home")))
    sizes = at_home.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    crowded = cut(sizes.where(F.col("n") > home_limit).select("anchor"))
    none = crowded.isEmpty()
    few = at_home if none else at_home.join(crowded, "anchor", "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("at_home"))) <= threshold
    # Spark sizes the copies like the fingerprints they are made of, some 46 times too low, so it must not choose to broadcast them
    pairs = copies.hint("merge").join(few, "anchor").where(near & (~F.col("home") | (F.col("fp") < F.col("at_home")))).select(
        F.col("fp").alias("a"), F.col("at_home").alias("b"))
    if none:
        return pairs
    dense = copies.join(crowded, "anchor", "left_semi").select("fp").distinct()
    middle = dense.select("fp", _midpoints("fp", threshold // 2).alias("middle"))
    meets = middle.groupBy("middle").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = meets.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE, home_limit: int = HOME,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row.

    component_id is the smallest doc_id that links lead to, the row's own without any. A null or empty text, or one of white space,
    has the fingerprint zero and is linked like any other. Texts of fewer words than a shingle count as one shingle; very long ones are
    hashed in parts of a megabyte. Repeated rows have equal fingerprints and so one component. Rows with a null id are linked, but
    never name a component that has another id; a component of null ids alone has a null name. Other columns are not read, an empty
    table gives no rows. ``threshold`` must be even.
    """
    if threshold % 2:
        raise ValueError("threshold must be even")
    prints = cut(fingerprints(docs, size, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = cut(links(distinct, threshold, home_limit))
    if linked.isEmpty():
        named = distinct.select("fp", F.col("least").alias("component_id"))
    else:
        grouped = components(linked).select(F.col("node").alias("fp"), "component")
        rooted = cut(distinct.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
        ids = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
        named = rooted.join(ids, "component").select("fp", "component_id")
    named = cut(named)
    release(distinct, linked)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
