"""Near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

A document is the set of its distinct word shingles, hashed once to 64 bits. One pass over the set gives all bins of its
signature: the leading bits of a hash name the bin, the least hash of a bin is its value, and an empty bin takes the
value of another one, tried in an order that is random but the same for every document. Rows of bins make bands, bands make
buckets. Documents of equal sets are one class from the start, so copies cost nothing below.

In a bucket of n classes not all pairs are looked at: one class is its centre and only its n - 1 edges are confirmed on the
full sets. That leaves buckets whose other classes are still in several components; most hold documents that share one
passage and little else. Their classes are dealt anew, into buckets of their rarest shingles: two sets that are similar
enough share one of the first (1 - similarity) * size + 1 shingles in any common order, so no link between members of one
bucket can be lost. There only classes of different components are compared, blockwise, by bitmaps of their shingles, which bound
an intersection from above; the few pairs that the bound can't rule out are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelbook.llm.common import bytes_of, cut, deflated, fresh, inflate, scratch, tidy, words_of
from duelbook.llm.components import components

SHINGLE, PERCENT = 5, 75
#: 32 bands of 4 of 128 bins: two sets of similarity 0.75 share no bucket with a chance of 0.000005.
BINS, ROWS = 128, 4
#: Counts that order shingles by rarity.
CELL_BITS = 18
#: Bits of a bitmap, classes that one task compares with each other.
BITMAP_BITS, BLOCK = 12, 512
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


def shingle_set(text: bytes, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; of all its words together, if there are fewer; empty without words."""
    words = words_of(text.lower())  # of bytes: A-Z only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(n, size)
    mix = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        mix = mix * _MULT + h[i:n - k + 1 + i]
    return np.unique(_mixed(mix))


def _orders(bins: int) -> np.ndarray:
    """For each bin the order in which it asks other bins for their value."""
    rng = np.random.default_rng(20_011)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """A value for each bin; ``hashes`` is a sorted, non-empty set."""
    bins = len(orders)
    at = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    values, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[at[first]], filled[at[first]] = hashes[first], True
    if len(first) < bins:
        empty = np.flatnonzero(~filled)
        lender = orders[empty, filled[orders[empty]].argmax(axis=1)]
        values[empty] = values[lender]
    return values


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A bucket key for each band, different between bands."""
    v = values.reshape(-1, rows)
    key = np.arange(1, len(v) + 1, dtype=np.uint64)
    for i in range(rows):
        key = _mixed(key * _MULT + v[:, i])
    return key.view(np.int64)


def node_of(hashes: np.ndarray) -> int:
    """64-bit name of a set."""
    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(rows: DataFrame, bins: int = BINS, band_rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, node, n_shingles, bands of rows (doc_id, text_key, text as binary); an empty set has no node and no bands."""
    orders = _orders(bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            node, count, bands = [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t, known, shingle)
                count.append(len(s))
                node.append(node_of(s) if len(s) else None)
                bands.append(band_keys(signature(s, orders), band_rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(count, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                                             ["doc_id", "text_key", "node", "n_shingles", "bands"])

    return rows.mapInArrow(tidy(run), "doc_id long, text_key long, node long, n_shingles long, bands array<long>")


def sets(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, hashes (binary) of rows with ``small``, their compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            found = [s for s in (shingle_set(inflate(t), known, shingle) for t in b.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                                             ["node", "hashes"])

    return rows.select("small").mapInArrow(tidy(run), "node long, hashes binary")


def common(a: bytes, b: bytes) -> tuple[int, int]:
    """(intersection, union) sizes of two sorted sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    n = int(np.count_nonzero(y[at] == x))
    return n, len(x) + len(y) - n


def rare_buckets(known: DataFrame, percent: int = PERCENT, cells: int = 1 << CELL_BITS) -> DataFrame:
    """key, node, n: the first shingles of each set (node, hashes), the rarest first.

    The order is by how often the shingle's cell of a table of ``cells`` counts is used over all sets, then by the hash. The table has a fixed
    size and is broadcast; any order would do, this one keeps the shingles of common passages out.
    """
    bits = np.uint64(64 - cells.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, np.int64)
        for b in batches:
            for h in b.column(0).to_pylist():
                seen += np.bincount((np.frombuffer(h, np.uint64) * _MULT >> bits).astype(np.int64), minlength=cells)
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 20_000], pa.int64()), pa.array(seen[at[i:i + 20_000]], pa.int64())], ["cell", "n"])

    got = known.select("hashes").mapInArrow(tidy(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # cells rows at most
    table = np.zeros(cells, np.int64)
    table[got["cell"].to_numpy()] = got["n"].to_numpy()
    shared = known.sparkSession.sparkContext.broadcast(table)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            keys, sizes = [], []
            for h in b.column(1).to_pylist():
                h = np.frombuffer(h, np.uint64)
                n = len(h)
                order = np.lexsort((h, often[(h * _MULT >> bits).astype(np.int64)]))
                keys.append(h[order[:n - -(-percent * n // 100) + 1]].view(np.int64))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["node", "n", "keys"])

    return known.select("node", "hashes").mapInArrow(tidy(first), "node long, n long, keys array<long>").select(F.explode("keys").alias("key"), "node", "n")


def bitmaps(known: DataFrame, bits: int = 1 << BITMAP_BITS) -> DataFrame:
    """node, bitmap (binary) of sets (node, hashes): a bit for each shingle, of ``bits``."""
    shift = np.uint64(64 - bits.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h in b.column(1).to_pylist():
                flags = np.zeros(bits, bool)
                flags[(np.frombuffer(h, np.uint64) * _MULT >> shift).astype(np.int64)] = True
                out.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["node", "bitmap"])

    return known.select("node", "hashes").mapInArrow(tidy(run), "node long, bitmap binary")


def possible(members: DataFrame, maps: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) of one bucket and different components that the bitmaps don't rule out.

    members: key, node, n, component. A bit of one set that the other lacks is a shingle that they don't share, so no pair that is
    similar enough is lost. A bucket of more than ``block`` classes is dealt to tasks by pairs of blocks.
    """
    parts = cut(members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    rows = members.join(parts, "key").join(maps, "node").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "n", "component", "bitmap")
    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compare(group: list[tuple]) -> set[tuple[int, int]]:
        out = set()
        cross = group[0][1] != group[0][2]
        mine, node, n, component = (np.array([g[i] for g in group], np.int64) for i in range(3, 7))
        maps_ = np.stack([np.frombuffer(g[7], np.uint64) for g in group])
        for i in range(len(group) - 1):
            rest = slice(i + 1, None)
            may = (component[rest] != component[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
            if cross:
                may &= mine[rest] != mine[i]
            at = np.flatnonzero(may) + i + 1
            if not len(at):
                continue
            only_i = np.bitwise_count(maps_[i] & ~maps_[at]).sum(axis=1, dtype=np.int64)
            only_at = np.bitwise_count(maps_[at] & ~maps_[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[i] - only_i, n[at] - only_at)
            for j in at[100 * most >= percent * (n[i] + n[at] - most)].tolist():
                out.add((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        group: list[tuple] = []
        for b in batches:
            out: set[tuple[int, int]] = set()
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    out |= compare(group)
                    group = []
                group.append(row)
            yield made(out)
        if group:
            yield made(compare(group))

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def confirmed(edges: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) whose sets are similar enough, with ``inter`` and ``uni``."""
    x = known.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    c = known.select(F.col("node").alias("a"), F.col("hashes").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            size = [common(p, q) for p, q in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array([s[0] for s in size], pa.int64()), pa.array([s[1] for s in size], pa.int64())],
                                             ["a", "b", "inter", "uni"])
            yield out.filter(pa.array([100 * n >= percent * u for n, u in size], pa.bool_()))

    return edges.join(x, "b").join(c, "a").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, inter long, uni long")


def _edges(members: DataFrame, centres: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(edges from each bucket's first classes to the rest of other components, the members that were no centre)."""
    w = Window.partitionBy("key").orderBy("node")
    chosen = cut(members.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= centres).select(
        "key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a")))
    pairs = members.join(chosen, "key").where("node <> a and component <> c_a").where(
        f"100 * least(n, n_a) >= {percent} * greatest(n, n_a)").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    rest = members.join(chosen.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti")
    return pairs, rest


def _shared(members: DataFrame) -> DataFrame:
    """The rows whose bucket holds more than one class."""
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    return cut(members.join(shared, "key", "left_semi"))


def _mixed_buckets(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """The rows whose bucket holds classes of several components, each with its present one."""
    rows = members.select("key", "node", "n")
    if found is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).select("key", "node", "n", "component")
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return cut(rows.join(mixed, "key", "left_semi"))


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component of all linked nodes after further links, which meet the components that were there as wholes."""
    if found is None:
        return cut(components(links))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").withColumn("component", F.col("node"))
    known = cut(found.unionByName(nodes))
    left = links.join(known.select(F.col("node").alias("a"), F.col("component").alias("c")), "a")
    both = left.join(known.select(F.col("node").alias("b"), F.col("component").alias("d")), "b").select(F.col("c").alias("a"), F.col("d").alias("b"))
    merged = components(both).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return cut(known.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bins: int = BINS, band_rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, component for every row.

    component_id: the smallest doc_id that links lead to, its own without any. A null or empty text, or one of white space, has
    no shingles, links with nothing and is kept. Repeated rows have equal sets, so all have the same component; rows with
    a null id share the component of their text, are its last choice, and are kept only where nothing else is.
    Very long texts are read whole, one at a time; a set takes 8 bytes a shingle. Other columns are not read. An empty table gives no rows. text_key tells texts apart, component numbers the components (null
    without shingles).
    """
    last = F.lit(2**63 - 1)  # stands for a null id
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), last).alias("doc_id"), F.xxhash64(bytes_of(text_col)).alias("text_key"),
                       bytes_of(text_col).alias("text"))
    with scratch() as keep:
        signed = keep(cut(signatures(rows, bins, band_rows, shingle)))
        classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        banded = classes.select("node", "n", F.explode("bands").alias("key"))
        members = _shared(banded.withColumn("component", F.col("node")))
        ids = cut(signed.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
        # A merge join puts the shuffle between the two Python steps: a task never holds two workers.
        chosen = rows.select("doc_id", deflated(F.col("text")).alias("small")).join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        texts = cut(sets(chosen, shingle).join(ids.select("node"), "node", "left_semi").dropDuplicates(["node"]))
        found = None
        for centres in (1, 4):
            edges, members = _edges(members, centres, percent)
            new = cut(confirmed(edges, texts, percent).select("a", "b"))
            if not new.isEmpty():
                found = _joined(found, new)
            members = _mixed_buckets(members, found)
        if not members.isEmpty():
            left = cut(texts.join(members.select("node").distinct(), "node", "left_semi"))
            members = _mixed_buckets(_shared(rare_buckets(left, percent)), found)
            new = cut(confirmed(possible(members, bitmaps(left), percent), texts, percent).select("a", "b"))
            if not new.isEmpty():
                found = _joined(found, new)
        if found is None:
            found = signed.select("node", F.col("node").alias("component")).limit(0)
        nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").withColumn(
            "component", F.coalesce("component", "node"))
        nodes = cut(nodes)
        least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
        by_node = keep(cut(nodes.join(least, "component").select("node", "component", "component_id")))
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(by_node, "node", "left").withColumn(
        "component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select(F.nullif("doc_id", last).alias("doc_id"), "n_shingles", F.nullif("component_id", last).alias("component_id"),
                      (F.col("doc_id") == F.col("component_id")).alias("kept"),
                      "text_key", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the one with the smallest id (repeated rows: once; a null id comes last), and every
    row without shingles."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    doc, key = fresh(docs, "doc"), fresh(docs, "key")
    last = F.lit(2**63 - 1)
    stay = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", last).alias(doc), F.col("text_key").alias(key))).alias("m"))
    has_words = F.coalesce(docs[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(has_words).withColumns({doc: F.coalesce(docs[id_col].cast("long"), last), key: F.xxhash64(bytes_of(text_col))})
    first = keyed.join(stay.select("m.*"), [doc, key], "left_semi").dropDuplicates([doc, key]).select(*docs.columns)
    return first.unionByName(docs.where(~has_words))
