"""Substring dedup by super-k-mer partitioning of word windows.

Every window of ``window`` words has a minimiser, its least-hashed run of ``minimiser`` words. Consecutive windows
with the same minimiser overlap, so they travel together as one packed string (the words they cover) to the
minimiser's bucket, all that a map task has for one bucket as one compressed block. Equal windows have equal minimisers and meet
there; sorting the windows of a bucket finds for each the least document it starts in. What is said about a packed string is kept per place in its document:
spans of words to remove.

A minimiser that very many different texts share would make one bucket hot. Bytes per cell of minimisers are counted over all texts first;
what belongs to a crowded cell travels window by window instead, as 128-bit hashes dealt by that hash, so any number of tasks share it.

Copies are combined before they travel: of equal packed strings in a map task only the one of the least document goes
on, as all windows of the others start in that document, too. So a text that a third of all rows share reaches a
bucket once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import bytes_of, deflated, fresh, inflate, inflated, tidy, trim, words_of
from duelbook.llm.minhash import WordHashes, _mixed

WINDOW, MINIMISER = 13, 3
#: Bytes of text that a map task combines together.
CHUNK_BYTES = 4_000_000
#: Windows of one bucket that are sorted at a time; a larger bucket is sorted in several passes, by a hash of the window.
SORTED = 1_000_000
_MULT = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text behind a bucket; one bucket at a time is in memory. Cells of minimisers that are counted, and the bytes of packed strings
#: beyond which a cell goes by windows.
BUCKET_BYTES, CELLS, CROWDED = 8_000_000, 1 << 14, 32_000_000


def super_kmers(hashes: np.ndarray, window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first word, end word) of each super-k-mer of a text's word hashes; empty with fewer words than a window."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    runs = np.zeros(len(hashes) - minimiser + 1, np.uint64)
    for i in range(minimiser):
        runs = runs * _MULT + hashes[i:len(runs) + i]
    runs = _mixed(runs)
    least = np.lib.stride_tricks.sliding_window_view(runs, window - minimiser + 1).min(axis=1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], n) - 1
    return least[first].view(np.int64), first, last + window


def pack_rows(packed: list[bytes], minimisers: np.ndarray, docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, settled: np.ndarray) -> bytes:
    """Super-k-mers (packed string, minimiser, doc_id, text_key, first word) and settled spans (rows of doc_id, text_key, start, stop), compressed."""
    text = b"\n".join(packed)
    head = np.array([len(packed), len(settled)], "<i8").tobytes()
    parts = (minimisers.astype("<u4"), docs.astype("<i8"), keys.astype("<u4"), starts.astype("<i4"), settled.astype("<i8"))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(p.tobytes() for p in parts) + text)


def unpack_rows(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, s = np.frombuffer(raw, "<i8", 2).tolist()
    at, out = 16, []
    for kind, many in (("<u4", n), ("<i8", n), ("<u4", n), ("<i4", n), ("<i8", 4 * s)):
        out.append(np.frombuffer(raw, kind, many, at))
        at += out[-1].nbytes
    return raw[at:].split(b"\n") if n else [], out[0], out[1], out[2], out[3], out[4].reshape(-1, 4)


def cells_of(minimisers: np.ndarray) -> np.ndarray:
    return (minimisers.view(np.uint64) * _MULT >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def crowded_cells(rows: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, crowded: int = CROWDED) -> tuple[np.ndarray, int, int]:
    """(cells of minimisers whose packed strings are longer than ``crowded`` in all, number of their windows, bytes of all texts).

    Copies count, so a cell may be crowded by them alone; that costs it nothing but the form in which its windows travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        size, many, text_bytes, held = np.zeros(CELLS), np.zeros(CELLS), 0, 0
        parts: list[tuple[np.ndarray, np.ndarray, float]] = []

        def add() -> None:
            if parts:
                cell = cells_of(np.concatenate([p[0] for p in parts]))
                words_in = np.concatenate([p[1] for p in parts])
                width = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
                size[:] += np.bincount(cell, words_in * width, CELLS)
                many[:] += np.bincount(cell, words_in - window + 1, CELLS)
                parts.clear()

        for b in batches:
            for text in b.column(0).to_pylist():
                text_bytes += len(text)
                words = words_of(text)
                if len(words) >= window:
                    m, first, end = super_kmers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window, minimiser)
                    parts.append((m, end - first, len(text) / len(words)))
                held += len(text)
                if held > CHUNK_BYTES:
                    add()
                    held = 0
        add()
        at = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(size[at], text_bytes).astype(np.int64)),
                                          pa.array(np.append(many[at], 0).astype(np.int64))], ["cell", "size", "many"])

    counted = rows.select("text").mapInArrow(tidy(run), "cell long, size long, many long")
    got = counted.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("many").alias("many")).toArrow()  # CELLS + 1 rows at most
    cell, size, many = (got[c].to_numpy() for c in ("cell", "size", "many"))
    hot = (cell >= 0) & (size > crowded)
    return np.sort(cell[hot]), int(many[hot].sum()), int(size[cell < 0].sum())


def pack_windows(hashes: np.ndarray, docs: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> bytes:
    """Windows by their 128-bit hashes (two columns), compressed."""
    parts = (hashes.astype("<u8"), docs.astype("<i8"), keys.astype("<u4"), starts.astype("<i4"))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def unpack_windows(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 32
    return (np.frombuffer(raw, "<u8", 2 * n).reshape(n, 2), np.frombuffer(raw, "<i8", n, 16 * n), np.frombuffer(raw, "<u4", n, 24 * n), np.frombuffer(raw, "<i4", n, 28 * n))


def travellers(rows: DataFrame, buckets: int, window: int = WINDOW, minimiser: int = MINIMISER, hot: np.ndarray | None = None, hot_buckets: int = 1) -> DataFrame:
    """bucket, rows (binary): what a map task sends to each bucket, a chunk of texts at a time.

    Buckets from 0 hold super-k-mers (``pack_rows``), negative ones the windows of crowded cells (``pack_windows``).
    """
    crowded = np.zeros(CELLS, bool)
    if hot is not None:
        crowded[hot] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best, again, settled, held = WordHashes(), {}, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            strings = [*best, *(a[0] for a in again)]
            sent = np.array([*best.values(), *(a[1:] for a in again)], np.int64).reshape(-1, 4)
            done = np.array(settled, np.int64).reshape(-1, 4)
            by_window = crowded[cells_of(np.ascontiguousarray(sent[:, 0]))]
            if by_window.any():
                yield from _windows([strings[i] for i in np.flatnonzero(by_window).tolist()], sent[by_window], window, hot_buckets)
                strings, sent = [strings[i] for i in np.flatnonzero(~by_window).tolist()], sent[~by_window]
            to = sent[:, 0].view(np.uint64) % np.uint64(buckets) if len(sent) else np.empty(0, np.uint64)
            done_to = _mixed(done[:, 0].astype(np.uint64)) % np.uint64(buckets)  # they are settled wherever they go
            order, done_order = np.argsort(to, kind="stable"), np.argsort(done_to, kind="stable")
            names = np.union1d(to, done_to)
            cuts = np.searchsorted(to[order], names, "left"), np.searchsorted(to[order], names, "right")
            done_cuts = np.searchsorted(done_to[done_order], names, "left"), np.searchsorted(done_to[done_order], names, "right")
            out: tuple[list, list] = ([], [])
            for i, name in enumerate(names.tolist()):
                at = order[cuts[0][i]:cuts[1][i]]
                mine = sent[at]
                out[0].append(name)
                out[1].append(pack_rows([strings[k] for k in at.tolist()], mine[:, 0].view(np.uint64) >> np.uint64(32), mine[:, 1], mine[:, 2], mine[:, 3],
                                        done[done_order[done_cuts[0][i]:done_cuts[1][i]]]))
            if len(names):
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["bucket", "rows"])
            best.clear()
            again.clear()
            settled.clear()

        for b in batches:
            for doc, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                for bucket, a, z in zip(*(x.tolist() for x in super_kmers(h, window, minimiser)), strict=True):
                    packed = b" ".join(words[a:z])
                    other = best.get(packed)
                    if other is None:
                        best[packed] = (bucket, doc, key, a)
                    elif other[1] < doc:
                        settled.append((doc, key, a, z))
                    elif other[1] > doc:
                        settled.append((*other[1:], other[3] + z - a))
                        best[packed] = (bucket, doc, key, a)
                    elif other[2:] != (key, a):  # the same document again: both go on
                        again.append((packed, bucket, doc, key, a))
                held += len(text)
                if held > CHUNK_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    return rows.mapInArrow(tidy(run), "bucket long, rows binary")


def _windows(strings: list[bytes], sent: np.ndarray, window: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The windows of packed strings (rows of minimiser, doc_id, text_key, start) by their hashes, a block for each bucket."""
    hashes, row, place = [], [], []
    for i, packed in enumerate(strings):
        for k, w in enumerate(windows_of(packed, window)):
            hashes.append(xxhash.xxh3_128_digest(w))
            row.append(i)
            place.append(k)
    h = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    row = np.array(row, np.int64)
    docs, keys, starts = sent[row, 1], sent[row, 2], sent[row, 3] + np.array(place, np.int64)
    to = (_mixed(h[:, 0].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(to[order], prepend=-1)), len(order))
    out = [(int(-1 - to[order[a]]), pack_windows(h[order[a:z]], docs[order[a:z]], keys[order[a:z]], starts[order[a:z]])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["bucket", "rows"])


def settle_windows(blobs: list[bytes], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(doc_id, text_key, first word, end word) of windows that also start in a lesser document of the same bucket."""
    parts = [unpack_windows(b) for b in blobs]
    if not parts:
        return []
    h, docs, keys, starts = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((docs, h[:, 1], h[:, 0]))
    h, docs, keys, starts = h[order], docs[order], keys[order], starts[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1))))
    least = np.repeat(docs[first], np.diff(np.append(first, len(docs))))
    gone = docs > least
    # neighbouring windows of one text as one span
    d, k, a = docs[gone], keys[gone].astype(np.int64), starts[gone].astype(np.int64)
    order = np.lexsort((a, k, d))
    d, k, a = d[order], k[order], a[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (a[1:] > a[:-1] + 1))) if len(d) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(d)) - 1
    return list(zip(d[begin].tolist(), k[begin].tolist(), a[begin].tolist(), (a[end] + window).tolist(), strict=True)) if len(d) else []


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """Every window of a packed string, as bytes."""
    raw = np.frombuffer(packed, np.uint8)
    at = np.concatenate(([0], np.flatnonzero(raw == 32) + 1, [len(raw) + 1])).tolist()
    return [packed[at[i]:at[i + window] - 1] for i in range(len(at) - window)]


def settle(group: list[tuple], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(doc_id, text_key, first word, end word) of what is to be removed, from what shares a minimiser: (packed, doc_id, text_key, start)."""
    if len({g[1] for g in group}) < 2:
        return []
    whole: dict[bytes, int] = {}
    for g in group:
        if whole.get(g[0], g[1]) >= g[1]:
            whole[g[0]] = g[1]
    out = [(*g[1:], g[3] + g[0].count(b" ") + 1) for g in group if whole[g[0]] < g[1]]
    left = {g[0]: g for g in group if whole[g[0]] == g[1]}
    if len(left) < 2:
        own = []
    else:
        strings = list(left)
        marked: dict[int, set[int]] = {}
        passes = sum(p.count(b" ") + 2 - window for p in strings) // SORTED + 1
        for k in range(passes):
            entries = sorted((w, whole[p], at, i) for at, p in enumerate(strings) for i, w in enumerate(windows_of(p, window))
                             if passes == 1 or hash(w) % passes == k)
            seen, least = None, 0
            for w, doc, at, i in entries:  # equal windows stand together, the least document first
                if w != seen:
                    seen, least = w, doc
                elif doc > least:
                    marked.setdefault(at, set()).add(i)
        own = [(strings[at], sorted(hit)) for at, hit in marked.items()]
    flagged = dict(own)
    for g in group:
        hit = flagged.get(g[0])
        if hit and whole[g[0]] == g[1]:
            first = prev = hit[0]
            for i in [*hit[1:], None]:
                if i != prev + 1 if i is not None else True:
                    out.append((g[1], g[2], g[3] + first, g[3] + prev + window))
                    first = i
                prev = i
    return out


def spans(rows: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, text_key, start, stop: word spans to remove, of rows (doc_id, text_key, text as binary)."""
    hot, many, size = crowded_cells(rows, window, minimiser, CROWDED)
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    hot_buckets = many * 32 // BUCKET_BYTES + 1
    dealt = travellers(rows, buckets, window, minimiser, hot, hot_buckets).repartition(F.col("bucket")).sortWithinPartitions("bucket")

    def sort_bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack_rows(b) for b in blobs]
        for p in parts:
            yield _spans(p[5].tolist())
        strings = [s for p in parts for s in p[0]]
        minimisers, docs, keys, starts = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(1, 5))
        order = np.argsort(minimisers, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(minimisers[order])) + 1, len(order))
        out, first = [], 0
        docs, keys, starts, order = docs.tolist(), keys.tolist(), starts.tolist(), order.tolist()
        for end in ends.tolist():
            if end - first > 1:
                out += settle([(strings[i], docs[i], keys[i], starts[i]) for i in order[first:end]], window)
            first = end
        yield _spans(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for b in batches:
            for name, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != bucket:
                    yield from done(bucket, blobs)
                    bucket, blobs = name, []
                blobs.append(blob)
        yield from done(bucket, blobs)

    def done(bucket: int | None, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket is not None and bucket < 0:
            yield _spans(settle_windows(blobs, window))
        else:
            yield from sort_bucket(blobs)

    return dealt.mapInArrow(tidy(run), "doc_id long, text_key long, start int, stop int")


def _spans(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text_key", "start", "stop"])


def kept_words(text: bytes, starts: list[int], stops: list[int]) -> tuple[list[bytes], int]:
    """(words outside the spans, number of all words)."""
    words = words_of(text)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.array(starts, np.int64), 1)
    np.add.at(change, np.array(stops, np.int64), -1)
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], len(words)


def _removal(text: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    kept, n, removed = [], [], []
    for t, a, z in zip(text.to_pylist(), starts.to_pylist(), stops.to_pylist(), strict=True):
        words, all_ = kept_words(inflate(t), a or [], z or [])
        kept.append(b" ".join(words))
        n.append(all_)
        removed.append(all_ - len(words))
    trim()
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["kept", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, id_col: str = "doc_id", text_col: str = "text",
                   into: str = "removal") -> DataFrame:
    """All rows and columns of ``docs`` with ``into``: struct<kept: binary, n_words, n_removed>; kept are the kept words, joined by one space.

    A word goes if a window covers it whose words also start somewhere in a row with a smaller id. A null text has no words;
    texts shorter than a window stay as they are. Rows of one id are one document and don't remove from each other; rows with a
    null id count as one document after all others: they lose what any other has and take from none. An empty table gives no
    rows. Very long texts are windows like any other, one text at a time in memory. A column that is named like ``into`` is replaced.
    """
    doc, key = fresh(docs, "doc"), fresh(docs, "key")
    last = F.lit(2**63 - 1)
    keyed = docs.withColumns({doc: F.coalesce(docs[id_col].cast("long"), last), key: F.xxhash64(bytes_of(text_col)).bitwiseAND(F.lit(0xFFFFFFFF))})
    rows = keyed.select(F.col(doc).alias("doc_id"), F.col(key).alias("text_key"), bytes_of(text_col).alias("text"))
    starts, stops = fresh(docs, "starts"), fresh(docs, "stops")
    found = spans(rows, window, minimiser).groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(
        F.collect_set(F.struct("start", "stop")).alias(starts))
    found = found.select(doc, key, F.col(f"{starts}.start").alias(starts), F.col(f"{starts}.stop").alias(stops))
    # Texts meet their spans compressed; whoever doesn't look at the text column doesn't pay for its return.
    small, null = fresh(docs, "small"), fresh(docs, "null")
    sent = keyed.withColumns({small: deflated(bytes_of(text_col)), null: F.col(text_col).isNull()}).drop(text_col)
    joined = sent.join(found.hint("merge"), [doc, key], "left")  # between the two Python steps: a task never holds two workers
    back = F.when(~F.col(null), inflated(F.col(small)).cast("string"))
    removal = F.arrow_udf(_removal, "kept binary, n_words long, n_removed long")(F.col(small), F.col(starts), F.col(stops))
    return joined.withColumns({text_col: back, into: removal}).select(*[c for c in docs.columns if c != into], into)
