"""Packing: best-fit decreasing into token windows, found by a segment tree over remaining capacities.

Every document is tokenised and closed with an end id. A document longer than a window is first cut into full
windows; what remains of each document is placed, longest first, into the open window with the least room that still
fits. Each map task packs its own documents, some millions of ids at a time, so nothing is shuffled, a hot source or a
group of copies means nothing to the work, and memory is bounded by ``chunk_ids`` plus one text. Windows that
stay rather empty at the end of a chunk are cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from duelbook.llm.byte_bpe import read_ranks
from duelbook.llm.common import CUT, bytes_of, tidy

WINDOW, END_ID = 2048, 1
#: Ids that a task packs together, and the share of a window that may stay empty before it is cut up.
CHUNK_IDS, SLACK = 2_000_000, 1 / 64
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


class Capacities:
    """Open windows by remaining capacity; a tree of flags finds the least capacity that is large enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)  # number of windows below each node
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        at = self.size + room
        while at:
            self.tree[at] += n
            at >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with at least ``length`` free, or None."""
        at = self.size + length
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):  # climb until a right sibling holds something
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each length, placed longest first (ties: in the given order)."""
    open_, placed, count = Capacities(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = open_.take(n)
        if found is None:
            found, count = (window, count), count + 1
        room, w = found
        placed[i] = (w, window - room)
        if room > n:
            open_.put(room - n, w)
    return placed


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def arrange(docs: list[int], window: int = WINDOW, slack: float = SLACK) -> list[tuple[int, int, int, int, int, int]]:
    """(document, start, length, sequence, offset, sequence length) of every piece, by document and start.

    docs: ids of each document. Full windows first, then best-fit decreasing of the rests.
    """
    out, sequence = [], 0
    rests = []
    for d, n in enumerate(docs):
        for start in range(0, n - window + 1, window):
            out.append((d, start, window, sequence, 0, window))
            sequence += 1
        if n % window:
            rests.append((d, n - n % window, n % window))
    by_window: dict[int, list] = {}
    for (d, start, n), (w, offset) in zip(rests, best_fit([r[2] for r in rests], window), strict=True):
        by_window.setdefault(w, []).append((offset, d, start, n))
    for w in sorted(by_window):
        pieces = sorted(by_window[w])
        filled = pieces[-1][0] + pieces[-1][3]
        if window - filled <= slack * window:
            out += [(d, start, n, sequence, offset, filled) for offset, d, start, n in pieces]
            sequence += 1
            continue
        ends = iter(np.cumsum(powers(filled)).tolist())
        begin, end = 0, next(ends)
        for offset, d, start, n in pieces:
            while n:
                if offset == end:
                    begin, end, sequence = end, next(ends), sequence + 1
                part = min(n, end - offset)
                out.append((d, start, part, sequence, offset - begin, end - begin))
                offset, start, n = offset + part, start + part, n - part
        sequence += 1
    return sorted(out)


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file: strings that are cut out of a text before anything else, and their ids."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    odd = [t["content"] for t in found if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"added tokens that look at their neighbours are not supported: {odd}")
    return {t["content"]: t["id"] for t in found if t["content"]}


class Encoder:
    """Ids of a text as the tokenizer file gives them by default: added tokens first, what lies between by the rank file."""

    def __init__(self, ranks: str, added: dict[str, int] | None = None, end_id: int | None = END_ID, pattern: str = public_tokenizers.PATTERN):
        import tiktoken

        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={}).encode_ordinary
        self.added = {t: int(i).to_bytes(4, "little") for t, i in (added or {}).items()}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in self.added)) if self.added else None  # the first of the file wins
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, closed by the end id."""
        if not self.added or not any(t in text for t in self.added):
            return self._plain(text) + self.end
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [self._plain(text[at:found.start()]), self.added[found[0]]]
            at = found.end()
        return b"".join(out) + self._plain(text[at:]) + self.end

    def _plain(self, text: str) -> bytes:
        return b"".join(np.array(self.encode(text[a:b]), "<u4").tobytes() for a, b in spans(text))


def spans(text: str, longest: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Cut a very long text at single spaces between two characters that aren't white space, where a match starts anyway."""
    at = 0
    while len(text) - at > longest:
        found = CUT.search(text, at + longest)
        if not found:
            break
        yield at, found.start()
        at = found.start()
    yield at, len(text)


def pack(docs: DataFrame, ranks: str | None = None, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None,
         chunk_ids: int = CHUNK_IDS, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``SCHEMA``; ``ids`` are the piece's ids, little-endian unsigned 32-bit.

    Only the id and text columns are read, whatever else the table has or how it is called. A null or empty text is
    the end id alone. Rows with a null id or repeated rows are documents like any other. An empty table gives no rows.
    A sequence longer than ``(1 - slack) * window`` is meant to be padded to the window; every shorter one has a
    length that is a power of two. ``sequence_id`` is unique over the result: the task, then the order within it.
    ``ranks`` is the path of a rank file and ``tokenizer`` that of the tokenizer file with the same vocabulary, both on the workers; the
    defaults are those of ``byte_bpe_50k``. A string of a text that is one of the tokenizer's added tokens (``<|endoftext|>``) has that
    token's id, as ``tokenizers`` gives it by default; with ``ranks`` alone there are none. Texts of any length: beyond a million
    characters one is encoded in spans that begin where a match begins anyway.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    file = tokenizer or (None if ranks else public_tokenizers.path("byte_bpe_50k.json"))
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), bytes_of(text_col).alias("text"))

    def flush(ids: list, raw: list[bytes], first: int) -> pa.RecordBatch:
        rows = arrange([len(r) // 4 for r in raw], window, slack)
        columns = [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                   pa.array([r[2] for r in rows], pa.int64()),
                   pa.array([raw[r[0]][4 * r[1]:4 * (r[1] + r[2])] for r in rows], pa.binary()),
                   pa.array([len(raw[r[0]]) // 4 for r in rows], pa.int64()), pa.array([first + r[3] for r in rows], pa.int64()),
                   pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")]), max(r[3] for r in rows) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 36
        encode = Encoder(path, added_tokens(file) if file else None, end_id)  # goes with the task
        ids, raw, n = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                raw.append(encode(t.decode("utf-8", "replace")))
                n += len(raw[-1]) // 4
                if n >= chunk_ids:
                    out, used = flush(ids, raw, first)
                    yield out
                    ids, raw, n, first = [], [], 0, first + used
        if ids:
            yield flush(ids, raw, first)[0]

    return source.mapInArrow(tidy(run), SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (binary) and the document of each piece, in order.

    Pieces of a null doc_id and of repeated rows are pieces like any other; no pieces give no sequences.
    """
    from pyspark.sql import functions as F

    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"], x["start"], x["length"], x["offset"])).alias("pieces"))
