"""Byte-level BPE by a finite-state transducer, and its streaming decoder.

A sequence of tokens is what the merges make of a string exactly if no merge crosses the border of two neighbouring
tokens, which the two tokens alone decide. So the merges compile into a transducer over bytes: a path walks down
the trie of the vocabulary, and where a token ends that may follow the path's last one, it may return to the root. The
transducer is determinised while it is used. A state stands for all open paths: the longest trie node that is a suffix
of what was read (every open walk is a suffix of it) and, for each place where such a walk began, the token before it.
An arc tells the one token that ends here on a path without a crossing merge. Which of them belong to the output is
certain where all open paths agree, at the latest one longest token later; long matches give them out there.
The first ``limit`` states get a name and keep their arcs, which covers
the frequent ones; any other is held as it is.

Decoding joins the tokens' bytes through an incremental UTF-8 automaton, which gives out whole characters only.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import ChunkMemo, bytes_of

NONE = -1
FAR = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class Transducer:
    """Encodes one match at a time; ``ranks`` must hold every single byte."""

    #: Bytes of a match after which the certain tokens are given out.
    FLUSH = 1024
    #: Bytes of a match whose states may get names.
    KEEP = 40

    def __init__(self, ranks: dict[bytes, int], limit: int = 100_000):
        self.ranks, self.limit = ranks, limit
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = max(self.token) + 2
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node; the root is 0
        self.ends: dict[int, int] = {}  # node -> token
        self.depth, self.back = [0], [0]  # of each node: its length, its longest proper suffix in the trie
        for token, rank in ranks.items():
            at = 0
            for b in token:
                key = at << 8 | b
                at = self.trie.get(key, 0)
                if not at:
                    at = self.trie[key] = len(self.depth)
                    self.depth.append(self.depth[key >> 8] + 1)
                    self.back.append(0)
            self.ends[at] = rank
        for key, at in sorted(self.trie.items(), key=lambda x: self.depth[x[1]]):
            if key >> 8:
                self.back[at] = self.goto(self.back[key >> 8], key & 255)
        self.ending: dict[int, tuple] = {0: ()}
        self.sides: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        start = (0, (NONE,))
        self.states, self.number, self.arcs = [start], {start: 0}, {}

    def goto(self, node: int, byte: int) -> int:
        while True:
            to = self.trie.get(node << 8 | byte, 0)
            if to or not node:
                return to
            node = self.back[node]

    def tokens_ending(self, node: int) -> tuple:
        """(token, its length) of every token that is a suffix of the node, longest first."""
        found = self.ending.get(node)
        if found is None:
            found = self.tokens_ending(self.back[node])
            if node in self.ends:
                found = ((self.ends[node], self.depth[node]), *found)
            self.ending[node] = found
        return found

    def merged(self, piece: bytes, watch=None) -> list[bytes]:
        """The merges by definition, on a short piece: always the lowest rank, the leftmost of equals."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, FAR), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == FAR:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if watch is not None:
                watch.append((rank, parts[0], parts[-1]))
        return parts

    def outline(self, t: int) -> tuple | None:
        """(left side, right side, regular) of a token, None if merges never make it. A side lists the pieces that stood at
        that end while the token grew: (bytes, rank that made it, rank that took it up). Regular: ranks only rose."""
        if t not in self.sides:
            token, steps = self.token[t], []
            if self.merged(token, steps) != [token]:
                self.sides[t] = None
            else:
                sides = []
                for end, first in ((1, token[:1]), (2, token[-1:])):
                    side, made = [first], [NONE]
                    for s in steps:
                        if s[end] != side[-1]:
                            side.append(s[end])
                            made.append(s[0])
                    sides.append(tuple(zip(side, made, [*made[1:], FAR], strict=True)))
                order = [s[0] for s in steps]
                self.sides[t] = (*sides, order == sorted(order))
        return self.sides[t]

    def follows(self, last: int, t: int) -> bool:
        """No merge crosses from ``last`` into ``t``."""
        key = last * self.size + t
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * self.limit:
                self.pairs.clear()
            known = self.pairs[key] = self._follows(last, t)
        return known

    def _follows(self, last: int, t: int) -> bool:
        right = self.outline(t)
        if last == NONE or right is None:
            return right is not None
        left = self.outline(last)
        regular = left[2] and right[2]
        for a, a_made, a_taken in left[1]:
            for b, b_made, b_taken in right[0]:
                rank = self.ranks.get(a + b)
                if rank is None:
                    continue
                if not regular or rank < a_made or rank < b_made:
                    return self.merged(self.token[last] + self.token[t]) == [self.token[last], self.token[t]]
                if rank < a_taken and rank <= b_taken:  # of equal ranks the left merge goes first
                    return False
        return True

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, token that ends here) of a state and byte, found the first time it is taken."""
        node, before = self.states[state]
        node = self.goto(node, byte)
        before = before[-self.depth[node]:]
        for t, n in self.tokens_ending(node):
            if self.follows(before[-n], t):
                break
        new = (node, (*before, t))
        at = self.number.get(new)
        if at is None:
            at = self.number[new] = len(self.states)
            self.states.append(new)
        found = self.arcs[state << 8 | byte] = at, t
        return found

    def path(self, last: list[int], end: int) -> list[int]:
        """Tokens whose last one ends at byte ``end``; last: the token that ends at each byte."""
        out = []
        while end > 0:
            t = last[end - 1]
            out.append(t)
            end -= len(self.token[t])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one match. A match that is a token as a whole is that token.

        Named states and their arcs are followed as far as they go. From there on, the state is only held, as the node and the
        tokens that end at the bytes before.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last, state, arcs, at = [], 0, self.arcs, 0
        for at, byte in enumerate(piece):  # noqa: B007
            found = arcs.get(state << 8 | byte)
            if found is None:
                if len(self.states) >= self.limit or at > self.KEEP:
                    break
                found = self.arc(state, byte)
            state = found[0]
            last.append(found[1])
        else:
            return self.path(last, len(last))
        out, edge, node, size = [], NONE, self.states[state][0], self.size
        trie, ending, pairs = self.trie, self.ending, self.pairs
        for byte in piece[at:]:
            node = trie.get(node << 8 | byte) or self.goto(node, byte)
            n = len(last)
            for t, length in ending.get(node) or self.tokens_ending(node):
                before = last[n - length] if length <= n else edge
                fits = pairs.get(before * size + t)
                if fits or fits is None and self.follows(before, t):
                    break
            last.append(t)
            if n >= self.FLUSH:
                opened = [self.path(last, n + 1 - k) for k in range(self.depth[node] + 1)]
                same = 0
                while all(len(p) > same and p[same] == opened[0][same] for p in opened):
                    same += 1
                if same:
                    out += opened[0][:same]
                    edge = out[-1]
                    last = last[sum(len(self.token[t]) for t in opened[0][:same]):]
        return out + self.path(last, len(last))


def _utf8() -> list[list[int]]:
    """Automaton of well-formed UTF-8: next state by state and byte, NONE where the sequence breaks. State 0: between characters."""
    spans = {0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5),
                 (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
             1: [(0x80, 0xBF, 0)], 2: [(0xA0, 0xBF, 1)], 3: [(0x80, 0xBF, 1)], 4: [(0x80, 0x9F, 1)], 5: [(0x90, 0xBF, 3)], 6: [(0x80, 0xBF, 3)],
             7: [(0x80, 0x8F, 3)]}
    table = [[NONE] * 256 for _ in spans]
    for state, of in spans.items():
        for low, high, to in of:
            table[state][low:high + 1] = [to] * (high + 1 - low)
    return table


class Utf8Stream:
    """Takes bytes piece by piece and gives out whole characters; a broken sequence passes as it is at its break."""

    TABLE = _utf8()

    def __init__(self):
        self.state, self.held, self.known = 0, b"", {}

    def step(self, state: int, piece: bytes) -> tuple[int, int]:
        """(state after the piece, bytes of the piece after its last border; -1: no border in it)."""
        border = -1
        for i, b in enumerate(piece):
            to = self.TABLE[state][b]
            if to == NONE:  # whatever was open ends here; the byte may begin anew
                border = i
                to = self.TABLE[0][b]
                if to == NONE:
                    to = 0
            if to == 0:
                border = i + 1
            state = to
        return state, len(piece) - border if border >= 0 else -1

    def feed(self, piece: bytes) -> bytes:
        key = (self.state, piece)
        found = self.known.get(key)
        if found is None:
            found = self.step(self.state, piece)
            if len(self.known) < 200_000:
                self.known[key] = found
        self.state, after = found
        if after == 0 and not self.held:
            return piece
        if after < 0:
            self.held += piece
            return b""
        at = len(piece) - after
        out, self.held = self.held + piece[:at], piece[at:]
        return out

    def end(self) -> bytes:
        """What is still open, as it is."""
        out, self.held, self.state = self.held, b"", 0
        return out


def between(token: dict[int, bytes]) -> set[int]:
    """Ids that lead the automaton from between two characters to between two characters: tokens of whole characters."""
    stream = Utf8Stream()
    return {i for i, piece in token.items() if stream.step(0, piece) == (0, 0) and piece.decode("utf-8", "ignore").encode() == piece}


def decode_stream(ids: list[int], token: dict[int, bytes], stream: Utf8Stream | None = None, whole: set[int] = frozenset(), run: int = 4096) -> Iterator[bytes]:
    """Bytes of the ids, each piece ending between two characters. An id that isn't in the vocabulary raises KeyError.

    Runs of ids in ``whole`` (see ``between``) pass at once while the automaton stands between two characters.
    """
    stream = stream or Utf8Stream()
    for at in range(0, len(ids), run):
        part = ids[at:at + run]
        if stream.state == 0 and not stream.held and whole.issuperset(part):
            yield b"".join(map(token.__getitem__, part))
            continue
        for i in part:
            if i in whole and stream.state == 0:
                yield token[i]
            elif out := stream.feed(token[i]):
                yield out
    if out := stream.end():
        yield out


@lru_cache(4)
def _coder(path: str, pattern: str) -> tuple[Transducer, ChunkMemo, Utf8Stream, set[int]]:
    t, match, words, before = Transducer(read_ranks(path)), regex.compile(pattern), {}, {}

    def word(m: str) -> bytes:
        found = words.get(m)
        if found is None:
            found = before.get(m)
            if found is None:
                ids = t.encode(m.encode("utf-8", "replace"))
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(m) <= 100:
                words[m] = found
        return found

    def learn(chunks: list[str]) -> list[bytes]:
        if len(words) > 100_000:
            before.clear()
            before.update(words)
            words.clear()
        return [b"".join([word(m) for m in match.findall(c)]) for c in chunks]

    return t, ChunkMemo(learn, 400_000), Utf8Stream(), between(t.token)


def encode(text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Ids of a UTF-8 binary column, little-endian unsigned 32-bit; null gives null, an empty text no bytes.

    ``pattern`` must be the usual byte-level one: a single space between two characters that aren't white space has to start
    a match, as texts are looked up by such chunks.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    @F.arrow_udf("binary")
    def ids(v: pa.Array) -> pa.Array:
        memo = _coder(path, pattern)[1]
        raw = v.to_pylist()
        found = memo.batch([(t or b"").decode("utf-8", "replace") for t in raw])
        return pa.array([None if t is None else b"".join(f) for t, f in zip(raw, found, strict=True)], pa.binary())

    return ids(text)


def decode(ids: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Bytes that little-endian unsigned 32-bit ids stand for; null gives null."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    @F.arrow_udf("binary")
    def text(v: pa.Array) -> pa.Array:
        t, _, stream, whole = _coder(path, pattern)
        return pa.array([None if r is None else b"".join(decode_stream(np.frombuffer(r, "<u4").tolist(), t.token, stream, whole)) for r in v.to_pylist()],
                        pa.binary())

    return text(ids)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary), decoded (binary) of every row. Only the id and text columns are read; null text is empty,
    repeated rows and null ids stay as they are, an empty table gives no rows. Nothing is shuffled."""
    rows = docs.select(docs[id_col].alias("doc_id"), bytes_of(text_col).alias("text"))
    return rows.select("doc_id", encode(F.col("text"), path).alias("ids")).withColumn("decoded", decode(F.col("ids"), path))
