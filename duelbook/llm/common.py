"""What the operators of this package share: session set-up, cut points, words, chunked tokenising."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.plans import runtime

#: Rows and bytes of one Arrow batch, so that a worker's memory follows neither the row count nor the usual text length.
BATCH_ROWS, BATCH_BYTES = "1000", "8388608"
CUT = re.compile(r"(?<=\S) (?=\S)")


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package, find the checkpoint folder and bound the Arrow batches (settings a user made stay)."""
    runtime.prepare(spark)
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS),
                                ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: lineage ends here, and a lost
    executor costs nothing that was computed before."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    for made in _MADE.get():
        made.append(table)
    return table


_MADE: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("tables made", default=())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut`` writes inside are removed at the end, except those given to the function that this returns."""
    made: list[DataFrame] = []
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._written_to)
        return table

    token = _MADE.set((*_MADE.get(), made))
    try:
        yield keep
    finally:
        _MADE.reset(token)
        release(*[t for t in made if t._written_to not in kept])


def release(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, once what was made of them is itself written."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(text: str = "text"):
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition function that gives the memory it used back to the system: workers live on into later stages."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Unused memory of Python, of Arrow's pool and of the C library goes to the system."""
    gc.collect()
    trim()


def trim() -> None:
    """The part of ``give_back`` that is cheap enough for every batch of a column function, which isn't told when its task ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def words_of(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of UTF-8 bytes; exactly what ``bytes.split`` cuts at."""
    return text.split()


def deflate(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def inflate(small: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(small)


def deflated(text: Column) -> Column:
    """A binary column compressed, for texts that have to be shuffled."""
    def run(v: pa.Array) -> pa.Array:
        out = pa.array([None if t is None else deflate(t) for t in v.to_pylist()], pa.binary())
        trim()
        return out

    return F.arrow_udf(run, "binary")(text)


def inflated(small: Column) -> Column:
    def run(v: pa.Array) -> pa.Array:
        out = pa.array([None if t is None else inflate(t) for t in v.to_pylist()], pa.binary())
        trim()
        return out

    return F.arrow_udf(run, "binary")(small)


_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]
_ODD = tuple(pair for c in _WHITE for pair in (f" {c}", f"{c} "))
_ODD_ASCII = tuple(p for p in _ODD if p.isascii())


def chunks_of(text: str) -> list[str]:
    """Cut at every single space between two characters that aren't white space; those spaces are left out."""
    if text[:1] == " " or text[-1:] == " " or any(p in text for p in (_ODD_ASCII if text.isascii() else _ODD)):
        return CUT.split(text)
    return text.split(" ")


class ChunkMemo:
    """Tokens of a text, looked up by chunk.

    A single space between two characters that aren't white space always starts a new match of the byte-level
    pattern, so a text is the chunk before its first such space and then chunks led by one space, each tokenised
    alone. ``learn`` gets new chunks, with their space, and returns what to keep for each. At most ``2 * limit`` chunks are
    kept, those of the last use first, so the memory of a worker is bounded; what a text becomes never depends on what is kept.
    """

    def __init__(self, learn: Callable[[list[str]], Iterable[Any]], limit: int = 100_000, longest: int = 200):
        self.learn, self.limit, self.longest = learn, limit, longest
        self.known: dict[str, Any] = {}
        self.before: dict[str, Any] = {}

    def batch(self, texts: list[str]) -> Iterator[list[Any]]:
        """For each text what ``learn`` made of its chunks, in order."""
        if len(self.known) > self.limit:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        split = [chunks_of(t) for t in texts]
        found = [list(map(known.get, c[1:])) for c in split]
        new, once = set(), {}
        for chunks, have in zip(split, found, strict=True):
            if None in have:
                new.update([c for c, h in zip(chunks[1:], have, strict=True) if h is None])
        for c in [c for c in new if c in before]:
            known[c] = before[c]
            new.discard(c)
        ordered = list(new)
        for c, made in zip(ordered, self.learn([" " + c for c in ordered]), strict=True):
            (known if len(c) <= self.longest else once)[c] = made
        heads = self.learn([c[0] for c in split])
        for chunks, have, head in zip(split, found, heads, strict=True):
            yield [head, *(h if h is not None else known[c] if c in known else once[c] for c, h in zip(chunks[1:], have, strict=True))] \
                if None in have else [head, *have]
