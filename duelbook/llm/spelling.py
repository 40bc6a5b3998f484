"""Spelling variants: words one edit apart, grouped under their frequent forms.

The vocabulary is indexed by position: for each position and letter, a bit set of the words that have the letter there. One word is
compared with a whole index at once: as its letters are read, the set of the words that agree so far, and the sets of those
that differ by one replaced, one additional or one missing letter, go on together by word-parallel AND and OR, the latter two
with positions shifted by one.

Words meet only in groups. If two words are one edit apart and the shorter has b letters, there is a place e in 0 to b - 1 such that they
share the first e and the last b - 1 - e letters. Each word goes to the groups of the lower and the upper half of these places,
named by the letters that are shared wherever e lies within. A group that is too large is cut in halves again; at a single place there are no
more words than ways to write one or two letters, so groups are bounded and nothing is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import bytes_of, cut, release, tidy

#: Words: their least length and number of occurrences; how many times as frequent as a word its form must be.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: One in so many occurrences (by document and word) loses a letter.
LOSS = 199
#: Words in a group before it is cut in halves; entries of a counter before it is handed on.
GROUP, COUNTED = 2048, 200_000
LETTERS = "A-Za-zÀ-ÿ"


class PositionIndex:
    """Bit sets of words by position and letter; bit i is word i."""

    def __init__(self, words: list[str]):
        self.words, self.all = words, (1 << len(words)) - 1
        self.at: dict[tuple[int, str], int] = {}
        self.length: dict[int, int] = {}
        for i, w in enumerate(words):
            bit = 1 << i
            self.length[len(w)] = self.length.get(len(w), 0) | bit
            for p, letter in enumerate(w):
                self.at[p, letter] = self.at.get((p, letter), 0) | bit

    def near(self, word: str) -> int:
        """The set of indexed words that differ from ``word`` by exactly one replaced, inserted or deleted letter."""
        at, n = self.at, len(word)
        same, replaced, longer, shorter = self.all, 0, 0, 0
        for p, letter in enumerate(word):
            here = at.get((p, letter), 0)
            longer = (longer | same) & at.get((p + 1, letter), 0)  # words with one more letter before this one
            shorter = (shorter & at.get((p - 1, letter), 0)) | same  # words that leave out a letter up to this one
            replaced = (replaced & here) | (same & ~here)
            same &= here
            if not (same or replaced or longer or shorter):
                return 0
        longer |= same
        # words too short to have a letter at a place drop out here, with those that go on
        return (replaced & self.length.get(n, 0)) | (longer & self.length.get(n + 1, 0)) | (shorter & self.length.get(n - 1, 0))

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Each near pair of indexed words once."""
        for i, w in enumerate(self.words):
            rest = self.near(w) >> i + 1
            while rest:
                low = rest & -rest
                yield i, i + low.bit_length()
                rest ^= low


def occurrences(docs: DataFrame, length: int = LENGTH, loss: int = LOSS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: all words of ``length`` letters or more after the loss of letters, with their occurrences in all texts."""
    runs = re.compile(f"[{LETTERS}]{{{length},}}")  # a run is maximal, and shorter ones count for nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(runs.findall(text.lower().decode(errors="replace"))).items():  # of bytes: A-Z only
                    h = zlib.crc32(word.encode(), prefix)
                    if h % loss == 0:
                        p = h % len(word)
                        word = word[:p] + word[p + 1:]
                        if len(word) < length:
                            continue
                    count[word] += n
            if len(count) > COUNTED:
                yield _counted(count)
                count = Counter()
        if count:
            yield _counted(count)

    rows = docs.select(docs[id_col].cast("long").alias("id"), bytes_of(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(count: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])


def _named(places: DataFrame) -> DataFrame:
    """Group keys: the letters shared by all words whose edit lies at one of the places lo to hi."""
    return places.withColumn("key", F.xxhash64("b", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("right(word, b - 1 - hi)")))


def _halves(places: DataFrame) -> DataFrame:
    parts = "explode(if(lo < hi, array(struct(lo, (lo + hi) div 2 as hi), struct((lo + hi) div 2 + 1 as lo, hi)), array(struct(lo, hi))))"
    return places.select("word", "n", "b", F.expr(parts).alias("half")).selectExpr("word", "n", "b", "cast(half.lo as int) as lo", "cast(half.hi as int) as hi")


def groups(words: DataFrame, largest: int = GROUP) -> DataFrame:
    """members (word, n) of every group of two words or more; each pair of words one edit apart is in at least one."""
    lengths = words.select("word", "n", F.explode(F.expr("array(char_length(word), char_length(word) - 1)")).alias("b")).where("b > 0")
    open_ = cut(_named(_halves(lengths.selectExpr("word", "n", "b", "0 as lo", "b - 1 as hi"))))
    ready = None
    while True:
        sizes = cut(open_.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        sized = open_.join(sizes, "key")
        found = sized.where((F.col("m") <= largest) | (F.col("lo") == F.col("hi"))).select("key", "word", "n")
        ready = found if ready is None else ready.unionByName(found)
        if sizes.where(F.col("m") > largest).isEmpty():
            break
        large = cut(_named(_halves(sized.where((F.col("m") > largest) & (F.col("lo") < F.col("hi"))))))
        if large.isEmpty():
            break
        open_ = large
    return ready.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("members"))


def near_pairs(words: DataFrame, largest: int = GROUP) -> DataFrame:
    """a, a_n, b, b_n: every pair of words that differ by exactly one inserted, deleted or replaced letter, once (a < b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for members in batch.column(0).to_pylist():
                members.sort(key=lambda m: m["word"])
                for i, j in PositionIndex([m["word"] for m in members]).pairs():
                    out.append((members[i]["word"], members[i]["n"], members[j]["word"], members[j]["n"]))
                if len(out) > 50_000:
                    yield _pairs(out)
                    out = []
            yield _pairs(out)

    return groups(words, largest).select("members").mapInArrow(tidy(run), "a string, a_n long, b string, b_n long").distinct()


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["a", "a_n", "b", "b_n"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms. Chains double in length each round; a form is more frequent than its word, so they end."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        done = further.where("moved").isEmpty()
        release(at)
        at = further
        if done:
            return at.select("word", "root")


def variants(docs: DataFrame, length: int = LENGTH, least: int = OCCURRENCES, ratio: int = RATIO, loss: int = LOSS, largest: int = GROUP,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``length`` letters and ``least`` occurrences or more.

    form: the most frequent word one edit away (ties: the first in code-point order), if at least ``ratio`` times as frequent, else null.
    root: where forms lead in the end, the word itself without any. Null, empty and white texts have no words; a null id counts as an empty
    one in the loss of letters. Repeated rows count each time. Texts and words may be of any length. Other columns are not read; an
    empty table gives no rows.
    """
    words = cut(occurrences(docs, length, loss, id_col, text_col).where(F.col("n") >= least))
    return group_words(words, ratio, largest)


def group_words(words: DataFrame, ratio: int = RATIO, largest: int = GROUP) -> DataFrame:
    """The same for a vocabulary: word (distinct, not null), n."""
    pairs = cut(near_pairs(words.select("word", "n"), largest))
    both = pairs.selectExpr("a as word", "b as near", "b_n as near_n").unionByName(pairs.selectExpr("b as word", "a as near", "a_n as near_n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.select("word", "n").join(best, "word", "left")
    formed = F.expr(f"-best.less >= {int(ratio)} * n")
    known = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"),
                             F.when(formed, -F.col("best.less")).alias("form_n")))
    ends = roots(known.where("form is not null"))
    release(pairs)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
