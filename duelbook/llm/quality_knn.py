"""Quality classifier: similarity-weighted vote of the nearest labelled documents in a latent-semantic space.

A text's terms are the trigrams of its character shapes (letters, capitals, digits, white space, each sign), its words
(hashed, of letters and digits only, in small letters), and a few terms that tell how much it repeats itself and how long its words and lines are.
Document frequencies come from all documents.
A bounded sample of labelled documents gives the latent-semantic basis (randomised SVD of their tf-idf rows) and
the labelled vectors, both broadcast; every document is projected, multiplied with all labelled vectors block by block, and its
nearest ones vote with their cosine. Votes count by class size, so the score is the chance of label 1 where both are
equally frequent.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import bytes_of, prepare, tidy, trim

#: Bound of the sample: labelled documents of each class that are learnt from (the least by a hash of their id).
SAMPLE = 2048
SHAPES, LATENT, NEIGHBOURS, THRESHOLD, FOLDS = 2048, 48, 25, 0.3, 5
#: Terms behind the shapes: a level of 16 for each measure.
MEASURES, LEVELS = 6, 16
#: Terms behind the measures: hashed words.
WORDS = 4096
TERMS = SHAPES + MEASURES * LEVELS + WORDS


def _shape_table() -> bytes:
    def of(b: int) -> int:
        if 97 <= b <= 122 or b >= 128:
            return 1
        if 65 <= b <= 90:
            return 2
        if 48 <= b <= 57:
            return 3
        if b in b"\n\r":
            return 4
        if b <= 32:
            return 5
        return 6 + b % 58
    return bytes(map(of, range(256)))


_SHAPE = _shape_table()
#: Letters (small), digits and all bytes >= 128; the rest parts words.
_WORD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def _level(share: float) -> int:
    return min(LEVELS - 1, max(0, int(share * LEVELS)))


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(term, weight) of a whole text: 1 + log of each shape trigram's count, and its level in each measure, and 1 + log of each word's count."""
    if not text:
        return np.empty(0, np.int64), np.empty(0)
    a = np.frombuffer(text.translate(_SHAPE), np.uint8).astype(np.int64)
    code = (a[:-2] * 4096 + a[1:-1] * 64 + a[2:]) * 40503 % 65537 % SHAPES
    counts = np.bincount(code, minlength=SHAPES)
    at = np.flatnonzero(counts)
    weight = 1 + np.log(counts[at])
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    letters = int(np.count_nonzero(a <= 2))
    shares = (len(set(words)) / n,  # how many words are new
              len({w for w in zip(words, words[1:], strict=False)}) / n,
              len(set(lines)) / len(lines),
              letters / len(a),
              int(np.count_nonzero(a == 2)) / max(1, letters),
              min(1.0, len(text) / n / 16))
    extra = np.array([SHAPES + m * LEVELS + _level(s) for m, s in enumerate(shares)])
    heavy = max(1.0, float(np.sqrt((weight**2).sum() / MEASURES)))  # a measure weighs as much as the shapes together
    counted = Counter(text.translate(_WORD).split())
    sums = np.bincount([zlib.crc32(w) % WORDS for w in counted], list(counted.values()), WORDS) if counted else np.zeros(WORDS)
    said = np.flatnonzero(sums)
    spoken = 1 + np.log(sums[said])
    spoken *= np.sqrt((weight**2).sum() / max(1.0, (spoken**2).sum()))  # and so do the words
    return np.concatenate((at, extra, TERMS - WORDS + said)), np.concatenate((weight, np.full(MEASURES, heavy), spoken))


@dataclass
class Model:
    """idf of all terms, latent basis, unit vectors and labels of the labelled documents, vote of each class."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: tuple[float, float]

    def project(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(found), self.basis.shape[1]), np.float32)
        for i, (t, w) in enumerate(found):
            if len(t):
                w = w * self.idf[t]
                norm = np.sqrt((w**2).sum())
                if norm > 0:
                    out[i] = (w / norm) @ self.basis[t]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    def score(self, texts: list[bytes], k: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = self.project([terms(t) for t in texts]) @ self.vectors.T
        k = min(k, len(self.labels))
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, at, axis=1), 0, None).astype(np.float64) ** 8
        label = self.labels[at]
        one, zero = (weight * label).sum(axis=1) * self.votes[1], (weight * (1 - label)).sum(axis=1) * self.votes[0]
        return np.where(one + zero > 0, one / np.where(one + zero > 0, one + zero, 1), 0.5)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents with each term) over all rows of one binary column: a row per task and term is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TERMS + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                seen[terms(t)[0]] += 1
                seen[TERMS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for r in texts.mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # TERMS + 1 rows at most
        out[r["term"]] = r["n"]
    return int(out[TERMS]), out[:TERMS]


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE,
        latent: int = LATENT, folds: int = FOLDS) -> Model:
    """Learn from documents whose label is 0 or 1 (several labels of one id: the least; several texts: that of the least hash) and
    that aren't held out."""
    n, seen = document_frequencies(docs.select(bytes_of(text_col)))
    idf = np.log((1 + n) / (1 + seen)) + 1
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(
        ~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.min("y").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("y = 0").orderBy(*order).limit(sample).unionByName(known.where("y = 1").orderBy(*order).limit(sample))
    rows = docs.select(docs[id_col].alias("doc_id"), bytes_of(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Copies of an id are combined before they travel; 2 * sample rows at most are left.
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("doc_id", "y", "least.text")
    schema = "doc_id long, y int, term array<long>, weight array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in found], pa.list_(pa.int64())),
                                              pa.array([w for _, w in found], pa.list_(pa.float64()))], ["doc_id", "y", "term", "weight"])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(tidy(run), schema).toArrow().sort_by("doc_id")
    x = np.zeros((got.num_rows, TERMS), np.float32)
    found = [(np.array(t, np.int64), np.array(w)) for t, w in zip(got["term"].to_pylist(), got["weight"].to_pylist(), strict=True)]
    for i, (t, w) in enumerate(found):
        if len(t):
            w = w * idf[t]
            x[i, t] = w / np.sqrt((w**2).sum())
    basis = _basis(x, min(latent, max(1, got.num_rows)))
    y = np.array(got["y"].to_pylist(), np.int64)
    model = Model(idf, basis, np.zeros((0, basis.shape[1]), np.float32), y, (1 / max(1, int((y == 0).sum())), 1 / max(1, int((y == 1).sum()))))
    model.vectors = model.project(found)
    return model


def _basis(x: np.ndarray, latent: int) -> np.ndarray:
    """Leading right singular vectors of the rows, by subspace iteration."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], latent + 8)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :latent].astype(np.float32)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each whole text, as a column for ``docs``; null and empty texts have no neighbours and score 0.5. Nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the terms

    def run(v: pa.Array) -> pa.Array:
        raw = v.to_pylist()
        out = pa.array(np.concatenate([shared.value.score(raw[i:i + 256]) for i in range(0, len(raw), 256)] or [np.empty(0)]), pa.float64())
        del raw
        trim()
        return out

    return F.arrow_udf(run, "double")(bytes_of(text_col))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Only the id and text of ``docs`` are read; repeated rows score alike, a
    null id is never held out, an empty table gives no rows, and without any label every score is 0.5. A very long text is read
    whole, one at a time. Of labelled documents that are equally near at the last place of the vote, any may have it."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    scored = rows.withColumn("score", score(rows, fit(rows, labels.select(F.col("doc_id"), F.col("quality")))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
