"""Substring dedup (3), MinHash near-duplicates (8) and components."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from duelbook.llm import minhash, superkmers
from duelbook.llm import queries as q
from duelbook.llm.components import components
from tests_llm_helpers import brute_components, brute_repeats, words

SF = "/root/testdata/sf0.001"
LAST = 2**63 - 1


def test_op3_query(llm):
    docs = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_repeats(docs)
    got = q.op3_super_kmers(llm, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        kept, n = want[r["doc_id"]][0]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_repeats_awkward(awkward, nothing):
    docs = [(LAST if r["doc_id"] is None else r["doc_id"], r["text"]) for r in awkward.collect()]
    want = brute_repeats(docs)
    out = superkmers.remove_repeats(awkward)
    assert set(out.columns) == set(awkward.columns) and out.count() == awkward.count()
    for r in out.collect():
        assert (bytes(r["removal"]["kept"]), r["removal"]["n_words"]) in [(b" ".join(k), n) for k, n in want[LAST if r["doc_id"] is None else r["doc_id"]]]
    assert superkmers.remove_repeats(nothing).count() == 0


def test_repeats_with_tiny_chunks(llm, monkeypatch):
    """However texts are dealt to tasks, chunks and sorting passes, the result is the same."""
    rng = random.Random(8)
    passages = [words(rng, 18, 50) for _ in range(6)]
    docs = [(i, " ".join(rng.choice([words(rng, 9, 30), rng.choice(passages)]) for _ in range(6))) for i in range(120)]
    docs += [(200 + i, docs[7][1]) for i in range(60)]
    want = brute_repeats(docs)
    df = llm.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(superkmers, "CHUNK_BYTES", 500)
    for parts in (1, 7):
        got = superkmers.remove_repeats(df.repartition(parts)).collect()
        assert all(bytes(r["removal"]["kept"]) == b" ".join(want[r["doc_id"]][0][0]) for r in got)


def test_settle_in_passes(monkeypatch):
    rng = random.Random(4)
    group = [(words(rng, rng.randint(13, 20), 3).encode(), d, 0, 0) for d in range(300)]
    once = sorted(superkmers.settle(group))
    monkeypatch.setattr(superkmers, "SORTED", 100)
    assert sorted(superkmers.settle(group)) == once


def test_super_kmers_cover_every_window():
    h = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    _, first, stop = superkmers.super_kmers(h)
    covered = [w for a, z in zip(first, stop, strict=True) for w in range(a, z - superkmers.WINDOW + 1)]
    assert covered == list(range(500 - superkmers.WINDOW + 1))
    assert len(superkmers.super_kmers(h[:12])[0]) == 0


def check_components(rows, docs):
    want, sizes = brute_components(docs)
    for r in rows:
        d = LAST if r["doc_id"] is None else r["doc_id"]
        got = LAST if r["component_id"] is None else r["component_id"]
        assert (d, got, r["n_shingles"]) in {(d, c, n) for c, n in zip(want[d], sizes[d], strict=True)}
        assert r["kept"] == (d == got)


def test_op8_query(llm):
    docs = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = q.op8_minhash(llm, SF).collect()
    assert len(rows) == len(docs)
    check_components(rows, docs)


def test_near_duplicates_awkward(awkward, nothing):
    docs = [(LAST if r["doc_id"] is None else r["doc_id"], r["text"]) for r in awkward.collect()]
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == len(docs)
    check_components(rows, docs)
    assert minhash.near_duplicates(nothing).count() == 0
    one = minhash.one_of_each(awkward)
    assert one.columns == awkward.columns
    ids = sorted(str(r["doc_id"]) for r in one.collect())
    assert ids == sorted(map(str, [1, 2, 4, 5, 6, 7, 8, None, 10, 11]))
    assert minhash.one_of_each(nothing).count() == 0


def test_chains_and_hubs(llm):
    """A chain of copies whose ends are unlike, many copies of one text, and texts that share a passage but not enough of it."""
    rng = random.Random(6)
    text = words(rng, 200).split()
    docs = []
    for i in range(30):
        docs.append((1000 - i, " ".join(text)))
        for _ in range(3):
            text[rng.randrange(len(text))] = f"n{rng.random()}"
    base = words(rng, 120)
    docs += [(2000 + i, base + f" x{i}") for i in range(80)] + [(3000 + i, base) for i in range(80)]
    shared = words(rng, 60)
    docs += [(4000 + i, shared + " " + words(rng, 40)) for i in range(40)]
    rng.shuffle(docs)
    check_components(minhash.near_duplicates(llm.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect(), docs)


def test_later_centres_find_every_link(llm):
    """With one bin per band and few bands most classes share buckets; links then hang on the later centres."""
    rng = random.Random(9)
    docs = [(i, words(rng, 12, 6)) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " end") for i in range(60)]
    df = llm.createDataFrame(docs, "doc_id long, text string")
    check_components(minhash.near_duplicates(df, bins=64, band_rows=1).collect(), docs)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    orders = minhash._orders(128)
    for n in (3, 20, 2000):
        same = []
        for _ in range(60):
            x = rng.integers(0, 2**64, n * 5 // 4 + 1, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n // 5:])
            same.append((minhash.signature(a, orders) == minhash.signature(b, orders)).mean())
        inter, uni = minhash.common(a.tobytes(), b.tobytes())
        assert abs(np.mean(same) - inter / uni) < 0.08


def test_components(llm):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (1, 0)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(llm.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_a_minimiser_in_a_third_of_all_documents(llm, monkeypatch):
    """Crowded minimisers go window by window; the result is that of brute force, wherever the bound lies."""
    rng = random.Random(12)
    core = words(rng, 3, 9)
    docs = []
    for i in range(240):
        own = [words(rng, rng.randint(8, 20), 200) for _ in range(3)]
        if i % 3 == 0:
            own.insert(rng.randrange(4), f"{words(rng, 6, 4)} {core} {words(rng, 6, 4)} {core} {words(rng, 12, 3)}")
        docs.append((i // 2 if i % 7 == 0 else i, " ".join(own)))
    docs += [(1000 + i, docs[3 * i][1]) for i in range(40)]
    want = brute_repeats(docs)
    df = llm.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(superkmers, "CHUNK_BYTES", 3000)
    rows = df.select("doc_id", F.lit(0).alias("text_key"), F.col("text").cast("binary").alias("text"))
    for bound in (10**9, 2000, 0):
        monkeypatch.setattr(superkmers, "CROWDED", bound)
        hot, many, size = superkmers.crowded_cells(rows, crowded=bound)
        assert (len(hot) > 0) == (bound < 10**9) and (many > 0) == (len(hot) > 0) and size == sum(len(t) for _, t in docs)
        got = superkmers.remove_repeats(df).collect()
        assert all((bytes(r["removal"]["kept"]), r["removal"]["n_words"]) in [(b" ".join(k), n) for k, n in want[r["doc_id"]]] for r in got) and len(got) == len(docs)
