"""Spelling variants (11), SimHash near-duplicates (12) and centroid clustering (13)."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from duelbook.llm import centroids, simhash, spelling
from duelbook.llm import queries as q
from tests_llm_helpers import words

SF = "/root/testdata/sf0.001"


# ---- 12


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, threshold=2):
    """fp -> least fp reachable, by all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def brute_simhash(docs):
    fp = [brute_fingerprint(t) for _, t in docs]
    classes = brute_classes(fp)
    least = {}
    for (d, _), f in zip(docs, fp, strict=True):
        if d is not None:
            least[classes[f]] = min(d, least.get(classes[f], d))
    return Counter((d, f"{f:016x}", least.get(classes[f])) for (d, _), f in zip(docs, fp, strict=True))


def test_op12_query(llm):
    docs = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, q.op12_simhash(llm, SF).collect())) == brute_simhash(docs)


def test_simhash_awkward(awkward, nothing, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert Counter(map(tuple, simhash.near_duplicates(awkward).collect())) == brute_simhash(docs)
    assert simhash.near_duplicates(nothing).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(awkward, threshold=1)
    monkeypatch.setattr(simhash, "CHUNK", 50)  # parts of a long text
    assert all(simhash.fingerprint((t or "").encode()) % (1 << 64) == brute_fingerprint(t) for _, t in docs if t is None or len(t) < 9000)


def test_perfect_codes_have_one_home():
    for p in set(simhash.PIECES):
        piece = simhash.Piece(*p, 2)
        assert (piece.within[0] == 1).all()
    assert sum(p[0] for p in simhash.PIECES) == 64


@pytest.mark.parametrize("limit", [256, 2])
def test_links_are_all_pairs(llm, limit):
    """Random families of fingerprints, some within the threshold; crowded anchors give the same components."""
    rng = random.Random(limit)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            f = base
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = simhash.links(llm.createDataFrame(signed, "fp long"), home_limit=limit).collect()
    unsigned = [(a % (1 << 64), b % (1 << 64)) for a, b in got]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in unsigned)
    if limit == 256:
        assert len(unsigned) == len(set(map(frozenset, unsigned))) == sum((a ^ b).bit_count() <= 2 for a in fps for b in fps if a < b)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in unsigned:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == brute_classes(fps)


def test_copies_of_fingerprints_are_not_broadcast(llm):
    """Some 46 copies of each fingerprint: Spark sizes them like the fingerprints, which are few enough for a broadcast."""
    plan = simhash.links(llm.range(2000).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


# ---- 13


def brute_clusters(rows, k=8, rounds=10, size=64):
    import hashlib
    import math

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(1024 * x) < 1 << 27 for x in v)]
    c = [v for i, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        member = defaultdict(list)
        for _, v in kept:
            member[nearest(v)[1]].append(v)
        c = [[sum(x) // len(member[j]) for x in zip(*member[j], strict=True)] if member[j] else m for j, m in enumerate(c)]
    final = [(i, *reversed(nearest(v))) for i, v in kept]
    per, total = defaultdict(int), 0
    for _, j, d in final:
        per[j] += d
        total += d
    return Counter((i, j, d, per[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in final)


def test_op13_query(llm):
    rows = [(r["vec_id"], r["embedding"]) for r in llm.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(map(tuple, q.op13_centroids(llm, SF).collect())) == brute_clusters(rows)


def test_centroids_awkward(llm):
    """Ties, repeated rows and ids, nulls, other lengths, components that are not finite, clashing names, few vectors, none."""
    rng = random.Random(1)
    v = [[float(rng.randrange(-2, 3)) for _ in range(64)] for _ in range(60)]
    rows = [(i % 50, v[i % 40]) for i in range(300)] + [(None, v[0]), (None, v[1]), (900, None), (901, v[0][:63]), (902, v[0][:63] + [None]), (903, v[0][:63] + [float("nan")]),
                                                       (904, v[0][:63] + [float("inf")]), (905, v[0][:63] + [1e30]), (906, []), (907, [131071.0] * 64), (908, [-131072.5] * 64)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "cluster", "before", "distances", "rounds", "key")})
    assert Counter(map(tuple, centroids.with_inertia(*centroids.cluster(df)).collect())) == brute_clusters(rows)
    assert Counter(map(tuple, centroids.with_inertia(*centroids.cluster(df.where("vec_id in (3, 7)"))).collect())) == brute_clusters([r for r in rows if r[0] in (3, 7)])
    assert centroids.with_inertia(*centroids.cluster(df.where("false"))).count() == 0


def test_bounds_spare_evaluations():
    """Bounds loosened by total displacement keep the nearest centroid and skip most distances."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(3000, 64)) + rng.integers(0, 9, (3000, 1)) * 2).__mul__(1024).astype(np.int64)
    history = v[:8][None].copy()
    distances = np.stack([centroids._squared(v, c) for c in history[0]], axis=1)
    rounds, cluster, spent = np.zeros_like(distances, dtype=np.int32), distances.argmin(axis=1), 0
    for _ in range(10):
        means = np.array([v[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else history[-1][j] for j in range(8)])
        history = np.concatenate([history, means[None]])
        cluster, evaluated = centroids.reassign(v, cluster, distances, rounds, history, centroids.displaced(history))
        exact = np.stack([centroids._squared(v, c) for c in history[-1]], axis=1)
        assert (cluster == exact.argmin(axis=1)).all()
        spent += evaluated.sum()
    assert spent < 0.5 * 10 * 8 * len(v)


# ---- 11


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(docs, loss=199, least=5):
    import re

    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % loss == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    out, form = {}, {}
    for w in n:
        near_words = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near(w, x)]
        best = min(near_words, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(near_words)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], out[w], n.get(form[w])) for w in n}


def test_op11_query(llm):
    docs = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF}/documents.parquet").collect()]
    got = q.op11_spelling_variants(llm, SF).collect()
    assert set(map(tuple, got)) == brute_variants(docs) and len(got) == len(set(got))


@pytest.mark.parametrize("largest", [2048, 3])
def test_variants_of_many_near_words(llm, awkward, nothing, largest):
    """Chains of forms, words that share nearly all letters, long words; groups cut in halves give the same result."""
    rng = random.Random(9)
    base = ["spelling", "grouped", "aaaaaa", "aaaaaaa", "straße" + "x" * 300, "ÀÈÌÒÙÿé"]
    docs = []
    for i in range(400):
        out = []
        for _ in range(60):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                p = rng.randrange(len(w)) if len(w) < 50 else rng.randrange(3)
                w = rng.choice([w[:p] + w[p + 1:], w[:p] + rng.choice("aeg×ÿ") + w[p:], w[:p] + rng.choice("abSP") + w[p + 1:]])
            out.append(w)
        docs.append((None if i % 50 == 0 else i, rng.choice([" ", "-", "1"]).join(out)))
    docs += [(7, "chaina " * 5000), (7, "chainab " * 900), (8, "chainabc " * 150), (9, None), (10, "")]
    got = spelling.variants(llm.createDataFrame(docs, "doc_id long, text string").repartition(3), largest=largest).collect()
    want = brute_variants(docs)
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert any(f and r != f for _, f, r, *_ in want)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert set(map(tuple, spelling.variants(awkward, least=1, largest=largest).collect())) == brute_variants(rows, least=1)
    assert spelling.variants(nothing).count() == 0


def test_position_index_by_brute_force():
    rng = random.Random(2)
    vocabulary = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(90)})
    index = spelling.PositionIndex(vocabulary)
    for w in vocabulary + ["", "c", "abababa", words(rng, 1)]:
        assert [x for i, x in enumerate(vocabulary) if index.near(w) >> i & 1] == [x for x in vocabulary if near(w, x)]
    assert {(vocabulary[i], vocabulary[j]) for i, j in index.pairs()} == {(a, b) for a in vocabulary for b in vocabulary if a < b and near(a, b)}
