"""Language identification (1), nearest neighbours (7), quality (9) and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from duelbook.llm import language_id, minhash, projection_knn, quality_knn, superkmers
from duelbook.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_op1_query(llm):
    docs = {r["doc_id"]: r for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = q.op1_language_id(llm, SF).collect()
    assert len(rows) == len(docs)
    assert np.mean([r["language"] == docs[r["doc_id"]]["lang"] for r in rows]) > 0.97
    assert np.mean([r["kept"] for r in rows]) > 0.97
    pages = q.language_id_of_pages(llm, SF)
    assert pages.count() == llm.read.parquet(f"{SF}/pages.parquet").count()
    assert pages.where("language = declared").count() > 0.9 * pages.count()


def test_text_outweighs_a_wrong_declaration(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").where("lang in ('de', 'en') and n_chars > 300")
    wrong = F.col("doc_id") % 10 == 3
    rows = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(wrong, F.when(F.col("lang") == "de", "en").otherwise("de")).otherwise(F.col("lang")))
    out = language_id.identify_documents(rows).select("truth", "lang", "language_id.language").where("truth <> lang").collect()
    assert len(out) > 3 and np.mean([r["language"] == r["truth"] for r in out]) > 0.9


def test_priors_decide_where_the_text_is_silent(llm):
    rows = [("https://a.one.org/x", "de", "")] * 30 + [("https://b.one.org/y", None, "")] * 2 + [("https://c.two.org/z", None, "")] + [("https://d.two.org/z", "en", "")] * 80
    rows += [("https://f.four.org/", "fr", "")] * 40 + [("https://e.three.fr/", None, ""), (None, None, None)]
    df = llm.createDataFrame(rows, "url string, declared string, text string")
    out = {r["url"]: r["language_id"] for r in language_id.identify(df, F.col("text"), F.col("declared"), language_id.host_of(F.col("url"))).collect()}
    assert [out[u]["language"] for u in ("https://a.one.org/x", "https://b.one.org/y", "https://c.two.org/z", "https://e.three.fr/", None)] == ["de", "de", "en", "fr", "en"]
    assert out[None]["text_language"] is None
    noise = df.limit(1).withColumn("text", F.repeat(F.lit("\u0001\u0002~^\u0003|\u0004"), 200))
    got = language_id.identify(noise, F.col("text"), F.lit(None).cast("string"), F.lit("h"))
    assert got.first()["language_id"]["language"] in language_id.LANGUAGES or not got.first()["language_id"]["kept"]


def test_host_priors_by_brute_force(llm):
    rng = random.Random(4)
    rows = [(h, h[0], [rng.random() for _ in range(5)]) for h in rng.choices(["a1", "a2", "b1", "c1"], [60, 3, 20, 1], k=90)]
    got = {r["host"]: r["prior"] for r in language_id.host_priors(llm.createDataFrame(rows, "host string, domain string, belief array<double>")).collect()}

    def sums(keep):
        return np.sum([r[2][:4] for r in rows if keep(r)], axis=0)

    world = (sums(lambda r: True) + 1) / (sums(lambda r: True) + 1).sum()
    for h in {r[0] for r in rows}:
        d = sums(lambda r: r[1] == h[0])  # noqa: B023
        d = (d + language_id.LEAN_DOMAIN * world) / (d.sum() + language_id.LEAN_DOMAIN)
        s = sums(lambda r: r[0] == h)  # noqa: B023
        p = (s + language_id.LEAN_HOST * d) / (s.sum() + language_id.LEAN_HOST)
        assert np.allclose(got[h], [*np.log((1 - language_id.NOISE) * p), math.log(language_id.NOISE)])


def test_markup_and_hosts(llm):
    rows = [("<html lang='DE-at'>",), ('<!doctype html><HTML class="x" lang=fr>',), ("<html>",), (None,), ('<html xml:lang="es">',)]
    got = [r[0] for r in llm.createDataFrame(rows, "h string").select(language_id.declared_of(F.col("h"))).collect()]
    assert got == ["de", "fr", "", "", "es"]
    urls = [("https://user@WWW.Example.co.uk:80/a?b",), ("no address",), (None,), ("http://x.de",)]
    got = [r[0] for r in llm.createDataFrame(urls, "u string").select(language_id.host_of(F.col("u"))).collect()]
    assert got == ["www.example.co.uk", "", "", "x.de"]


def test_languages_awkward(awkward, nothing):
    out = language_id.identify_documents(awkward)
    assert out.count() == awkward.count() and set(out.columns) == set(awkward.columns)
    assert out.where("language_id.probability is null or isnan(language_id.probability)").count() == 0
    assert language_id.identify_documents(nothing).count() == 0


def exact(rows, k=10, every=100):
    out = []
    for i, v in rows:
        if i % every == 0:
            near = sorted((math.dist(v, w), j) for j, w in rows if j != i and len(v) == len(w))[:k]
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near)]
    return out


def test_op7_query(llm):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in llm.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in q.op7_projection_knn(llm, SF).collect()}
    want = {(a, j): d for a, _, j, d in exact(rows)}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in got.keys() & want.keys())


def test_neighbours_awkward(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []),
            (None, [1.0, 0.0]), (100, [0.0, 5.0]), (200, [1.0, 2.0, 3.0]), (9, [1.0, 0.0]), (300, None)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "block": F.lit(2), "score": F.lit(3)})
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 5)) for r in projection_knn.nearest(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 9, 0.0), (0, 3, 2, 0.1), (0, 4, 100, round(math.sqrt(26), 5)),
                   (100, 1, 2, round(math.dist([0, 5], [1, 0.1]), 5)), (100, 2, 0, round(math.sqrt(26), 5)), (100, 3, 1, round(math.sqrt(26), 5)), (100, 4, 9, round(math.sqrt(26), 5))]
    assert projection_knn.nearest(df.limit(0)).count() == 0


def test_neighbours_over_blocks(llm):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 12)))] + [(5000 + i, [1.0] * 12) for i in range(400)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in projection_knn.nearest(df, block_rows=200, query_rows=5).collect()]
    want = exact(rows)
    assert len(got) == len(want)
    assert len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)
    copies = {(a, b, c) for a, b, c, _ in want if 5000 <= a}
    assert copies == {(a, b, c) for a, b, c, _ in got if 5000 <= a}


def test_chi_square():
    assert abs(projection_knn.chi_square(15.507, 8) - 0.95) < 1e-4 and projection_knn.chi_square(0, 8) == 0 and projection_knn.chi_square(1e9, 8) == 1


def test_op9_query(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = q.op9_quality(llm, SF).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_accuracy(llm):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in q.op9_quality(llm, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95


def test_held_out_labels_change_nothing(llm):
    docs, labels = (llm.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality_knn.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality_knn.classify(docs, labels).collect())) == sorted(map(tuple, quality_knn.classify(docs, turned).collect()))


def test_quality_awkward(awkward, nothing, llm):
    labels = llm.createDataFrame([(1, 1), (2, 0), (2, None), (3, 0), (None, 1), (4, 5), (7, 1), (6, 0)], "doc_id long, quality int")
    out = quality_knn.classify(awkward, labels)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (4, 5)} == {0.5}
    assert {r["score"] for r in quality_knn.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality_knn.classify(nothing, labels).count() == 0


def test_a_repeated_id_is_learnt_from_once(llm):
    docs = [(1, "plain words of a text"), (2, "OTHER signs !!! ???"), (5, "more plain words here")]
    labels = llm.createDataFrame([(1, 1), (2, 0), (5, 1)], "doc_id long, quality int")
    held = [r["doc_id"] for r in labels.where(quality_knn.held_out(F.col("doc_id"))).collect()]
    many = llm.createDataFrame(docs + [docs[1]] * 300 + [(2, f"OTHER {i} ??") for i in range(50)], "doc_id long, text string")
    model = quality_knn.fit(many, labels)
    assert 2 not in held and len(model.labels) == len(docs) - len(held) and len(model.vectors) == len(model.labels)


def test_wording_alone_tells_quality(llm):
    """Words of the same shapes, signs and lengths; only the vocabulary differs."""
    rng = random.Random(8)
    good, poor = ([f"{a}{b}{c}{d}" for a in x for b in "aeiou" for c in x for d in "aeiou"] for x in ("bcdfg", "mnprs"))
    rows = [(i, " ".join(rng.choice(good if i % 2 else poor) for _ in range(80)) + ".", i % 2) for i in range(300)]
    df = llm.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality_knn.classify(df, df.select("doc_id", "quality"), threshold=0.5).where("held_out").collect()
    assert len(out) > 30 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in out]) > 0.95


def test_stages_take_effect(llm):
    """Every stage against its operator's own decision, on the documents that reach it."""
    docs = llm.read.parquet(f"{SF}/documents.parquet").withColumn("note", F.lit("n"))
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    good = by_name["quality"](llm, docs, SF)
    scores = {r["doc_id"]: r["predicted"] for r in q.op9_quality(llm, SF).collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == {d for d, p in scores.items() if p}
    said = by_name["language"](llm, good, SF)
    assert said.columns == columns and said.count() >= 0.97 * good.count()
    one = by_name["near_duplicates"](llm, said, SF)
    kept = {r["doc_id"] for r in minhash.near_duplicates(said).where("kept").collect()}
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == sorted(kept)
    cut = by_name["repeated_passages"](llm, one, SF)
    removed = {r["doc_id"]: r["removal"] for r in superkmers.remove_repeats(one).collect()}
    before = {r["doc_id"]: r for r in one.collect()}
    assert cut.columns == columns and cut.schema == one.schema
    for r in cut.collect():
        gone = removed[r["doc_id"]]
        assert r["text"] == (bytes(gone["kept"]).decode() if gone["n_removed"] else before[r["doc_id"]]["text"])
        assert r["n_chars"] == (len(r["text"]) if gone["n_removed"] else before[r["doc_id"]]["n_chars"])
    packed = by_name["packing"](llm, cut, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    whole = corpus_pipeline.run(llm, SF)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} >= kept - set(before) and whole.columns[:3] == ["doc_id", "start", "length"]


def test_stages_awkward(llm, awkward, nothing):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, awkward, SF)
        assert out.columns == awkward.columns and out.schema.simpleString() == awkward.schema.simpleString()
        assert out.count() <= awkward.count()
        assert stage(llm, nothing, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](llm, nothing, SF).count() == 0


def test_op1_by_brute_force(llm):
    """The fused result of every document, evidence by evidence, in plain loops."""
    docs = llm.read.parquet(f"{SF}/documents.parquet").collect()
    names = language_id.LANGUAGES
    counts = {c: Counter() for c in names}
    cut = {}
    for r in docs:
        t = "".join(c for c in r["text"].lower() if not ("0" <= c <= "9")).encode()
        cut[r["doc_id"]] = [(t[i] * 65536 + t[i + 1] * 256 + t[i + 2]) * 2654435761 % 2**32 >> 18 for i in range(len(t) - 2)]
        if r["lang"] in counts:
            counts[r["lang"]].update(cut[r["doc_id"]])
    n = 1 << 14
    size = {c: sum(k.values()) + 0.5 * n for c, k in counts.items()}

    def log_p(c, g):
        return math.log(0.9 * (counts[c][g] + 0.5) / size[c] + 0.1 / n)

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    score, belief = {}, defaultdict(lambda: [0.0] * 4)
    for r in docs:
        g = cut[r["doc_id"]]
        damp = (len(g) if len(g) <= 50 else 50 + math.sqrt(len(g) - 50)) / len(g) if g else 0
        s = [damp * sum(log_p(c, x) for x in g) for c in names] + [damp * len(g) * -math.log(n)]
        if r["lang"] in names:
            s = [v + math.log(0.9 if c == r["lang"] else 0.1 / 3) for v, c in zip(s, names, strict=False)] + [s[4] + math.log(1 / 4)]
        score[r["doc_id"]] = s
        for i, b in enumerate(softmax(s)[:4]):
            belief[r["source"]][i] += b
    world = [sum(b[i] for b in belief.values()) + 1 for i in range(4)]
    world = [w / sum(world) for w in world]
    assert not any("." in h for h in belief)  # a source is its own domain, and has no suffix
    got = {r["doc_id"]: r for r in q.op1_language_id(llm, SF).collect()}
    for r in docs:
        b = belief[r["source"]]
        domain = [(x + 20 * w) / (sum(b) + 20) for x, w in zip(b, world, strict=True)]
        host = [(x + 10 * d) / (sum(b) + 10) for x, d in zip(b, domain, strict=True)]
        p = softmax([s + x for s, x in zip(score[r["doc_id"]], [*(math.log(0.99 * h) for h in host), math.log(0.01)], strict=True)])
        best = max(range(5), key=lambda i: p[i])  # noqa: B023
        mine = got[r["doc_id"]]
        assert mine["language"] == (*names, "und")[best] and math.isclose(mine["probability"], p[best], rel_tol=1e-3)
        assert mine["kept"] == (best < 4 and p[best] >= 0.5)


def test_op9_by_brute_force(llm):
    """Every score from the model's parts in plain loops: projection, all cosines, the nearest 25, their weighted vote; and the parts themselves."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{SF}/labels.parquet").collect()}
    model = quality_knn.fit(llm.read.parquet(f"{SF}/documents.parquet"), llm.read.parquet(f"{SF}/labels.parquet"))
    found = {d: quality_knn.terms(t) for d, t in docs.items()}
    seen = Counter(t for terms, _ in found.values() for t in terms.tolist())
    assert np.allclose(model.idf, [math.log((1 + len(docs)) / (1 + seen[t])) + 1 for t in range(quality_knn.TERMS)])
    known = [d for d in sorted(labels) if zlib.crc32(str(d).encode()) % 5]
    assert sorted(model.labels.tolist()) == sorted(labels[d] for d in known)

    def weighted(d):
        terms, w = found[d]
        x = np.zeros(quality_knn.TERMS)
        x[terms] = w * model.idf[terms]
        return x / max(1e-300, np.sqrt((x * x).sum()))

    matrix = np.stack([weighted(d) for d in known])
    _, s, v = np.linalg.svd(matrix, full_matrices=False)
    k = model.basis.shape[1]
    assert np.linalg.norm(matrix @ model.basis) > 0.995 * np.linalg.norm(s[:k])  # as much of the matrix as the best basis of its size holds
    latent = {d: weighted(d) @ model.basis.astype(float) for d in docs}
    unit = {d: x / max(1e-300, np.sqrt((x * x).sum())) for d, x in latent.items()}
    zeros, ones = sum(labels[d] == 0 for d in known), sum(labels[d] == 1 for d in known)
    got = {r["doc_id"]: r for r in q.op9_quality(llm, SF).collect()}
    assert set(got) == set(docs)
    for d in docs:
        near = sorted(((float(unit[d] @ unit[e]), e) for e in known), reverse=True)[:25]
        one = sum(max(0, c) ** 8 for c, e in near if labels[e] == 1) / ones
        zero = sum(max(0, c) ** 8 for c, e in near if labels[e] == 0) / zeros
        want = one / (one + zero) if one + zero > 0 else 0.5
        assert abs(got[d]["score"] - want) < 2e-3, (d, got[d]["score"], want)
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and got[d]["predicted"] == int(got[d]["score"] >= 0.3)
