"""Packing (2) and byte-level BPE (10)."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from duelbook.llm import byte_bpe, packing
from duelbook.llm import queries as q

SF = "/root/testdata/sf0.001"


def own_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packed(rows, texts, window):
    """Every id in one piece, sequences gapless, and a length that needs little or no padding."""
    t, by_doc, by_sequence = own_tokenizer(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and (at >= window * (1 - packing.SLACK) or at & (at - 1) == 0)


def test_op2_query(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").collect()
    check_packed(q.op2_packing(llm, SF).collect(), {r["doc_id"]: r["text"] for r in docs}, packing.WINDOW)


def test_pack_small_window_and_chunks(llm):
    docs = llm.createDataFrame([(i, "word " * (i % 40)) for i in range(60)] + [(60, None), (61, ""), (62, "x <|endoftext|> y"), (63, "<|endoftext|>" * 40), (64, " <|endoftext|>  <|endoftext"), (65, "a<|endoftext|>'s <|endof<|endoftext|>text|>")], "doc_id long, text string")
    out = packing.pack(docs, window=16, chunk_ids=100).withColumn("ids_crc32", F.crc32("ids"))
    check_packed(out.collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, 16)


def test_pack_awkward(awkward, nothing):
    out = packing.pack(awkward)
    assert out.agg(F.sum("length")).first()[0] == out.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert out.where("start = 0").count() == awkward.count()
    assert packing.pack(nothing).count() == 0
    joined = packing.sequences(out)
    assert joined.agg(F.sum(F.octet_length("ids") / 4)).first()[0] == out.agg(F.sum("length")).first()[0]


def test_best_fit_is_the_tightest():
    rng = random.Random(3)
    lengths = [rng.randint(1, 64) for _ in range(300)]
    room, expected = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        expected[i] = min(fits) if fits else 64
        if fits:
            room.remove(min(fits))
        room.append(expected[i] - lengths[i])
    placed = packing.best_fit(lengths, 64)
    assert {i: 64 - o for i, (_, o) in enumerate(placed)} == expected


def test_powers():
    assert packing.powers(0) == [] and packing.powers(13) == [8, 4, 1]


@pytest.fixture(scope="module")
def coder():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.Transducer(ranks, limit=2000), plain


def test_transducer_makes_the_merges(coder):
    t, plain = coder
    rng = random.Random(1)
    for alphabet in ("ab", "aeioust'", "0123", "éèçàñ", "日本語のです", " \n\t", "\x00\xff\x1c"):
        for _ in range(300):
            x = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
            assert t.encode(x.encode()) == plain._core_bpe.encode_single_piece(x.encode())


def test_transducer_long_match(coder):
    t, plain = coder
    x = "".join(random.Random(2).choice("abcdeé") for _ in range(20_000)).encode()
    assert t.encode(x) == plain._core_bpe.encode_single_piece(x)
    assert len(t.states) <= t.limit and len(x) > t.FLUSH


def test_utf8_stream():
    text = "aé日😀 z".encode()
    for cut in range(len(text) + 1):
        s = byte_bpe.Utf8Stream()
        out = [s.feed(text[:cut]), s.feed(text[cut:]), s.end()]
        assert b"".join(out) == text
        for part in out:
            part.decode()
    broken = b"a\xc3(\xe2\x82b\xff\xf0\x9f"
    s = byte_bpe.Utf8Stream()
    assert b"".join([*(s.feed(bytes([b])) for b in broken), s.end()]) == broken


def test_op10_query(llm, coder):
    docs = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib

    rows = q.op10_byte_bpe(llm, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(coder[1].encode_ordinary(docs[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_bpe_awkward(awkward, nothing, coder):
    rows = byte_bpe.encode_documents(awkward.withColumn("text", F.when(F.col("doc_id") == 8, "  x  y\n z ' 't  ").otherwise(F.col("text")))).collect()
    assert len(rows) == awkward.count()
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()} | {8: "  x  y\n z ' 't  "}
    for r in rows:
        if r["doc_id"] not in (None, 2):
            assert np.frombuffer(r["ids"], "<u4").tolist() == coder[1].encode_ordinary(texts[r["doc_id"]] or "")
            assert bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    assert byte_bpe.encode_documents(nothing).count() == 0
