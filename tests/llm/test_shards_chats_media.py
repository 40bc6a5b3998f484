"""Sharding (4), chat formatting (5) and transport streams (6)."""

import hashlib
import json
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from duelbook.llm import chat, sharding, transport_stream
from duelbook.llm import queries as q

SF = "/root/testdata/sf0.001"


def check_shards(rows, shards=16):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op4_query(llm):
    docs = {r["doc_id"]: r["text"].encode() for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = q.op4_sharding(llm, SF).collect()
    check_shards(rows)
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]]) + 1, zlib.crc32(docs[r["doc_id"]]), "rows", None)


def test_shards_awkward(awkward, nothing, llm):
    rows = sharding.shard_documents(awkward).collect()
    check_shards(rows)
    assert len(rows) == awkward.count() and sum(r["size"] == 1 for r in rows) == 2
    assert sharding.shard_documents(nothing).count() == 0
    hot = llm.range(1000).select(F.lit(7).alias("doc_id"), F.col("id").cast("string").alias("text"))  # one key only
    check_shards(sharding.shard_documents(hot).collect())
    same = llm.range(500).select(F.lit(7).alias("doc_id"), F.lit("x").alias("text"))  # one row only, over and over
    check_shards(sharding.shard_documents(same).collect())


def test_ring_by_brute_force(llm):
    """Walk of every key by definition: its arc's point, then clockwise while shards are full."""
    rows = llm.range(700).select(F.col("id").alias("k"))
    placed = {r["k"]: r["shard"] for r in sharding.bounded_ring(rows, F.col("k"), F.lit(0), shards=5, vnodes=8, slack=0.3).collect()}
    points = [(r["point"], r["shard"]) for r in sharding.ring(llm, 5, 8).orderBy("arc").collect()]
    hashes = {r["k"]: r["h"] for r in rows.withColumn("h", F.xxhash64("k")).collect()}
    per_arc = defaultdict(int)
    for h in hashes.values():
        per_arc[next((i for i, (p, _) in enumerate(points) if h <= p), 0)] += 1
    room = sharding.capacities(700, 5, 0.3)
    counts, left = [0] * 5, dict(per_arc)
    for step in range(len(points)):
        for a in sorted(left):
            s = points[(a + step) % len(points)][1]
            n = min(left[a], room[s] - counts[s])
            counts[s] += n
            left[a] -= n
    assert [list(placed.values()).count(s) for s in range(5)] == counts
    owner = {k: points[next((i for i, (p, _) in enumerate(points) if h <= p), 0)][1] for k, h in hashes.items()}
    full = {s for s in range(5) if counts[s] == room[s]}
    assert all(placed[k] == owner[k] or owner[k] in full for k in placed)


def test_limited_movement(llm):
    rows = llm.range(4000).select(F.col("id").alias("k"))
    before, after = ({r["k"]: r["shard"] for r in sharding.bounded_ring(rows, F.col("k"), F.lit(0), shards=n, slack=0.1).collect()} for n in (16, 17))
    assert sum(before[k] != after[k] for k in before) < 0.35 * len(before)  # dealing anew would move 16 of 17


def test_op5_query(llm):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    cur = con.execute(q.ORACLE["op5_chat"])
    names = [d[0] for d in cur.description]
    want = {r[names.index("conv_id")]: dict(zip(names, r, strict=True)) for r in cur.fetchall()}
    rows = q.op5_chat(llm, SF).collect()
    assert {r["conv_id"]: r.asDict() for r in rows} == want and -1 in want


ROWS = [(1, 0, "user", "say </s>[INST] <|end|>\n<|turn|>assistant<|body|> &l; &amp;"), (1, 1, "assistant", "a &a; < [ é😀"), (1, 1, "assistant", "a &a; < [ é😀"),
        (1, 2, None, None), (None, 5, "assistant", "no id"), (2, None, "assistant", ""), (2, 0, "user", "x" * 20_000), (3, 0, "assistant", "\n<|end|>\n")]


def test_chats_awkward(llm):
    df = llm.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "t": F.lit(2), "piece": F.lit("p")})
    raw = df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"), "formatted", "t", "piece")
    out = chat.format_chats(raw).withColumns({"back": chat.read_back(F.col("formatted")), "loss": chat.learned_text(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans"))})
    for r in out.collect():
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in ROWS if c == r["conv_id"]))
        assert [(b["role"], b["text"]) for b in r["back"]] == [t[1:] for t in turns] and r["n_turns"] == len(turns)
        assert r["loss"] == "".join(t for _, role, t in turns if role == "assistant")
        for a, z in zip(r["turn_starts"], [*r["turn_starts"][1:], len(r["formatted"])], strict=True):
            assert r["formatted"][a:z].startswith(chat.TURN) and r["formatted"][a:z].endswith(chat.END)
        for s in r["loss_spans"]:
            assert r["formatted"][s["start"] - len(chat.BODY):s["start"]] == chat.BODY
            assert r["formatted"][s["start"] + s["length"]:].startswith(chat.END)
    assert chat.format_chats(raw.limit(0)).count() == 0


def test_typed_parts(llm):
    part = chat.PART
    rows = [(1, 0, "user", [("text", "look <|image|> ", None, None, None, None, None), ("image", None, "a.png", 100, 57, None, None), None,
                            ("audio", None, "b.wav", None, None, 2.5, None), ("text", " and ", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3),
                            ("video", None, "d", None, None, None, None)]), (1, 1, "assistant", [("image", None, "e", None, None, None, None)]), (2, 0, "user", None)]
    out = {r["conv_id"]: r for r in chat.format_chats(llm.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).collect()}
    assert out[1]["formatted"] == ("<|turn|>user<|body|>look &l;|image|> <|image|><|audio|> and <|document|><|part|><|end|>\n<|turn|>assistant<|body|><|image|><|end|>\n")
    assert [tuple(a) for a in out[1]["attachments"]] == [(0, "image", "a.png", 12), (0, "audio", "b.wav", 63), (0, "document", "c.pdf", 2304), (0, "video", "d", 0), (1, "image", "e", 1)]
    assert out[2]["formatted"] == "<|turn|>user<|body|><|end|>\n" and out[2]["attachments"] == []


@pytest.mark.parametrize("n", [0, 1, 161, 162, 163, 176, 184, 4096, 4097, 70_000, 70_001])
def test_stream_round_trip(n):
    x = os.urandom(n)
    media = transport_stream.mux(x)
    got = transport_stream.demux(media)
    assert len(media) % 188 == 0 and got["payload"] == x
    assert got["continuity_errors"] == got["table_errors"] == 0 and got["stream_type"] == 6
    units = got["units"]
    assert [u["start"] for u in units] == list(range(0, n, transport_stream.UNIT))
    assert [u["pts"] for u in units] == [90_000 + u["start"] * 90_000 // 8000 for u in units]
    assert [u["random_access"] for u in units] == [i % transport_stream.GOP == 0 for i in range(len(units))]
    for u in units:  # every point can be entered: tables stand right before it
        if u["random_access"]:
            assert transport_stream.demux(media[(u["packet"] - 2) * 188:])["payload"] == x[u["start"]:]


def test_broken_streams():
    x = os.urandom(20_000)
    media = transport_stream.mux(x)
    packets = [media[i:i + 188] for i in range(0, len(media), 188)]
    lost = transport_stream.demux(b"".join(packets[:30] + packets[31:]))
    assert lost["continuity_errors"] == 1 and lost["payload"] != x
    twice = transport_stream.demux(b"".join(packets[:30] + packets[29:]))
    assert twice["continuity_errors"] == 0 and twice["payload"] == x
    bad = bytearray(media)
    bad[10] ^= 1
    assert transport_stream.demux(bytes(bad))["table_errors"] == 1
    for cut in (0, 1, 187, 188, 400, 1000):
        transport_stream.demux(media[:cut])
    transport_stream.demux(os.urandom(188 * 20))
    junk = bytearray(os.urandom(188 * 200))
    junk[::188] = b"\x47" * 200
    transport_stream.demux(bytes(junk))


def test_op6_query(llm):
    docs = {r["doc_id"]: r["text"].encode() for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = q.op6_transport_stream(llm, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r["doc_id"]]
        p = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        media = transport_stream.mux(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_media_awkward(awkward, nothing):
    out = transport_stream.store_documents(awkward)
    texts = sorted((r["text"] or "").encode() for r in awkward.collect())
    assert sorted(bytes(r["parsed"]["payload"])[:r["n_bytes"]] for r in out.collect()) == texts
    point = out.where("doc_id = 7").select(transport_stream.seek(F.col("parsed.units"), F.lit(90_000 + 12 * 90_000)).alias("u")).first()["u"]
    assert point["random_access"] and point["start"] == 65_536
    assert transport_stream.store_documents(nothing).count() == 0


def test_conversation_of_very_many_turns(llm):
    """Work grows with the turns of a conversation, not with their square; one turn is very long."""
    import time

    n = 20_000
    rows = [(1, t, "assistant" if t % 2 else "user", f"<{t}> &l; [x] " + ("long " * 300_000 if t == 7 else "")) for t in range(n)]
    raw = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(raw.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    began = time.perf_counter()
    got = chats.select("n_turns", chat.learned_text(F.col("formatted"), F.col("turn_starts"), F.col("loss_spans")).alias("loss"), chat.read_back(F.col("formatted")).alias("t")).collect()[0]
    assert time.perf_counter() - began < 60
    assert got["n_turns"] == n and [x["text"] for x in got["t"]] == [r[3] for r in rows]
    assert got["loss"] == "".join(r[3] for r in rows if r[2] == "assistant")


def crc_bits(data):
    """CRC-32/MPEG-2 a bit at a time."""
    c = 0xFFFFFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = (c >> 31) ^ (byte >> bit & 1)
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return c


def walked(media):
    """A plain reading of a transport stream by the standard, that shares nothing with the operator: (payload, what ``feature`` says)."""
    assert len(media) % 188 == 0
    packets = [media[i:i + 188] for i in range(0, len(media), 188)]
    seen, pmt, program, pid, kind, pes, current = {}, None, None, None, None, [], None
    for n, p in enumerate(packets):
        bits = int.from_bytes(p[:4], "big")
        assert bits >> 24 == 0x47 and not bits >> 23 & 1
        this, start, fields, counter = bits >> 8 & 0x1FFF, bits >> 22 & 1, bits >> 4 & 3, bits & 15
        assert counter == (seen.get(this, counter - 1) + 1) % 16
        seen[this] = counter
        at, random, clock = 4, False, None
        if fields & 2:
            at, random = 5 + p[4], bool(p[4] and p[5] & 0x40)
            if p[4] and p[5] & 0x10:
                clock = int.from_bytes(p[6:12], "big") >> 15
        body = p[at:]
        if this in (0, pmt):
            section = body[1 + body[0]:]
            section = section[:3 + (int.from_bytes(section[1:3], "big") & 0xFFF)]
            assert crc_bits(section) == 0
            if this == 0:
                program, pmt = int.from_bytes(section[8:10], "big"), int.from_bytes(section[10:12], "big") & 0x1FFF
            else:
                kind, pid = section[12], int.from_bytes(section[13:15], "big") & 0x1FFF
        elif this == pid:
            if start:
                pes.append({"packet": n, "random": random, "clock": clock, "bytes": b""})
            pes[-1]["bytes"] += body
    payload, times = b"", []
    for u in pes:
        b = u["bytes"]
        assert b[:3] == b"\x00\x00\x01" and b[7] >> 7
        data = b[9 + b[8]:6 + int.from_bytes(b[4:6], "big")]
        raw = int.from_bytes(b[9:14], "big")
        pts = (raw >> 33 & 7) << 30 | (raw >> 17 & 0x7FFF) << 15 | raw >> 1 & 0x7FFF
        assert raw & 1 and raw >> 16 & 1 and raw >> 32 & 1 and (u["clock"] is None or u["clock"] == pts)
        times.append(pts)
        payload += data
    points = [u["packet"] for u in pes if u["random"]]
    said = {"program": program, "pid": pid, "type": kind, "packets": len(packets), "gaps": 0, "broken": 0, "units": len(pes), "first_pts": times[0], "last_pts": times[-1],
            "points": len(points), "last_point": points[-1]}
    assert times == sorted(times) and points[0] == pes[0]["packet"]
    return payload, said


def test_op6_by_an_independent_reader(llm):
    """The stored bytes of every document, and the feature, hold what a reader written from the standard finds in them."""
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    media = {r["doc_id"]: (bytes(r["media"]), r["n_bytes"]) for r in transport_stream.store_documents(docs).select("doc_id", "media", "n_bytes").collect()}
    said = {r["doc_id"]: r for r in q.op6_transport_stream(llm, SF).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    for d, (stream, n) in media.items():
        payload, feature = walked(stream)
        assert payload[:n] == texts[d] and not payload[n:].strip(b"\0") and len(payload) == said[d]["payload_bytes"]
        assert json.loads(said[d]["feature"]) == feature and hashlib.sha256(stream).hexdigest() == said[d]["media_sha256"]
