"""Media columns: MPEG transport streams of 188-byte packets, written and parsed.

A payload of 8-bit samples is cut into units; each becomes an elementary packet with a presentation time, spread over
transport packets of one stream. Program tables stand before every random-access point, which the first packet of its
unit marks and dates with the clock. Parsing needs nothing but the packets: it checks the tables' checksums, follows them to the
stream, checks the continuity counter of every stream, and puts the elementary packets together again.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import bytes_of

#: Fixed values of the format: packet size and mark, stream numbers, kind of stream (private data), its packets' id.
PACKET, SYNC, PAT_PID, PMT_PID, PID, STREAM_TYPE, STREAM_ID, PROGRAM = 188, 0x47, 0, 0x1000, 0x100, 0x06, 0xBD, 1
CLOCK, PCR_PERIOD = 90_000, 1 << 33
#: Samples a second and in a unit, units between random-access points, first presentation time.
RATE, UNIT, GOP, START = 8000, 4096, 16, 90_000
BLOCK = 64
UNIT_TYPE = "struct<pts: bigint, start: bigint, length: bigint, packet: bigint, random_access: boolean>"
PARSED = f"payload binary, program int, stream_pid int, stream_type int, packets long, continuity_errors long, table_errors long, units array<{UNIT_TYPE}>"


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


@lru_cache(64)
def crc(data: bytes) -> int:
    """Checksum of a table section; 0 over a section with its own checksum."""
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + crc(head + body).to_bytes(4, "big")


@lru_cache(1)
def _tables() -> tuple[bytes, bytes]:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | PID).to_bytes(2, "big") + b"\xf0\x00")
    return pat, pmt


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _packet(pid: int, start: bool, counter: int, extra: bytes | None, data: bytes) -> bytes:
    """One packet; extra: flags and fields of the adaptation field, or None for none beyond what stuffing needs."""
    room = PACKET - 4 - len(data)
    field = b""
    if extra is not None or room:
        inside = (extra if extra is not None else b"\x00" if room > 1 else b"")
        field = bytes([room - 1]) + inside + b"\xff" * (room - 1 - len(inside))
    return bytes([SYNC, start << 6 | pid >> 8, pid & 255, (0x30 if field else 0x10) | counter & 15]) + field + data


def mux(payload: bytes, unit: int = UNIT, gop: int = GOP, rate: int = RATE) -> bytes:
    """The transport stream of a payload; an empty payload is tables only."""
    out, counter, rounds = [], 0, 0
    pat, pmt = _tables()
    for n, at in enumerate(range(0, max(1, len(payload)), unit)):
        random = n % gop == 0
        if random:
            for pid, section in ((PAT_PID, pat), (PMT_PID, pmt)):
                out.append(_packet(pid, True, rounds, None, b"\x00" + section + b"\xff" * (PACKET - 5 - len(section))))
            rounds += 1
        data = payload[at:at + unit]
        if not data:
            break
        pts = (START + at * CLOCK // rate) % PCR_PERIOD
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        clock = b""
        if random:
            clock = (pts << 15 | 0x3F << 9).to_bytes(6, "big")
        extra = bytes([(0x50 if random else 0x00)]) + clock
        first = PACKET - 5 - len(extra)
        out.append(_packet(PID, True, counter, extra, pes[:first]))
        counter += 1
        for i in range(first, len(pes), PACKET - 4):
            out.append(_packet(PID, False, counter, None, pes[i:i + PACKET - 4]))
            counter += 1
    return b"".join(out)


def _table(section: bytes, table_id: int) -> bytes | None:
    """Body of a section between its head and its checksum; None if it is broken."""
    at = 1 + section[0]
    if len(section) < at + 12 or section[at] != table_id:
        return None
    n = 3 + ((section[at + 1] & 0x0F) << 8 | section[at + 2])
    whole = section[at:at + n]
    return whole[8:-4] if len(whole) == n and n >= 12 and crc(whole) == 0 else None


def demux(media: bytes) -> dict:
    """What a transport stream holds, by the names of ``PARSED``. Broken packets, tables and gaps are counted, never raised; bytes
    behind the last whole packet are left out."""
    pmt_pid = pid = program = kind = None
    counters: dict[int, int] = {}
    gaps = tables = 0
    units, parts, size, open_ = [], [], 0, []

    def close() -> None:
        nonlocal size
        if not open_:
            return
        pes = b"".join(open_)
        open_.clear()
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            units.pop()
            return
        data = pes[9 + pes[8]:]
        length = int.from_bytes(pes[4:6], "big")
        if length:
            data = data[:length - 3 - pes[8]]
        if pes[7] & 0x80 and len(pes) >= 14:
            p = pes[9:14]
            units[-1]["pts"] = (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1
        units[-1] |= {"start": size, "length": len(data)}
        parts.append(data)
        size += len(data)

    count = len(media) // PACKET
    for i in range(count):
        p = media[i * PACKET:(i + 1) * PACKET]
        if p[0] != SYNC or p[1] & 0x80:
            gaps += 1
            continue
        this, start, kinds = (p[1] & 0x1F) << 8 | p[2], p[1] & 0x40, p[3] & 0x30
        if not kinds & 0x10:
            continue
        at, flags = 4, 0
        if kinds & 0x20:
            at = 5 + p[4]
            flags = p[5] if p[4] else 0
        last, now = counters.get(this), p[3] & 15
        counters[this] = now
        if last is not None and now != (last + 1) & 15 and not flags & 0x80:
            if now == last:
                continue  # a repeated packet
            gaps += 1
        if this == PAT_PID or this == pmt_pid:
            if start:
                body = _table(p[at:], 0 if this == PAT_PID else 2)
                if body is None:
                    tables += 1
                elif this == PAT_PID:
                    for k in range(0, len(body) - 3, 4):
                        if body[k] or body[k + 1]:
                            program, pmt_pid = int.from_bytes(body[k:k + 2], "big"), (body[k + 2] & 0x1F) << 8 | body[k + 3]
                            break
                else:
                    k = 4 + ((body[2] & 0x0F) << 8 | body[3])
                    if k + 5 <= len(body):
                        kind, pid = body[k], (body[k + 1] & 0x1F) << 8 | body[k + 2]
        elif this == pid:
            if start:
                close()
                units.append({"pts": None, "start": size, "length": 0, "packet": i, "random_access": bool(flags & 0x40)})
                open_.append(p[at:])
            elif open_:
                open_.append(p[at:])
    close()
    return {"payload": b"".join(parts), "program": program, "stream_pid": pid, "stream_type": kind, "packets": count, "continuity_errors": gaps,
            "table_errors": tables, "units": units}


def store(payload: Column) -> Column:
    """Transport stream of a binary column; null gives null."""
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if p is None else mux(p) for p in v.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(payload)


def parse(media: Column) -> Column:
    """struct<``PARSED``> of a transport stream; null gives nulls, and no packets an empty payload."""
    unit = pa.struct([("pts", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())])
    kinds = {"payload": pa.binary(), "program": pa.int32(), "stream_pid": pa.int32(), "stream_type": pa.int32(), "packets": pa.int64(),
             "continuity_errors": pa.int64(), "table_errors": pa.int64(), "units": pa.list_(unit)}

    def run(v: pa.Array) -> pa.Array:
        found = [{} if m is None else demux(m) for m in v.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f.get(c) for f in found], k) for c, k in kinds.items()], list(kinds))

    return F.arrow_udf(run, PARSED)(media)


def seek(units: Column, pts: Column) -> Column:
    """The last random-access point at or before a time, as a unit; null before the first."""
    return F.element_at(F.filter(units, lambda u: u["random_access"] & (u["pts"] <= pts)), -1)


def padded(text: Column, block: int = BLOCK) -> Column:
    """Bytes 0 behind a binary column, up to the next positive multiple of ``block``."""
    size = F.octet_length(text)
    return F.concat(text, F.substring(F.lit(bytes(block)), 1, F.greatest(F.lit(block), F.ceil(size / block) * block).cast("int") - size))


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media, parsed of every row: its padded text as a stream, and what parsing the stream gives. Null text is
    empty; repeated rows, null ids and very long texts are rows like any other, other columns are not read, and
    an empty table gives no rows. Nothing is shuffled."""
    rows = docs.select(docs[id_col].alias("doc_id"), bytes_of(text_col).alias("text"))
    stored = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), store(padded(F.col("text"))).alias("media"))
    return stored.withColumn("parsed", parse(F.col("media")))


def feature(parsed: Column) -> Column:
    """A line of text that tells the streams of a parsed row: tables, packets, errors, times, random-access points.

    A null row gives null; parts that a stream doesn't have (of a broken or empty one) are left out of the line.
    """
    points = F.filter(parsed["units"], lambda u: u["random_access"])
    return F.to_json(F.struct(
        parsed["program"].alias("program"), parsed["stream_pid"].alias("pid"), parsed["stream_type"].alias("type"), parsed["packets"].alias("packets"),
        parsed["continuity_errors"].alias("gaps"), parsed["table_errors"].alias("broken"), F.size(parsed["units"]).alias("units"),
        F.get(parsed["units"], 0)["pts"].alias("first_pts"), F.element_at(parsed["units"], -1)["pts"].alias("last_pts"),
        F.size(points).alias("points"), F.element_at(points, -1)["packet"].alias("last_point")))
