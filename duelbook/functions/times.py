"""Instants, local days and order-preserving time slices (SC3-SC7, FLT11, FLT12).

Instants are carried as TIMESTAMP_NTZ holding the UTC wall clock, so no result
depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelbook.functions.binding import bind

LOCAL_ZONE = "Europe/Madrid"

# ISO-8601 shapes.
_ZONE_SUFFIX = r"(?:Z|[+-]\d{2}:?\d{2})$"
_NO_SECONDS = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$"
_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"


def from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a UTC wall clock.

    Built from calendar fields: differences of TIMESTAMP_NTZ values would go through the
    session time zone and jump with its clock changes.
    """
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    days = F.unix_date(ts.cast("date")).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * F.lit(60_000_000) + seconds


def parse_utc(text: Column, naive_zone: str = "UTC") -> Column:
    """ISO-8601 text -> UTC instant; NULL when unparsable.

    A stamp without an offset is read in ``naive_zone``.  Minute precision
    (``2026-07-14T08:00Z``) and bare dates are accepted.
    """
    def completed(s: Column) -> Column:
        return F.when(F.regexp_like(s, F.lit(_DATE_ONLY)), F.concat(s, F.lit("T00:00:00"))).otherwise(
            F.regexp_replace(s, _NO_SECONDS, "$1:00$2"))

    def parsed(s: Column) -> Column:
        naive = s.try_cast("timestamp_ntz")
        if naive_zone != "UTC":
            naive = bind(naive, lambda wall: _instant(wall, naive_zone))
        zoned = F.regexp_like(s, F.lit(_ZONE_SUFFIX))
        return F.when(zoned, from_micros(F.unix_micros(s.try_cast("timestamp")))).otherwise(naive)

    return bind(bind(F.trim(text), completed), parsed)


def _instant(wall: Column, zone: str) -> Column:
    """The instant of a wall clock in ``zone``: of an hour that comes twice the second one; in an hour left out, the clock goes on as before."""
    def settled(first: Column) -> Column:
        day_on = F.timestamp_add("DAY", F.lit(1), first)
        second = from_micros(micros(wall) - (micros(to_local(day_on, zone)) - micros(day_on)))
        return F.when(to_local(second, zone) == wall, second).otherwise(first)

    return bind(F.convert_timezone(F.lit(zone), F.lit("UTC"), wall), settled)


def event_time(utc_text: Column, local_text: Column) -> Column:
    """First non-blank of the two stamps, parsed (sessions, pairing, snapshots)."""
    first = F.when(F.trim(utc_text) != "", utc_text).otherwise(local_text)
    return parse_utc(first)


def iso_z(ts: Column, precision: str | None = None) -> Column:
    """UTC text ending in ``Z``; micros only when present, or to a fixed precision."""
    body = F.replace(F.substring(ts.cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    if precision == "minute":
        return F.concat(F.substring(body, 1, 16), F.lit("Z"))
    if precision == "second":
        return F.concat(body, F.lit("Z"))
    return F.concat(body, _fraction(ts), F.lit("Z"))


def _fraction(ts: Column) -> Column:
    part = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long") % F.lit(1_000_000)
    return F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(F.lit(""))


def to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def local_offset(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    # Both are TIMESTAMP_NTZ, whose differences know no zone. Zones of the 19th century have seconds; minutes are rounded down.
    gap = to_local(ts, zone) - ts
    hours, minutes, seconds = (F.extract(F.lit(part), gap) for part in ("HOUR", "MINUTE", "SECOND"))
    total = hours.cast("int") * 60 + minutes.cast("int") - F.when(seconds < 0, 1).otherwise(0)
    return F.concat(
        F.when(total < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.call_function("div", F.abs(total), F.lit(60)).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.abs(total) % 60).cast("string"), 2, "0"),
    )


def iso_local(ts: Column, zone: str = LOCAL_ZONE, precision: str | None = None) -> Column:
    local = to_local(ts, zone)
    body = F.replace(F.substring(local.cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    if precision == "minute":
        body = F.substring(body, 1, 16)
    elif precision is None:
        body = F.concat(body, _fraction(ts))
    return F.concat(body, local_offset(ts, zone))


def local_date(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Calendar day in ``zone``; unlike fixed 24 h windows this is right across DST."""
    return to_local(ts, zone).cast("date")


def local_midnight_utc(day: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def local_day_range(day: Column, zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """UTC bounds of a local day as ``....000Z`` text."""
    start = local_midnight_utc(day, zone)
    end = local_midnight_utc(F.date_add(day, 1), zone)
    return tuple(F.concat(F.substring(iso_z(t, "second"), 1, 19), F.lit(".000Z")) for t in (start, end))


def utc_literal(value: datetime | date | str) -> Column:
    """A bound given by the caller, as a UTC instant literal; naive means UTC."""
    return F.lit(utc_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def utc_datetime(value: datetime | date | str) -> datetime:
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.strip())
        except ValueError as exc:
            raise ValueError(f"not an ISO-8601 datetime: {value!r}") from exc
    if not isinstance(value, datetime):
        raise ValueError(f"expected a datetime or ISO-8601 text, got {value!r}")
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def parse_kickoff(text: Column) -> Column:
    """Struct(ts, timestamp, timestamp_utc, precision, zone, inferred) of a fixture kickoff.

    A kickoff without an offset is local time (the feed's day boundaries are local); its ``timestamp`` shows the instant's own local
    clock, so that an hour the clock leaves out is never shown.
    """
    def with_instant(raw: Column) -> Column:
        seconds = F.regexp_like(raw, F.lit(r"[T ]\d{2}:\d{2}:\d{2}"))
        return F.struct(
            raw.alias("raw"), parse_utc(raw, naive_zone=LOCAL_ZONE).alias("ts"),
            F.when(seconds, F.lit(19)).otherwise(F.lit(16)).alias("keep"),
            F.endswith(raw, F.lit("Z")).alias("z"), F.regexp_extract(raw, r"([+-]\d{2}):?(\d{2})$", 0).alias("offset"),
            F.replace(F.substring(F.regexp_replace(raw, _NO_SECONDS, "$1:00$2"), 1, 19), F.lit(" "), F.lit("T")).alias("wall"),
        )

    def labelled(k: Column) -> Column:
        ts, keep = k["ts"], k["keep"]
        zoned = k["z"] | (k["offset"] != "")
        colon = F.concat(F.substring(k["offset"], 1, 3), F.lit(":"), F.substring(k["offset"], -2, 2))
        shown = F.when(k["z"], F.lit("+00:00")).otherwise(colon)
        local = iso_local(ts, precision="second")
        return F.struct(
            ts.alias("ts"), F.when(zoned, F.concat(F.substring(k["wall"], F.lit(1), keep), shown)).otherwise(
                F.concat(F.substring(local, F.lit(1), keep), F.substring(local, 20, 6))).alias("timestamp"),
            F.concat(F.substring(iso_z(ts, "second"), F.lit(1), keep), F.lit("Z")).alias("timestamp_utc"),
            F.when(keep == 19, F.lit("second")).otherwise(F.lit("minute")).alias("precision"),
            F.when(k["z"], F.lit("UTC")).when(zoned, F.concat(F.lit("UTC"), colon)).otherwise(F.lit(LOCAL_ZONE)).alias("zone"),
            (~zoned).alias("inferred"),
        )

    return bind(bind(F.trim(text), with_instant), labelled)


# --- order-preserving slices -------------------------------------------------

SLICES = ("month", "day", "hour", "minute", "stamp")


def time_slice(slice_by: str = "day", tie_prefix: int = 0) -> Column:
    """A value that never decreases along (ts, match_id): the unit of ordered work.

    Ordered operators run per (identity, slice) and then stitch slice summaries,
    so one very active identity is spread over as many tasks as it has slices.
    ``stamp`` with ``tie_prefix`` cuts even equal stamps, by match-id prefix.
    """
    ts = F.col("ts")
    if slice_by == "month":
        return F.trunc(ts.cast("date"), "month")
    if slice_by == "day":
        return ts.cast("date")
    if slice_by == "hour":
        return F.floor(micros(ts) / 3_600_000_000)
    if slice_by == "minute":
        return F.floor(micros(ts) / 60_000_000)
    if slice_by == "stamp":
        return F.struct(ts.alias("at"), F.substring(F.col("match_id"), 1, tie_prefix).alias("tie"))
    raise ValueError(f"slice_by must be one of {SLICES}, got {slice_by!r}")
