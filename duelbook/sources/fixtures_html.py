"""Result pages to perspectives (SRC12, SRC13, WIN14, SC9-SC11).

Input is a table of pages (page_id, html).  Only the fixed page layout is understood:
heading spans, clock spans and match rows.  A page is cut at its headings and these at their clocks
inside its row, and then exploded: no shuffle, and work in proportion to the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.functions.binding import bind, select_once
from duelbook.functions.names import player_in_parentheses
from duelbook.functions.times import LOCAL_ZONE, iso_local, iso_z
from duelbook.sources.fixtures_json import two_sides

LEAGUE, SOURCE_TYPE = "EADRIATIC", "eadriatic_html"
ROLLOVER_HOURS = 8
# Shapes of the page elements and of their texts.
_HEADING_START = r"(?is)(?=<span\b[^>]*\bclass\s*=\s*[\"'][^\"']*\bfg-heading\b)"
_CLOCK_START = r"(?is)(?=<span\b[^>]*\bclass\s*=\s*[\"'][^\"']*\btime-heading\b)"
_SPAN = r"(?is)^(<span\b[^>]*>.*?</span>)"
_ROW = r"(?is)<tr\b[^>]*\bdata-match-href\s*=.*?</tr>"
_HREF = r"(?is)\bdata-match-href\s*=\s*[\"']([^\"']*)[\"']"
_CELLS = r"(?is)<td\b[^>]*>(.*?)</td>"
_SCORE = r"(\d+)\s*-\s*(\d+)"
_HEADING = r"^(.*?)(\d{2}\.\d{2}\.\d{3,4})$"
_ROUND = r"\bR(\d+)\b"
_DETAIL = r"^(.*?)\s+R(\d+)\((.*?)\)$"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def _text(markup: Column, joiner: str = "") -> Column:
    """Visible text with tags removed and pieces trimmed."""
    t = F.regexp_replace(markup, r"(?s)\s*<[^>]*>\s*", joiner)
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.regexp_replace(t, r"^[\s ]+|[\s ]+$", "")


def _linked_rows(markup: Column) -> Column:
    """Match rows of a stretch of a page that have a link, in order."""
    return F.filter(F.regexp_extract_all(markup, F.lit(_ROW), F.lit(0)), lambda r: F.regexp_extract(r, _HREF, 1) != "")


def _blocks(html: Column) -> Column:
    """The blocks of a page: label, raw date, day, clocks and rows (clock, e), cut at the headings and within them at the clocks.

    What stands before the first heading belongs to no block. The clock of a row is the last one before it in its block.
    """
    def read(block: Column) -> Column:
        return bind(_text(F.regexp_extract(block, _SPAN, 1)), lambda heading: below(heading, block))

    def below(heading: Column, block: Column) -> Column:
        label, raw = F.regexp_extract(heading, _HEADING, 1), F.regexp_extract(heading, _HEADING, 2)

        def part(p: Column, i: Column) -> Column:
            """Clock and rows of a part; the clock is read once, not once a row."""
            return F.struct(F.when(i > 0, _text(F.regexp_extract(p, _SPAN, 1))).alias("clock"), _linked_rows(p).alias("found"))

        def timed(parts: Column) -> Column:
            rows = F.flatten(F.transform(parts, lambda p: F.transform(p["found"], lambda r: F.struct(p["clock"].alias("clock"), r.alias("e")))))
            times = F.filter(F.transform(parts, lambda p: p["clock"]), lambda c: F.coalesce(F.regexp_like(c, F.lit(r"^\d{2}:\d{2}$")), F.lit(False)))
            return F.struct(
                F.when(raw != "", F.trim(label)).alias("label"), F.when(raw != "", raw).alias("raw"),
                F.when(F.length(raw) == 10, F.try_to_date(raw, "dd.MM.yyyy")).alias("day"), times.alias("times"), rows.alias("rows"))

        return bind(F.transform(F.split(block, _CLOCK_START), part), timed)

    return F.transform(F.filter(F.split(html, _HEADING_START), lambda x, i: (i > 0) | F.regexp_like(x, F.lit(f"^{_HEADING_START}"))), read)


def match_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, home, home_score, away_score, away): finished rows without dates, one per link (SRC13)."""
    r = pages.select("page_id", F.posexplode(_linked_rows(F.col("html"))).alias("pos", "e"))
    r = select_once(r, "page_id", "pos", F.regexp_extract("e", _HREF, 1).alias("href"), _match(F.col("e")).alias("m"))
    # The first row of a link decides, finished or not.
    first = r.groupBy("page_id", "href").agg(F.min_by(F.struct("pos", "m"), "pos").alias("f"))
    return first.select("page_id", "f.pos", "f.m.*").filter(_COMPLETE)


_COMPLETE = "home IS NOT NULL AND away IS NOT NULL AND home_score IS NOT NULL AND away_score IS NOT NULL"


def _match(row: Column) -> Column:
    """Struct(home, home_score, away_score, away) of a match row; NULL parts where it is not a finished match."""
    def read(td: Column) -> Column:
        ok = F.size(td) >= 3
        score = F.when(ok, _text(F.get(td, F.lit(1)), " "))
        return F.struct(
            F.when(ok, player_in_parentheses(_text(F.get(td, F.lit(0))))).alias("home"),
            F.regexp_extract(score, _SCORE, 1).try_cast("int").alias("home_score"),
            F.regexp_extract(score, _SCORE, 2).try_cast("int").alias("away_score"),
            F.when(ok, player_in_parentheses(_text(F.get(td, F.lit(2))))).alias("away"),
        )

    return bind(F.regexp_extract_all(row, F.lit(_CELLS), F.lit(1)), read)


def _full_years(blocks: Column) -> Column:
    """Left to right: complete a three-digit year from neighbours that agree on one date.

    The left neighbour may itself have been completed just before.
    """
    days = F.array().cast("array<date>")

    def step(acc: Column, i: Column) -> Column:
        b = F.get(blocks, i)
        left, right = F.get(acc, i - 1), F.get(blocks, i + 1)["day"]

        def fits(d: Column) -> Column:
            return F.coalesce(F.startswith(F.date_format(d, "dd.MM.yyyy"), b["raw"]), F.lit(False))

        found = (
            F.when(fits(left) & fits(right) & (left != right), F.lit(None).cast("date"))
            .when(fits(left), left).when(fits(right), right)
        )
        short = b["day"].isNull() & F.coalesce(F.length(b["raw"]) == 9, F.lit(False))
        return F.array_append(acc, F.when(short, found).otherwise(b["day"]))

    return F.when(F.size(blocks) > 0, F.aggregate(F.sequence(F.lit(0), F.size(blocks) - 1), days, step)).otherwise(days)


def _rolled_over(blocks: Column, days: Column) -> Column:
    """Right to left: a round whose first match would otherwise lie a day early moves to the next day.

    It does when the next round is on the following date and starts within the allowed
    hours after the moved start.
    """
    none = F.array().cast("array<date>")

    def round_no(b: Column) -> Column:
        return F.regexp_extract(b["label"], _ROUND, 1).try_cast("int")

    def step(acc: Column, i: Column) -> Column:
        b, nxt, day = F.get(blocks, i), F.get(blocks, i + 1), F.get(days, i)
        next_day = F.get(acc, F.lit(0))
        # Equal dates after the move: the gap is the difference of the two first clocks.
        def minutes(x):
            t = F.array_min(x["times"])
            return F.substring(t, 1, 2).try_cast("int") * 60 + F.substring(t, 4, 2).try_cast("int")
        gap = minutes(nxt) - minutes(b)
        moves = ((round_no(nxt) == round_no(b) + 1) & (next_day == F.date_add(day, 1)) & gap.between(0, ROLLOVER_HOURS * 60))
        return F.array_prepend(acc, F.when(F.coalesce(moves, F.lit(False)), F.date_add(day, 1)).otherwise(day))

    order = F.reverse(F.sequence(F.lit(0), F.size(blocks) - 1))
    return F.when(F.size(blocks) > 0, F.aggregate(order, none, step)).otherwise(none)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """One row per page: its blocks with their rows, and the blocks' recovered dates."""
    p = select_once(pages, *[c for c in pages.columns if c != "html"], _blocks(F.col("html")).alias("_b"))
    # Only what the dates depend on is folded: a few values a block.
    short = F.transform("_b", lambda b: F.struct(b["label"].alias("label"), b["raw"].alias("raw"), b["day"].alias("day"), b["times"].alias("times")))
    return p.withColumn("_d", bind(short, lambda blocks: _rolled_over(blocks, _full_years(blocks))))


def page_matches(pages: DataFrame) -> DataFrame:
    """Finished matches with date and place on the page; the first row of a link wins per page."""
    keep = [c for c in pages.columns if c != "html"]
    blocks = parsed_pages(pages).select(*keep, F.posexplode(F.arrays_zip("_b", "_d")).alias("block", "x"))
    rows = blocks.select(*keep, "block", F.col("x._b.label").alias("label"), F.col("x._d").alias("day"), F.posexplode("x._b.rows").alias("ord", "r"))
    rows = rows.filter("day IS NOT NULL").filter(F.regexp_like("r.clock", F.lit(r"^([01]\d|2[0-3]):[0-5]\d$")))
    # Each row's text is read once; what comes out is plain data.
    rows = select_once(rows, *keep, "block", "ord", F.col("r.clock").alias("clock"), "label", "day",
                       F.regexp_extract(F.regexp_extract("r.e", _HREF, 1), r"^/match/(\d+)\.html$", 1).alias("native_match_id"), _match(F.col("r.e")).alias("m"))
    rows = rows.filter("native_match_id <> ''").select(*keep, "block", "ord", "clock", "label", "day", "native_match_id", "m.*").filter(_COMPLETE)
    minutes = F.substring("clock", 1, 2).try_cast("int") * 60 + F.substring("clock", 4, 2).try_cast("int")
    wall = F.timestamp_add("MINUTE", minutes, F.col("day").cast("timestamp_ntz"))
    detail = [F.regexp_extract("label", _DETAIL, i) for i in (1, 2, 3)]
    named = detail[1] != ""
    slug = F.regexp_replace(F.regexp_replace(F.lower("label"), r"(?U)[^\w]+", "-"), r"^-+|-+$", "")
    rows = rows.select(
        *keep, "native_match_id", F.concat(F.lit(f"{LEAGUE.lower()}:"), F.col("native_match_id")).alias("match_id"),
        "home", "away", "home_score", "away_score",
        F.convert_timezone(F.lit(LOCAL_ZONE), F.lit("UTC"), wall).alias("ts"),
        F.when(named, F.concat(F.trim(detail[0]), F.lit(" R"), detail[1])).otherwise(F.col("label")).alias("round"),
        F.when(named & (F.trim(detail[2]) != ""), F.trim(detail[2])).alias("competition"),
        F.concat(F.lit(f"{LEAGUE.lower()}:"), slug, F.lit(":"), F.col("day").cast("string")).alias("group_key"),
        F.col("block").alias("source_block_order"), F.col("ord").alias("source_row_order"),
    )
    place = F.struct("source_block_order", "source_row_order")
    others = [c for c in rows.columns if c not in ("page_id", "match_id")]
    return rows.groupBy("page_id", "match_id").agg(F.min_by(F.struct(*others), place).alias("m")).select("page_id", "match_id", "m.*")


def perspectives_from_pages(pages: DataFrame, source_file: Column | None = None, collected_at: Column | None = None) -> DataFrame:
    """Two perspectives per finished match of every page; clock times are local and inferred."""
    m = page_matches(pages)
    none = F.lit(None).cast("string")
    return two_sides(m, LEAGUE, F.col("home"), F.col("away"), {
        "page_id": F.col("page_id"), "ts": F.col("ts"), "timestamp": iso_local(F.col("ts"), precision="minute"),
        "timestamp_utc": iso_z(F.col("ts"), "minute"), "timestamp_precision": F.lit("minute"), "timezone": F.lit(LOCAL_ZONE),
        "timezone_inferred": F.lit(True), "source_type": F.lit(SOURCE_TYPE),
        "source_file": F.col("page_id").cast("string") if source_file is None else source_file,
        "data_quality": F.lit("inferred"), "native_match_id": F.col("native_match_id"), "competition": F.col("competition"),
        "round": F.col("round"), "group_key": F.col("group_key"), "source_block_order": F.col("source_block_order"),
        "source_row_order": F.col("source_row_order"), "collected_at": none if collected_at is None else collected_at,
    })
