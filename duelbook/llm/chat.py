"""Chat formatting of typed content parts, in DataFrame operations only.

A message is a list of parts: text, image, audio or document. Visiting the parts in order flattens a message to text
with one numbered placeholder per attachment; each attachment is recorded with its reference, its place and the number
of tokens that its placeholder will expand to. Messages become turns between control strings of the template. Inside
texts the characters that could begin a control string are escaped, so a text never contains one, and reading back
splits at the turn marks and undoes the escapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.functions.binding import bind

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Escapes, in the order in which they are applied: no text keeps a character that a control string begins with.
ESCAPES = (("&", "&a;"), ("<", "&l;"), ("[", "&b;"))
#: Patches of an image side of 14 pixels merged two by two, audio frames a second, tokens a document page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 768
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def tokens_of(part: Column) -> Column:
    """Tokens that the placeholder of a part expands to; 0 for text and for unknown kinds. Missing measures count as the least."""
    def whole(x):
        return F.ceil(F.coalesce(x, F.lit(0))).cast("long")

    one = F.lit(1).cast("long")
    return (F.when(part["kind"] == "image", F.greatest(one, whole(part["width"] / IMAGE_PATCH) * whole(part["height"] / IMAGE_PATCH)))
            .when(part["kind"] == "audio", F.greatest(one, whole(part["seconds"] * AUDIO_RATE)))
            .when(part["kind"] == "document", F.greatest(one, F.coalesce(part["pages"], F.lit(1)).cast("long") * PAGE_TOKENS))
            .otherwise(F.lit(0).cast("long")))


def text_part(text: Column) -> Column:
    """A message that is one text; null as empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def _visit(parts: Column, kind) -> Column:
    """Parts of a message (null parts and null lists skipped) with what ``kind`` makes of each."""
    kept = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    return F.transform(kept, kind)


def flatten(parts: Column) -> Column:
    """Parts as one text: escaped texts and placeholders ``<|image|>``, ``<|audio|>``, ``<|document|>``; other kinds become ``<|part|>``."""
    known = F.array(F.lit("image"), F.lit("audio"), F.lit("document"))
    return F.array_join(_visit(parts, lambda p: F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), F.when(F.array_contains(known, p["kind"]), p["kind"]).otherwise(F.lit("part")), F.lit("|>")))), "")


def attachments(parts: Column) -> Column:
    """array<struct<kind, ref, tokens>> of the parts that aren't text, in order."""
    seen = _visit(parts, lambda p: F.struct(F.coalesce(p["kind"], F.lit("part")).alias("kind"), p["ref"].alias("ref"), tokens_of(p).alias("tokens")))
    return F.filter(seen, lambda p: p["kind"] != "text")


def format_chats(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, turn_starts, loss_spans, attachments.

    messages: conv_id, turn, role, parts (``array<PART>``); other columns are not read. formatted: every turn, in the order of turn
    (ties by role, then text; null turns first), as TURN role BODY text END. turn_starts: first character of each turn.
    loss_spans: (turn's number, start, length) of
    the text of each turn whose role is learned, between its marks. Positions are code points from 0. attachments:
    kind, ref, tokens and the turn's number of every attachment, in the order of the placeholders. A null role is
    empty. Rows with a null conv_id are one conversation; an empty table gives no rows. A turn is formatted and measured
    before it moves; a conversation, which is one sequence and one row of the result, meets in one task.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    body = flatten(F.col("parts"))
    turns = messages.select("conv_id", "turn", role.alias("role"), body.alias("body"), attachments(F.col("parts")).alias("files"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    turns = turns.select("conv_id", "turn", "role", F.concat(head, F.col("body"), F.lit(END)).alias("piece"),
                         F.char_length(head).cast("long").alias("head"), F.char_length("body").cast("long").alias("n"), "files")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.col("head") + F.col("n") + len(END)).over(before), F.lit(0)))
    row = F.struct("turn", "role", "piece", "start", "head", "n", "files")
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    spans = F.filter(F.transform("t", lambda x, i: F.struct(i.alias("turn"), (x["start"] + x["head"]).alias("start"), x["n"].alias("length"),
                                                            x["role"].alias("role"))), lambda x: x["role"].isin(*learned))
    files = F.flatten(F.transform("t", lambda x, i: F.transform(x["files"], lambda f: F.struct(
        i.alias("turn"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return chats.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
                        F.transform("t", lambda x: x["start"]).alias("turn_starts"),
                        F.transform(spans, lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
                        files.alias("attachments"))


def pieces_of(formatted: Column) -> Column:
    """Formatted turns, without their end marks; no text can contain one."""
    return F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay as they are."""
    return F.transform(pieces_of(formatted), lambda p: F.struct(
        unescape(F.replace(F.substring_index(p, BODY, 1), F.lit(TURN), F.lit(""))).alias("role"),
        unescape(F.substring_index(p, BODY, -1)).alias("text")))


def learned_text(formatted: Column, turn_starts: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped, in order; each span is read within its turn. The turns are split once, not for each span."""
    def read(pieces: Column, starts: Column) -> Column:
        return F.array_join(F.transform(loss_spans, lambda s: unescape(
            F.get(pieces, s["turn"]).substr((s["start"] - F.get(starts, s["turn"]) + 1).cast("int"), s["length"].cast("int")))), "")

    return bind(pieces_of(formatted), lambda pieces: bind(turn_starts, lambda starts: read(pieces, starts)))
