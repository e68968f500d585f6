"""Chat formatting over typed content parts, in DataFrame functions only.

A turn is a list of parts. A visitor, one case for each type, turns a part into text: text parts are
escaped, the others become a placeholder and are recorded as attachments with their reference, place
and the tokens they will expand to. Turns are put between markers; the loss mask is the list of spans
of assistant content. Everything can be read back from the formatted text and the mask alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of an attachment: per 28 x 28 pixels of an image, per 40 ms of sound, per page of a document.
PIXELS, SOUND_MS, PAGE_TOKENS = 28, 40, 512
PART = "struct<type: string, text: string, ref: string, width: int, height: int, ms: bigint, pages: int>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}


def escape(text: Column) -> Column:
    """No `<|` remains: a backslash goes between the two, one more where there are some already."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    """A role is one line."""
    plain = F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(plain, F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # a backslash always begins a pair, so splitting at doubled ones from the left leaves line ends only
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _visit(part: Column) -> Column:
    """Text of a part in the formatted turn; unknown types are text."""
    out = escape(part["text"])
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def _tokens(part: Column) -> Column:
    zero = F.lit(0)
    cells = lambda n: F.ceil(F.coalesce(n, zero) / PIXELS)
    return (F.when(part["type"] == "image", cells(part["width"]) * cells(part["height"]))
            .when(part["type"] == "audio", F.ceil(F.coalesce(part["ms"], F.lit(0)) / SOUND_MS))
            .when(part["type"] == "document", F.coalesce(part["pages"], zero) * PAGE_TOKENS)).cast("bigint")


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("width"),
                            F.lit(None).alias("height"), F.lit(None).alias("ms"), F.lit(None).alias("pages"))).cast(f"array<{PART}>")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv_id, formatted, loss, attachments): a row for each conversation.

    `loss` is an array of (start, chars), zero-based code points of `formatted`, one for each
    assistant turn; `attachments` are (turn, place, type, ref, tokens) in order. Turns go by number
    (null first), role, text. Null roles and parts are empty; a null id is a conversation of its own.
    Repeated rows are turns of their own. A conversation is one row, however long, and formed in one
    task. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    seg = F.col("_wl")
    rows = turns.select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.withColumn("pieces", F.transform("parts", _visit))
    rows = rows.select(
        "conv_id", "turn", "role", F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"), F.concat_ws("", "pieces").alias("body"),
        F.transform(
            F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: x["p"]["type"].isin(list(PLACEHOLDERS))),
            lambda x: F.struct(x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), _tokens(x["p"]).alias("tokens"),
                               F.length(F.concat_ws("", F.slice("pieces", F.lit(1), x["i"]))).alias("inner"))).alias("found"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END) + 1)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "body")
    rows = rows.select(
        "conv_id", F.row_number().over(order).alias("nr"), "turn", "role", F.length("head").alias("skip"), F.length("body").alias("chars"),
        F.concat("head", "body", F.lit(END + "\n")).alias("text"), "found",
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"))
    both = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nr", "turn", "role", "start", "skip", "chars", "text", "found"))).alias("_wl"))
    loss = F.transform(F.filter(seg, lambda t: t["role"] == "assistant"),
                       lambda t: F.struct((t["start"] + t["skip"]).cast("bigint").alias("start"), t["chars"].cast("bigint").alias("chars")))
    attached = F.flatten(F.transform(seg, lambda t: F.transform(t["found"], lambda a: F.struct(
        t["turn"].alias("turn"), (t["start"] + t["skip"] + a["inner"]).cast("bigint").alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return both.select("conv_id", F.array_join(F.transform(seg, lambda t: t["text"]), "").alias("formatted"), loss.alias("loss"), attached.alias("attachments"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.lit(1 << 30))
    cut = lambda s: F.substring_index(s, f"{END}\n", 1)
    return F.transform(pieces, lambda s: F.struct(
        _unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
        unescape(F.substring(cut(s), F.length(F.substring_index(s, "\n", 1)) + 2, F.lit(1 << 30))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")
