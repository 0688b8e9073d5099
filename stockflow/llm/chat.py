"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, merged where
neighbours share a role (array aggregation over slices) and concatenated:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n ...

``<|im_sep|>`` parts the texts of a merged block, so the single turns can be
read back. Control strings inside texts and roles are escaped by one
backslash after their first character (one more if backslashes already
stand there), which is undone exactly on reading; other text is untouched.

The loss mask is a run-length list over the code points of the formatted
text: ``(loss, chars)`` runs, one per header, text, separator and end, that
add up to its length; only the texts of ``loss_role`` are under the mask.

Defined results: null text and null role are empty; turns are ordered by
(turn, role, text) with null turns first, so ties and repeated rows have one
order; rows with null conv_id form one conversation; an empty table gives no
rows; extra columns are ignored. One conversation is one output cell, so its
turns must fit a task; no other rows are gathered with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and other common templates, none of which a text may form.
_TAIL = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>|\|endoftext\|>)"
_ESCAPE = r"([<\[])(\\*)" + _TAIL
_UNESCAPE = r"([<\[])\\(\\*)" + _TAIL


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "$1$2$3")


def _escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


_RUN = "array<struct<loss:boolean,chars:bigint>>"
_PIECE = "array<struct<chars:bigint,text:string>>"


def _runs(blocks: Column, plain, text, kind: str) -> Column:
    """The pieces of all blocks in order: header, text, (separator, text)*, end."""
    def of(b: Column) -> Column:
        pieces = F.flatten(F.transform(b["texts"], lambda t, i: F.when(i > 0, F.array(plain(F.lit(len(SEP))), text(b, t)))
                                       .otherwise(F.array(text(b, t)))))
        return F.concat(F.array(plain(F.length(b["role"]) + len(START) + 1)), pieces, F.array(plain(F.lit(len(END) + 1))))
    return F.flatten(F.transform(blocks, of)).cast(kind)


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_mask``."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    conv = conv.withColumn("turns", F.transform("turns", lambda t: F.struct(
        _escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss"))))
    # Positions (from 0) at which a block of one role starts; a block is the slice up to the next.
    n = F.size("turns")
    conv = conv.withColumn("starts", F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"])))
    conv = conv.withColumn("blocks", F.transform("starts", lambda s, j: F.struct(
        F.get("turns", s)["role"].alias("role"), F.get("turns", s)["loss"].alias("loss"),
        F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), n) - s), lambda t: t["text"]).alias("texts"))))
    body = F.transform("blocks", lambda b: F.concat(
        F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END + "\n")))
    run = lambda loss, chars: F.struct(loss.alias("loss"), chars.cast("long").alias("chars"))
    mask = _runs(F.col("blocks"), lambda chars: run(F.lit(False), chars), lambda b, t: run(b["loss"], F.length(t)), _RUN)
    return conv.select("conv_id", F.array_join(body, "").alias("formatted"), mask.alias("loss_mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read conversations back from the formatted text and its mask.

    Returns ``conv_id, turns array<struct<role,text>>, loss_texts
    array<string>, formatted_chars``. The marks of the text are cut into
    pieces; a piece is under the mask if the run at its place says so.
    ``loss_texts`` is null if the runs do not meet the pieces exactly.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")
    header = r"\A<\|im_start\|>([^\n]*)\n"
    df = formatted.select("conv_id", "formatted", "loss_mask", F.transform(blocks, lambda b: F.struct(
        F.regexp_extract(b, header, 1).alias("role"),
        F.split(F.regexp_replace(b, header, ""), r"<\|im_sep\|>", -1).alias("texts"))).alias("blocks"))
    piece = lambda chars, text: F.struct(chars.cast("long").alias("chars"), text.alias("text"))
    df = df.withColumn("pieces", _runs(
        F.col("blocks"), lambda chars: piece(chars, F.lit(None).cast("string")), lambda b, t: piece(F.length(t), t), _PIECE))
    zipped = F.zip_with("loss_mask", "pieces", lambda m, p: F.struct(
        m["loss"].alias("loss"), F.equal_null(m["chars"], p["chars"]).alias("fits"), p["text"].alias("text")))
    df = df.withColumn("z", zipped)
    marked = F.transform(F.filter("z", lambda z: z["loss"]), lambda z: unescape(z["text"]))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(
        _unescape_role(b["role"]).alias("role"), unescape(t).alias("text")))))
    return df.select("conv_id", turns.alias("turns"), F.when(F.forall("z", lambda z: z["fits"]), marked).alias("loss_texts"),
                     F.length("formatted").cast("long").alias("formatted_chars"))
