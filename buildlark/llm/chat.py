"""Chat formatting with a grammar round trip, with DataFrame functions only.

A conversation is a sequence of turns, each ``<|im_start|>role LF text <|im_end|> LF``. The parser is
deterministic: it cuts at every end mark, wants a start mark and no other one in each cut, and takes
the role up to the first line feed. A turn is rendered as it is and parsed again; if the parser does
not recover exactly its role and text, its content is escaped. Whole conversations are parsed again
before they are handed out, and a difference is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlark.session import new_table_path

START, END = "<|im_start|>", "<|im_end|>"
LF = "\n"


def escape(s: Column) -> Column:
    """No control string is left in the result; ``unescape`` gives ``s`` again."""
    return F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(s: Column) -> Column:
    return F.replace(escape(s), F.lit(LF), F.lit("&#10;"))


def unescape_role(s: Column) -> Column:
    return unescape(F.replace(s, F.lit("&#10;"), F.lit(LF)))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(LF), text, F.lit(END + LF))


def parse(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>``; NULL if the string is not of the grammar."""
    cuts = F.split(formatted, r"<\|im_end\|>", -1)
    bodies = F.transform(
        cuts,
        lambda s, i: F.when(i == 0, s).when(F.startswith(s, F.lit(LF)), F.substr(s, F.lit(2))),
    )
    turns = F.slice(bodies, F.lit(1), F.size(bodies) - 1)
    inner = F.transform(turns, lambda s: F.when(F.startswith(s, F.lit(START)), F.substr(s, F.lit(len(START) + 1))))

    def turn(s: Column) -> Column:
        at = F.instr(s, LF)
        return F.when((at > 0) & ~F.contains(s, F.lit(START)), F.struct(
            unescape_role(F.substr(s, F.lit(1), at - 1)).alias("role"),
            unescape(F.substr(s, at + 1)).alias("text"),
        ))

    out = F.transform(inner, turn)
    good = (F.element_at(bodies, -1) == "") & ~F.exists(out, lambda t: t.isNull())
    return F.when(good, out)


def _recovered(rendered: Column, role: Column, text: Column) -> Column:
    return parse(rendered).eqNullSafe(F.array(F.struct(role.alias("role"), text.alias("text"))))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` of each conversation.

    ``rows`` has conv_id, turn, role, text; turns are in order of turn, then role and text. NULL
    role or text counts as empty; NULL turns come first; rows with a NULL conv_id make one
    conversation; repeated rows are repeated turns; other columns are ignored; no rows give no rows.
    ``loss_mask`` holds the 1-based start and the length, in code points of ``formatted``, of each
    assistant text. One conversation is one string, so it must fit one row (2 GB).
    """
    role, text = F.col("role"), F.col("text")
    turns = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("_plain", _recovered(render(role, text), role, text))
    shown_role = F.when(F.col("_plain"), role).otherwise(escape_role(role))
    shown_text = F.when(F.col("_plain"), text).otherwise(escape(text))
    turns = turns.withColumns({"_role": shown_role, "_text": shown_text}).withColumn("_turn", render(F.col("_role"), F.col("_text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("_no", F.row_number().over(order)).withColumn(
        "_end", F.sum(F.length("_turn")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    text_at = F.col("_end") - F.length(F.lit(END + LF)) - F.length("_text") + 1
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "_no", "_turn", "role", "text",
        F.when(role == "assistant", F.struct(text_at.cast("int").alias("start"), F.length("_text").alias("length"))).alias("mask"),
    ))).alias("t"))
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = held.select(
        "conv_id",
        F.array_join(F.col("t._turn"), "").alias("formatted"),
        F.filter(F.col("t.mask"), lambda m: m.isNotNull()).alias("loss_mask"),
        source.alias("_source"),
    )
    checked = F.when(parse(F.col("formatted")).eqNullSafe(F.col("_source")), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("the turns were not recovered: "), F.col("conv_id").cast("string")))
    )
    return out.select("conv_id", checked.alias("formatted"), "loss_mask")


def write_formatted(rows: DataFrame, path: str | None = None) -> str:
    """Write the formatted conversations as Parquet; returns the path."""
    path = path or new_table_path(rows.sparkSession, "chat")
    format_conversations(rows).write.parquet(path)
    return path


def read_turns(formatted: DataFrame) -> DataFrame:
    """Adds the recovered ``turns`` and the unescaped ``loss_texts`` to rows of a formatted file."""
    mask = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"], m["length"])))
    return formatted.select("*", parse(F.col("formatted")).alias("turns"), mask.alias("loss_texts"))
