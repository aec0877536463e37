"""Chat formatting: turns sorted, adjacent turns of a role merged, one string per conversation; Spark expressions only.

Template: `<|im_start|>role\n text <|im_sep|> text ... <|im_end|>\n` for each run of turns with the same role.
`<|im_sep|>` stands between the merged texts, so the turns can be read back. Inside roles and texts `<~` becomes `<~~`
and `<|` becomes `<~|`, after which no control string can occur; in roles a line feed becomes `<~n`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<~"), F.lit("<~~")), F.lit("<|"), F.lit("<~|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<~|"), F.lit("<|")), F.lit("<~~"), F.lit("<~"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<~n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<~n"), F.lit("\n")))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, segments array<struct<text, loss>> (their texts joined are `formatted`).

    The loss mask is `loss`: true for the texts of `trained_role`, without template and separators. Null texts and
    roles are empty; turns with the same number are ordered by role and text, null numbers first; repeated rows
    are turns of their own; a null conv_id is a conversation. A conversation is one string and so is built in one task.
    """
    rows = turns.select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t")
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    opens = lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"])
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.array(
                segment(
                    F.when(opens(i), F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(END + "\n")), F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP)),
                    F.lit(False),
                ),
                segment(escape(t["text"]), t["role"] == trained_role),
            ),
        )
    )
    pieces = F.concat(pieces, F.array(segment(F.lit(END + "\n"), F.lit(False))))
    out = grouped.select("conv_id", pieces.alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted string, in order."""
    messages = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda m: m != "")
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                F.split(F.replace(F.substring(m, F.instr(m, "\n") + 1, F.length(m)), F.lit(END + "\n"), F.lit("")), r"<\|im_sep\|>"),
                lambda text: F.struct(unescape_role(F.substring_index(m, "\n", 1)).alias("role"), unescape(text).alias("text")),
            ),
        )
    )
