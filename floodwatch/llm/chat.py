"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of
one role are merged by an array aggregation, and the pieces are concatenated.

A formatted conversation is a sequence of messages:
``<|start|>role<|text|>text<|next|>text<|end|>``, where ``<|next|>`` parts the
turns that a message merges. Control strings inside roles and texts are escaped
by one backslash after their first character (behind it, one more joins those
that are there), so no text can forge a mark, and :func:`unescape` gives the
text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings of common chat templates, escaped beside the marks above.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_TAILS = "|".join(m[1:].replace("|", "\\|").replace("]", "\\]") for m in (START, TEXT, NEXT, END, *FOREIGN))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])(\\\\*)({_TAILS})", "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])\\\\(\\\\*)({_TAILS})", "$1$2$3")


def merged(turns: Column) -> Column:
    """Messages (role, texts) of sorted turns: a turn of the last message's role joins it."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def step(acc, turn):
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["role"] == turn["role"])
        alone = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(alone)))
    return F.aggregate(turns, empty, step)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv``, formatted (string), loss_spans (code-point start and end of each learned turn's text).

    Turns are sorted by ``turn`` (nulls first), then role, then text, so equal
    turn numbers have one order; repeated rows stay. Null roles and texts are
    empty. Rows of a null conversation form one conversation. Other columns are
    not read. A conversation is one output row, so it is gathered in one row;
    partial lists are built before the shuffle.
    """
    own = rows.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    turns = own.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_turn", "_role", "_text"))).alias("_turns"))
    pairs = F.transform("_turns", lambda t: F.struct(escape(t["_role"]).alias("role"), escape(t["_text"]).alias("text")))
    messages = turns.select("_conv", merged(pairs).alias("_messages"))
    body = lambda m: F.concat(F.lit(START), m["role"], F.lit(TEXT), F.array_join(m["texts"], NEXT), F.lit(END))
    learned = [escape(F.lit(r)) for r in learn]
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def within(acc, text_):
        end = acc["at"] + F.length(text_)
        return F.struct((end + len(NEXT)).alias("at"), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).alias("spans"))

    def over(acc, m):
        begin = acc["at"] + (len(START) + len(TEXT)) + F.length(m["role"])
        inner = F.aggregate(m["texts"], F.struct(begin.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), within)
        return F.struct((inner["at"] - len(NEXT) + len(END)).alias("at"), F.when(m["role"].isin(*learned), F.concat(acc["spans"], inner["spans"])).otherwise(acc["spans"]).alias("spans"))
    return messages.select(F.col("_conv").alias(conv), F.array_join(F.transform("_messages", body), "").alias("formatted"),
                           F.aggregate("_messages", nothing, over)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    messages = F.filter(F.split(formatted, F.lit("<\\|end\\|>"), -1), lambda m: m != "")
    parts = F.transform(messages, lambda m: F.split(m, "<\\|text\\|>", 2))
    return F.flatten(F.transform(parts, lambda p: F.transform(
        F.split(p[1], "<\\|next\\|>", -1),
        lambda t: F.struct(unescape(F.substring(p[0], len(START) + 1, 1 << 30)).alias("role"), unescape(t).alias("text")))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one turn after another."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digests() -> dict:
    """The read-back columns of :func:`format_chats` rows."""
    turns = read_back(F.col("formatted"))
    learned = loss_text(F.col("formatted"), F.col("loss_spans"))
    listing = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return {"n_turns": F.size(turns).cast("long"), "turns_sha256": F.sha2(listing.cast("binary"), 256), "loss_chars": F.length(learned).cast("long"),
            "loss_sha256": F.sha2(learned.cast("binary"), 256), "formatted_chars": F.length("formatted").cast("long")}
