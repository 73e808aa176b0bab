"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of parts (text, image, audio, document). A visitor turns each part into text: text is escaped, an
attachment becomes a numbered placeholder whose reference and expanded token count are recorded beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that mean something to the template or to a common tokenizer; texts never contain them raw.
CONTROL = (TURN, BODY, END, "<|image:", "<|audio:", "<|document:", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A backslash goes behind the first character of every control string, and every backslash is doubled.
_FIRSTS = r"(?s)([<\[])(?=" + "|".join(r"\Q" + c[1:] + r"\E" for c in CONTROL) + ")"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Expanded token counts: an image is cut into tiles, audio into frames, a document has a fixed cost a page.
TILE, TOKENS_PER_TILE, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 336, 144, 25, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _FIRSTS, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _tokens(part: Column) -> Column:
    tiles = lambda n: F.ceil(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) / F.lit(TILE))
    return (
        F.when(part["type"] == "image", tiles(part["width"]) * tiles(part["height"]) * TOKENS_PER_TILE)
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * TOKENS_PER_PAGE)
        .otherwise(0)
        .cast("long")
    )


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def _placeholder(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))


def parts_of_text(text: Column) -> Column:
    """One text part, for tables that have no typed parts."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    Turns go in ascending order of turn, equal turns by role and content, null turns first; repeated rows are all
    kept. A null role or text is empty; null parts, or none, make an empty turn; a part of unknown type counts as
    text. Adjacent text parts are one text, so no control string arises where they meet. A null conversation id is a
    conversation like any other. loss_spans (start, length in code points) cover the bodies of trained roles. Only
    named columns are read. A conversation is the unit of work: one shuffle, and the work grows with its parts.
    """
    own = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"))
    in_turns = W.partitionBy("conv_id").orderBy("turn", "role", "parts")
    ranked = own.withColumn("n", F.row_number().over(in_turns))
    visited = ranked.select("conv_id", "n", "role", F.posexplode_outer("parts").alias("pos", "part")).withColumn("shown", _is_attachment(F.col("part")))
    # a stretch is an attachment and the texts behind it, or the texts before a turn's first attachment
    in_parts = W.partitionBy("conv_id").orderBy("n", "pos")
    numbered = visited.withColumn("number", F.sum(F.col("shown").cast("long")).over(in_parts))
    texts = F.sort_array(F.collect_list(F.when(~F.col("shown"), F.struct("pos", F.coalesce("part.text", F.lit("")).alias("text")))))
    stretches = numbered.groupBy("conv_id", "n", "number").agg(
        F.first("role").alias("role"),
        F.max(F.when(F.col("shown"), F.struct("number", F.col("part.type").alias("type"), F.col("part.ref").alias("ref"), _tokens(F.col("part")).alias("tokens")))).alias("shown"),
        F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("text"),
    )
    flat = F.concat(F.coalesce(_placeholder(F.col("shown.type"), F.col("number")), F.lit("")), escape(F.col("text")))
    joined = stretches.groupBy("conv_id", "n").agg(
        F.first("role").alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", flat.alias("flat")))), lambda x: x["flat"]), "").alias("body"),
        F.sort_array(F.collect_list("shown")).alias("shown"),
    )
    headed = joined.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)))
    long = (F.length("head") + F.length("body") + len(END)).cast("long")
    until = F.sum(long).over(W.partitionBy("conv_id").orderBy("n"))
    span = F.struct((until - F.length("body") - len(END)).alias("start"), F.length("body").cast("long").alias("length"))
    placed = headed.withColumn("span", F.when(F.col("role").isin(*trained), span))
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END)).alias("out")))).alias("pieces"),
        F.sort_array(F.collect_list("span")).alias("loss_spans"),
        F.sort_array(F.flatten(F.collect_list("shown"))).alias("attachments"),
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["out"]), "").alias("formatted"),
        "loss_spans",
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), texts unescaped, placeholders left as they are."""
    whole = F.filter(F.split(formatted, r"\Q" + END + r"\E"), lambda x: x != "")
    halves = lambda x: F.split(F.substring(x, F.lit(len(TURN) + 1), F.length(x)), r"\Q" + BODY + r"\E", 2)
    return F.transform(F.transform(whole, halves), lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def probe(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) and conversation -1, whose texts look like control strings."""
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    extra = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", text_of("text").alias("text")).unionByName(extra)
