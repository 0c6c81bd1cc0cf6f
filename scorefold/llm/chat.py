"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation's turns hold ordered parts: text, image, audio or document. A visitor flattens each turn's parts into a body:
text is escaped, every other part leaves a placeholder, and its reference and the number of tokens it will expand to are
recorded in the same order. Bodies are joined by a template whose control strings mark turns. Control strings that occur
inside texts or roles are escaped so that reading the output back gives the exact texts.

Rows without a role or text count as empty strings there; rows of the same turn number are ordered by role, then body, and
repeated rows stay separate turns; null turn numbers come first. A conversation is one record of the output, so its turns
meet in one row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Placeholder of each part that is not text.
PLACES = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
CONTROL = (BOS, END, HEAD, BODY, *PLACES.values())
#: Tokens that one unit of a part expands to (image tiles, seconds of audio, document pages), and fixed ones beside them.
EXPANDS = {"image": (256, 2), "audio": (25, 2), "document": (700, 2)}
PART = "array<struct<type:string,text:string,ref:string,units:double>>"


def escape(text: Column) -> Column:
    """A backslash is doubled, and one is put behind the first character of every control string."""
    rest = "|".join(c[1:].replace("]", r"\]") for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={rest})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def flatten_parts(parts: Column) -> Column:
    """The visitor: struct(body, attachments); an unknown type counts as text, null parts are skipped.

    Neighbouring texts are joined before they are escaped, so a control string that starts in one and ends in the next is too."""
    parts = F.filter(F.coalesce(parts, F.array().cast(PART)), lambda p: p.isNotNull())

    def visit(state: Column, p: Column) -> Column:
        place = F.lit(None).cast("string")
        for kind, shown in PLACES.items():
            place = F.when(p["type"] == kind, F.lit(shown)).otherwise(place)
        body = F.when(place.isNull(), state["body"]).otherwise(F.concat(state["body"], escape(state["run"]), place))
        run = F.when(place.isNull(), F.concat(state["run"], F.coalesce(p["text"], F.lit("")))).otherwise(F.lit(""))
        return F.struct(body.alias("body"), run.alias("run"))

    def expanded(p: Column) -> Column:
        out = F.lit(0).cast("long")
        for kind, (each, fixed) in EXPANDS.items():
            out = F.when(p["type"] == kind, (F.ceil(F.coalesce(p["units"], F.lit(1.0)) * each) + fixed).cast("long")).otherwise(out)
        return out

    others = F.filter(parts, lambda p: p["type"].isin(*PLACES))
    return F.struct(
        F.aggregate(parts, F.struct(F.lit("").alias("body"), F.lit("").alias("run")), visit, lambda s: F.concat(s["body"], escape(s["run"]))).alias("body"),
        F.transform(others, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens"))).alias("attachments"),
    )


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: `formatted`, `mask` (start and length in characters of the bodies to learn from),
    `attachments` (turn position, type, ref, tokens, in the order of their placeholders) and `extra_tokens`."""
    flat = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), flatten_parts(F.col(parts)).alias("_flat"))
    flat = flat.select("_conv", "_turn", "_role", "_flat.body", "_flat.attachments", F.concat(F.lit(HEAD), escape(F.col("_role")), F.lit(BODY)).alias("_head"))
    flat = flat.withColumn("_text", F.concat("_head", "body", F.lit(END)))
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "body")
    flat = flat.withColumns({"_seq": F.row_number().over(order), "_stop": F.sum(F.length("_text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.lit(len(BOS)) + F.col("_stop") - F.length("body") - len(END)
    row = F.struct("_seq", "_text", F.col("_role").isin(*learn_from).alias("_learn"), start.alias("start"), F.length("body").alias("length"), "attachments")
    grouped = flat.groupBy("_conv").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return grouped.select(
        F.col("_conv").alias(conv),
        F.concat(F.lit(BOS), F.array_join(F.transform("_rows", lambda r: r["_text"]), "")).alias("formatted"),
        F.transform(F.filter("_rows", lambda r: r["_learn"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"))).alias("mask"),
        F.flatten(F.transform("_rows", lambda r: F.transform(r["attachments"], lambda a: F.struct(r["_seq"].alias("seq"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("extra_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_chats(chats: DataFrame) -> DataFrame:
    """The output read back: `turns` (role and text of each turn, placeholders kept) and `learned` (text under the mask)."""
    turns = F.split(F.substring(F.col("formatted"), F.lit(len(BOS) + 1), F.length("formatted")), END)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def turn(t: Column) -> Column:
        two = F.split(t, r"\[/INST\]", 2)
        head = F.element_at(two, 1)
        return F.struct(unescape(F.substring(head, F.lit(len(HEAD) + 1), F.length(head))).alias("role"), unescape(F.element_at(two, 2)).alias("text"))

    learned = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"])))
    return chats.withColumns({"turns": F.transform(turns, turn), "learned": F.array_join(learned, "")})


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    nothing = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), nothing.cast("string").alias("ref"), nothing.cast("double").alias("units")))
