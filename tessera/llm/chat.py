"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn's content is a list of parts (kind, text, ref, amount), kind text, image, audio or document. `visit` flattens the
parts in order: text is kept with its control strings escaped, any other part becomes a placeholder; its reference is
recorded with its place, kind and expanded token count. `format_turns` writes one text a conversation with its marks,
the spans under the loss mask (the assistant's text parts, in code points of the formatted text) and the attachments.
`read_back` recovers the turns from a formatted text alone.

Text parts that follow each other are one text, so that no control string comes together where they meet.

Escaping: a backslash is doubled, then a backslash goes into each control string after its first character. Texts thus
never hold a control string, and `unescape` undoes it.

Defined results: a null text or part list is empty, a null role is the empty role; a part of unknown kind counts as a
document; equal turn numbers are ordered by role, then content; a conversation is whole in one row, since it is one
formatted text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<|turn|>", "<|says|>", "<|done|>"
#: No text holds one of these after escaping: this template's own beginnings and those of other common templates.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens of a placeholder: a fixed count, and so many by unit of its amount (megapixels, seconds, pages).
EXPANSION = {"image": (85, 765.0), "audio": (2, 12.5), "document": (4, 700.0)}
PART = "struct<kind:string,text:string,ref:string,amount:double>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for c in reversed(CONTROLS):
        text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The content of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def visit(parts: Column) -> Column:
    """The parts as array<struct<kind, piece, ref, tokens>>: escaped text, or a placeholder with its reference and expanded token count."""

    def one(p: Column) -> Column:
        kind = F.when(p["kind"].isin("text", *EXPANSION), p["kind"]).otherwise(F.lit("document"))
        tokens = F.lit(None).cast("long")
        for name, (fixed, by_unit) in EXPANSION.items():
            tokens = F.when(kind == name, F.lit(fixed) + F.ceil(F.coalesce(p["amount"], F.lit(0.0)) * by_unit)).otherwise(tokens)
        piece = F.when(kind == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))
        return F.struct(kind.alias("kind"), piece.alias("piece"), F.when(kind != "text", p["ref"]).alias("ref"), tokens.alias("tokens"))

    return F.transform(_joined(F.coalesce(parts, F.array().cast(f"array<{PART}>"))), one)


def _joined(parts: Column) -> Column:
    """The parts, each run of text parts as one."""

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        text = F.struct(p["kind"].alias("kind"), F.concat(F.coalesce(last["text"], F.lit("")), F.coalesce(p["text"], F.lit(""))).alias("text"), p["ref"].alias("ref"), p["amount"].alias("amount"))
        goes_on = (F.size(done) > 0) & F.coalesce((last["kind"] == "text") & (p["kind"] == "text"), F.lit(False))
        return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(text))).otherwise(F.concat(done, F.array(p)))

    return F.when(F.size(parts) < 2, parts).otherwise(F.aggregate(parts, F.array().cast(f"array<{PART}>"), add))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content", loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_spans, attachments, expanded_tokens) by conversation.

    loss_spans: for each turn an array of (start, length, in_line), in code points from the formatted text's start and
    from the line's start. attachments: an array of (turn, kind, ref, tokens, at) in order.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), visit(F.col(content_col)).alias("parts"))
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(MIDDLE))
    body = F.array_join(F.transform("parts", lambda p: p["piece"]), "")
    rows = rows.select("conv", "turn", "role", "parts", head.alias("head"), F.concat(head, body, F.lit(END)).alias("line"))
    rows = rows.withColumn("chars", F.length("line"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "line")
    rows = rows.withColumn("at", F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")).withColumn("number", F.row_number().over(order))
    # Where each part of a turn begins; a turn has few parts, so that summing the ones ahead of each is cheap.
    ahead = F.transform("parts", lambda p, k: F.aggregate(F.slice("parts", F.lit(1), k), F.lit(0).cast("long"), lambda s, q: s + F.length(q["piece"])))
    placed = F.zip_with("parts", ahead, lambda p, s: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), (F.col("at") + s).alias("at"), F.length(p["piece"]).cast("long").alias("length")))
    rows = rows.withColumn("placed", placed)
    # Within a line without its BEGIN, as `lines` cuts them.
    in_line = F.col("at") - F.length("head") + F.lit(len(BEGIN))
    spans = F.when(F.col("role") == loss_role, F.transform(F.filter("placed", lambda p: p["kind"] == "text"), lambda p: F.struct(p["at"].alias("start"), p["length"].alias("length"), (p["at"] - in_line).alias("in_line")))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint,in_line:bigint>>"))
    held = F.transform(F.filter("placed", lambda p: p["kind"] != "text"), lambda p: F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), p["at"].alias("at")))
    rows = rows.select("conv", F.struct("number", "line", spans.alias("spans"), held.alias("held")).alias("row"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda r: r["held"]))
    return whole.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("formatted"),
        F.transform("rows", lambda r: r["spans"]).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, body>>, the role unescaped, the body as it stands."""

    def one(line: Column) -> Column:
        at = F.instr(line, MIDDLE)
        role, body = F.substr(line, F.lit(1), at - 1), F.substr(line, at + len(MIDDLE))
        return F.struct(unescape(role).alias("role"), F.substr(body, F.lit(1), F.length(body) - len(END)).alias("body"))

    return F.transform(lines(formatted), one)


def lines(formatted: Column) -> Column:
    """The lines of a formatted text, one a turn, each without its BEGIN."""
    return F.filter(F.split(formatted, BEGIN.replace("|", r"\|")), lambda x: x != "")


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the mask, unescaped. Each span is cut out of its own line: from the whole text it would cost a reading of all of it."""
    cut = F.zip_with(lines(formatted), spans, lambda line, own: F.transform(own, lambda s: unescape(F.substr(line, (s["in_line"] + 1).cast("int"), s["length"].cast("int")))))
    return F.array_join(F.flatten(cut), "")
