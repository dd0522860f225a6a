"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns the parts of a message (text, image, audio, document) into pieces in order: text is escaped, any other part becomes a
placeholder, with its reference and expanded token count recorded. Control strings start with `<`, which no escaped text holds, so the
output can be read back whatever the texts say.

    <turn ROLE>\\n TEXT and <image 1> placeholders </turn>\\n
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
END = "</turn>\n"
# tokens a part expands to
TEXT_BYTES_PER_TOKEN, IMAGE_TILE, AUDIO_PER_SECOND, DOCUMENT_PER_PAGE = 4, 28, 25, 512


def escape(text: Column) -> Column:
    """`\\` becomes `\\b`, `<` becomes `\\l`; null is empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def text_part(text: Column) -> Column:
    """A message of one text as parts."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    ))


def _tokens(p: Column) -> Column:
    def at_least_0(x: Column) -> Column:
        return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))

    tiles = F.ceil(at_least_0(p["width"]) / IMAGE_TILE) * F.ceil(at_least_0(p["height"]) / IMAGE_TILE)
    return (
        F.when(p["kind"] == "text", F.ceil(F.octet_length(F.coalesce(p["text"], F.lit(""))) / TEXT_BYTES_PER_TOKEN))
        .when(p["kind"] == "image", tiles)
        .when(p["kind"] == "audio", F.ceil(at_least_0(p["seconds"]) * AUDIO_PER_SECOND))
        .when(p["kind"] == "document", at_least_0(p["pages"]) * DOCUMENT_PER_PAGE)
        .otherwise(0).cast("long")
    )


def _visit(p: Column, i: Column) -> Column:
    """One part: its piece of the output, whether it is text, its reference and tokens. Unknown kinds become placeholders too."""
    is_text = F.coalesce(p["kind"], F.lit("")) == "text"
    mark = F.concat(F.lit("<"), _escape_role(F.coalesce(p["kind"], F.lit("unknown"))), F.lit(" "), (i + 1).cast("string"), F.lit(">"))
    return F.struct(F.when(is_text, escape(p["text"])).otherwise(mark).alias("piece"), is_text.alias("is_text"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"), (i + 1).alias("part"))


def format_chats(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """messages(conv_id, turn, role, parts) to one row per conversation: formatted, segments, attachments, n_tokens.

    Order: turn, then role and parts for equal turns; null turns first; repeated rows stay. segments are the pieces of `formatted` in
    order with their loss flag: the texts of the trained role. Null parts: an empty message. A null conv_id is a conversation.
    """
    visited = F.transform(F.coalesce("parts", F.from_json(F.lit("[]"), f"array<{PART}>")), _visit)
    ordered = messages.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), visited.alias("parts")).alias("m"))
    chats = ordered.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))

    def pieces(m: Column) -> Column:
        loud = m["role"] == trained
        head = F.array(F.struct(F.concat(F.lit("<turn "), _escape_role(m["role"]), F.lit(">\n")).alias("text"), F.lit(False).alias("loss")))
        body = F.transform(m["parts"], lambda p: F.struct(p["piece"].alias("text"), (loud & p["is_text"]).alias("loss")))
        return F.concat(head, body, F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))

    def attached(m: Column) -> Column:
        others = F.filter(m["parts"], lambda p: ~p["is_text"])
        return F.transform(others, lambda p: F.struct(m["turn"].alias("turn"), p["part"].alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))

    out = chats.select(
        "conv_id",
        F.flatten(F.transform("ms", pieces)).alias("segments"),
        F.flatten(F.transform("ms", attached)).alias("attachments"),
        F.aggregate(F.flatten(F.transform("ms", lambda m: F.transform(m["parts"], lambda p: p["tokens"]))), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"),
    )
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text). Placeholders stay in the text as they are."""
    def turn(x: Column) -> Column:
        at = F.instr(x, ">\n")
        return F.struct(_unescape_role(F.substring(x, F.lit(7), at - 7)).alias("role"), unescape(F.substring(x, at + 2, F.length(x))).alias("text"))

    whole = F.split(formatted, END, -1)
    return F.transform(F.slice(whole, F.lit(1), F.size(whole) - 1), turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
