"""Chat formatting of typed content parts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: What ``parts`` holds; units: image patches, audio seconds or document pages, as the kind has it.
PART = "struct<kind string, text string, ref string, units double>"

#: An attachment met in a turn's body: its placeholder's place and the tokens that it expands to.
HELD = "struct<kind string, ref string, at bigint, tokens bigint>"

#: The template. Control strings begin with # or <, which are never left bare in a text or a role.
HEAD, COLON, END = "### ", ": ", "</turn>\n"

#: Tokens that one unit of an attachment stands for once its placeholder is expanded.
TOKENS_PER_UNIT = {"image": 1.0, "audio": 25.0, "document": 512.0}

#: Fixed order: the mark first, so that no later step sees its own output.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    """Text without bare control characters; roles also lose their colons."""
    for bare, coded in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(bare), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    for bare, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(bare))
    return text


def text_part(text: Column) -> Column:
    """A turn's parts where it has one text and no attachment."""
    none = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("double").alias("units")
    ))


def _visit(part: Column) -> Column:
    """What stands in the body for a part: escaped text, or the placeholder of an attachment."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    text = escape(F.coalesce(part["text"], F.lit("")))
    return F.when(kind == "text", text).otherwise(F.concat(F.lit("<|"), escape(kind), F.lit("|>")))


def format_chat(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    loss_roles: Sequence[str] = ("assistant",),
    tokens_per_unit: Mapping[str, float] = TOKENS_PER_UNIT,
) -> DataFrame:
    """One row per conversation, its turns in the order of (turn, role, body).

    ``parts`` is an array of PART. A visitor flattens it: text is escaped, an image, audio or document (or any other
    kind) becomes the placeholder ``<|kind|>``. Returns the conversation's id, ``n_turns``, ``formatted``, ``turns``
    (role, start, length of each turn in code points), ``loss_spans`` (turn, start, end: the bodies of turns whose role
    is one of ``loss_roles``), ``attachments`` (turn, kind, ref, start of the placeholder, tokens it expands to: its
    units times the kind's tokens, rounded up, 0 for a kind without a rate or without units) and ``expanded_tokens``.

    Null parts, texts and roles count as empty, null turns come first, rows with a null conversation form one. Equal
    rows are turns of their own. An empty table gives an empty result; other columns are not carried. One conversation
    is one value of the result, so its rows meet in one task; the work there is linear in its size (and square only in the
    attachments of a single turn).
    """
    rate = F.create_map(*[F.lit(x) for pair in tokens_per_unit.items() for x in pair])
    flat = rows.select(
        F.col(conv).alias("__conv"),
        F.col(turn).alias("__turn"),
        F.coalesce(F.col(role), F.lit("")).alias("__role"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("__parts"),
    ).withColumn("__drawn", F.transform("__parts", _visit))
    visited = F.zip_with("__parts", "__drawn", lambda p, drawn: F.struct(
        F.coalesce(p["kind"], F.lit("text")).alias("kind"), p["ref"].alias("ref"), F.length(drawn).cast("long").alias("size"),
        F.coalesce(F.ceil(p["units"] * F.try_element_at(rate, p["kind"])), F.lit(0)).cast("long").alias("tokens"),
    ))
    # one walk over the parts, which keeps the place reached and the attachments met
    walked = F.aggregate(
        visited, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{HELD}>").alias("held")),
        lambda s, v: F.struct(
            (s["at"] + v["size"]).alias("at"),
            F.when(v["kind"] == "text", s["held"]).otherwise(
                F.concat(s["held"], F.array(F.struct(v["kind"].alias("kind"), v["ref"].alias("ref"), s["at"].alias("at"), v["tokens"].alias("tokens"))))
            ).alias("held"),
        ),
    )
    flat = flat.select(
        "__conv", "__turn", "__role",
        F.array_join("__drawn", "").alias("__body"),
        walked["held"].alias("__held"),
        F.concat(F.lit(HEAD), escape(F.col("__role"), role=True), F.lit(COLON)).alias("__head"),
    ).withColumn("__drawn", F.concat("__head", "__body", F.lit(END)))
    order = Window.partitionBy("__conv").orderBy("__turn", "__role", "__body")
    start = F.sum(F.length("__drawn")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = flat.withColumns({
        "__index": F.row_number().over(order) - 1, "__start": F.coalesce(start, F.lit(0)).cast("long")
    })
    body_at = F.col("__start") + F.length("__head")
    whole = placed.groupBy("__conv").agg(F.sort_array(F.collect_list(F.struct(
        F.col("__index").alias("index"),
        "__drawn",
        F.struct(F.col("__role").alias("role"), F.col("__start").alias("start"), F.length("__drawn").cast("long").alias("length")).alias("turn"),
        F.struct(F.col("__index").alias("turn"), body_at.alias("start"), (body_at + F.length("__body")).alias("end")).alias("loss"),
        F.col("__role").isin(*loss_roles).alias("scored"),
        F.transform("__held", lambda a: F.struct(
            F.col("__index").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"),
            (body_at + a["at"]).alias("start"), a["tokens"].alias("tokens"),
        )).alias("held"),
    ))).alias("t"))
    held = F.flatten("t.held")
    return whole.select(
        F.col("__conv").alias(conv),
        F.size("t").cast("long").alias("n_turns"),
        F.array_join("t.__drawn", "").alias("formatted"),
        F.col("t.turn").alias("turns"),
        F.transform(F.filter("t", lambda x: x["scored"]), lambda x: x["loss"]).alias("loss_spans"),
        held.alias("attachments"),
        F.aggregate(held, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``read_turns`` (role and text of each turn, parsed from ``formatted`` alone) and ``read_loss`` (the text
    under each loss span). Placeholders of attachments stay in the texts as they are drawn.

    Spans are places in ``formatted``. Its own pieces must begin where ``turns`` says, each right behind the one before, or
    reading fails; so a span is read from the piece that holds it, without a walk from the text's start for each.
    """
    pieces = F.split("formatted", END)
    with_pieces = formatted.withColumn("__pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    as_long = F.zip_with("__pieces", "turns", lambda p, t: F.coalesce(F.length(p) + len(END) == t["length"], F.lit(False)))
    behind = F.zip_with(F.slice("turns", F.lit(2), F.size("turns")), F.slice("turns", F.lit(1), F.greatest(F.size("turns") - 1, F.lit(0))), lambda b, a: b["start"] == a["start"] + a["length"])
    from_start = F.coalesce(F.try_element_at("turns", F.lit(1))["start"] == 0, F.lit(True))
    fits = F.forall(as_long, lambda x: x) & F.forall(behind, lambda x: x) & from_start
    checked = F.when(fits, F.col("__pieces")).otherwise(F.raise_error(F.lit("the turns' places don't fit the formatted text")))
    with_pieces = with_pieces.withColumn("__pieces", checked)

    def parse(piece: Column) -> Column:
        after = F.substr(piece, F.lit(len(HEAD) + 1))
        at = F.instr(after, COLON)
        return F.struct(
            unescape(F.substr(after, F.lit(1), at - 1)).alias("role"),
            unescape(F.substr(after, at + len(COLON))).alias("text"),
        )

    def under(span: Column) -> Column:
        first = span["start"] - F.element_at("turns", (span["turn"] + 1).cast("int"))["start"]
        piece = F.element_at("__pieces", (span["turn"] + 1).cast("int"))
        return unescape(F.substr(piece, (first + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    return with_pieces.withColumns({
        "read_turns": F.transform("__pieces", parse), "read_loss": F.transform("loss_spans", under)
    }).drop("__pieces")


#: The conversation that the query adds.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted, with digests of what is read back."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(PROBE_ID).alias("conv_id"), F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(PROBE_TEXT).alias("text"))
        for i, r in enumerate(("user", "assistant"))
    ])).alias("x")).select("x.*")
    parts = rows.unionByName(probe).withColumn("parts", text_part(F.col("text")))
    loss = F.array_join("read_loss", "")
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(format_chat(parts)).select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), coded AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') AS head
  FROM rows
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, body), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""
