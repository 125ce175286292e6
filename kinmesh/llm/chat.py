"""Chat formatting: typed content parts flattened into one training string with a loss mask.

DataFrame expressions only. A message's content is an array of typed parts. The visitor
:func:`flatten_parts` turns each part into text: a text part is escaped, an image, audio
or document part becomes a run of placeholder marks, one run for each part and in order,
and its reference and the tokens that it expands to are recorded.

Template, for each message in turn order::

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Control strings inside texts are escaped reversibly: ``<`` and any backslashes followed by
``|`` gain one backslash, so an escaped text holds no ``<|`` and unescaping removes one
again. In roles, backslashes and line feeds are escaped as well, as the role is a line.

Defined results: a null text or role is empty; null parts are skipped; a part of unknown
type counts as text; a null turn sorts first and equal turns sort by role, then content;
rows with a null conversation id form one conversation; an empty table gives no rows.
Columns beside the four named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.session import read_table

START, END = "<|im_start|>", "<|im_end|>"
#: Placeholder marks by part type, and tokens for each unit (tile, second, page) of it.
PLACEHOLDERS = {"image": ("<|image|>", 256), "audio": ("<|audio|>", 25), "document": ("<|document|>", 512)}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    doubled = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(doubled, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def text_parts(text: Column) -> Column:
    """A plain text as an array of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))
    return F.array(part)


def flatten_parts(parts: Column) -> Column:
    """Visit the typed parts of a message in order.

    Returns a struct: ``content`` (escaped text with placeholders), ``attachments`` (array of
    type, ref, tokens) and ``attachment_tokens``, the count after expansion. The placeholder
    of a part with n units stands once; its expansion is n times the tokens of a unit, at
    least one unit.
    """

    def tokens(p: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for kind, (_, each) in PLACEHOLDERS.items():
            out = F.when(p["type"] == kind, F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1)) * F.lit(each)).otherwise(out)
        return out

    def shown(p: Column) -> Column:
        out = escape(F.coalesce(p["text"], F.lit("")))
        for kind, (mark, _) in PLACEHOLDERS.items():
            out = F.when(p["type"] == kind, F.lit(mark)).otherwise(out)
        return out

    held = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    attached = F.transform(
        F.filter(held, lambda p: F.coalesce(p["type"], F.lit("text")).isin(*PLACEHOLDERS)),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")),
    )
    return F.struct(
        F.array_join(F.transform(held, shown), "").alias("content"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def running_starts(sizes: Column, block: int = 256) -> Column:
    """For each entry the sum of those before it: sums within blocks, then over the blocks before."""

    def prefix(xs: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)
    cuts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(block))
    blocks = F.transform(cuts, lambda i: F.slice(sizes, i, block))
    bases = prefix(F.transform(blocks, total))
    return F.flatten(F.zip_with(blocks, bases, lambda xs, base: F.transform(prefix(xs), lambda x: x + base)))


def format_chats(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: id, ``formatted`` and its side columns.

    ``loss_spans`` are the code-point spans (start, end exclusive) of assistant contents in
    ``formatted``; ``attachments`` keep the order of their placeholders. The turns of one
    conversation meet in one group, since they make one string; partial lists are joined
    after the shuffle.
    """
    row = messages.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        flatten_parts(F.col(parts)).alias("flat"),
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    row = row.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            F.col("flat.content").alias("content"),
            head.alias("head"),
            (F.length(head) + F.length("flat.content") + len(END) + 1).alias("chars"),
            F.col("flat.attachments").alias("attachments"),
            F.col("flat.attachment_tokens").alias("attachment_tokens"),
        ).alias("m"),
    )
    chat = row.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms")).withColumn("starts", running_starts(F.transform("ms", lambda m: m["chars"].cast("bigint"))))
    # where each turn begins: running sums of lengths, taken over blocks of turns so that long chats stay near linear
    loss = F.filter(F.transform("ms", lambda m, k: F.struct(m.alias("m"), (F.col("starts")[k] + F.length(m["head"])).alias("at"))), lambda e: e["m"]["role"] == "assistant")
    spans = F.transform(loss, lambda e: F.struct(e["at"].alias("start"), (e["at"] + F.length(e["m"]["content"])).alias("end")))

    return chat.select(
        "conv_id",
        F.size("ms").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["content"], F.lit(END + "\n"))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("ms", lambda m: m["attachments"])).alias("attachments"),
        F.aggregate("ms", F.lit(0).cast("bigint"), lambda s, m: s + m["attachment_tokens"]).alias("attachment_tokens"),
    )


def parse_chats(formatted: Column) -> Column:
    """Read a formatted string back: an array of (role, text), placeholders left as they stand."""
    messages = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda m: m != "")

    def read(m: Column) -> Column:
        line = F.instr(m, "\n")
        body = F.substr(m, line + 1, F.length(m) - line - F.lit(len(END) + 1))
        return F.struct(unescape_role(F.substr(m, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(messages, read)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted; every digest is read back from the output."""
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    chats = format_chats(rows.unionByName(extra).withColumn("parts", text_parts(F.col("text"))))
    read = chats.withColumn("back", parse_chats(F.col("formatted"))).withColumn("masked", masked_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 10 + 1) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
