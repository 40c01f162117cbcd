"""Chat formatting by multi-party perspective rotation. DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; the loss mask covers
the assistant's own turns. A system turn is nobody's perspective and stays a
system turn in all of them.

A rendering is a row per turn, with its place in the whole: a conversation of
any length, or one that holds a third of all rows, is never gathered into one
value or one task. Offsets inside the rendering come from sums over blocks of
turns, so they are exact without a window over the conversation.
:func:`whole_dialogues` joins the turns of the conversations that are known to
be short.

Null text is an empty turn and a null role the speaker ``unknown``; rows with a
null conv_id or turn have no place and are left out. Turns of one conversation
that share their number are ordered by role, then text; exact repeats are
turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, ASSISTANT, USER = "system", "assistant", "user"
#: Turn numbers to a block of the prefix sums.
BLOCK = 256


def safe(text: Column) -> Column:
    """The text with the frame's own marks broken up, so that a turn can't forge another."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1 |>")


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, speaker, content, block, ord: turns cleaned and ordered within their block."""
    picked = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("content")
    ).where("conv_id is not null and turn is not null")
    picked = picked.withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "speaker", "content")
    return picked.withColumn("ord", F.row_number().over(order))


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per (conversation, perspective, turn).

    Columns: conv_id, perspective, turn, position (from 0), chat_role, name,
    segment (the rendered turn), char_start, char_end (of the segment within the
    rendering), mask_start, mask_end (the trained span; equal where there is none).
    """
    turns = turns_of(conversations, conv, turn, role, text)
    speakers = turns.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(speakers, "conv_id")
    own = F.col("speaker") == F.col("perspective")
    chat_role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, ASSISTANT).otherwise(USER)
    head = F.concat(F.lit(OPEN), chat_role, F.when(chat_role == USER, F.concat(F.lit(" name="), safe(F.col("speaker")))).otherwise(""), F.lit("\n"))
    body = safe(F.col("content"))
    seen = seen.select(
        "conv_id", "perspective", "turn", "block", "ord", chat_role.alias("chat_role"), F.when(chat_role == USER, F.col("speaker")).alias("name"),
        F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.char_length(head).cast("long").alias("head_chars"), F.char_length(body).cast("long").alias("body_chars"),
    ).withColumn("chars", F.char_length("segment").cast("long"))
    # Prefix sums in two steps: within a block, and over the blocks' totals.
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    blocks = seen.groupBy("conv_id", "perspective", "block").agg(F.sum("chars").alias("block_chars"), F.count("*").alias("block_turns"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "conv_id", "perspective", "block", F.coalesce(F.sum("block_chars").over(before), zero).alias("chars_before"), F.coalesce(F.sum("block_turns").over(before), zero).alias("turns_before")
    )
    placed = seen.withColumn("chars_inside", F.coalesce(F.sum("chars").over(inside), zero)).join(blocks, ["conv_id", "perspective", "block"])
    start = F.col("chars_before") + F.col("chars_inside")
    mask = start + F.col("head_chars")
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("turns_before") + F.col("ord") - 1).alias("position"),
        "chat_role",
        "name",
        "segment",
        start.alias("char_start"),
        (start + F.col("chars")).alias("char_end"),
        mask.alias("mask_start"),
        F.when(F.col("chat_role") == ASSISTANT, mask + F.col("body_chars") + len(CLOSE) - 1).otherwise(mask).alias("mask_end"),
    )


def whole_dialogues(rotated: DataFrame, max_turns: int) -> DataFrame:
    """(conv_id, perspective, rendering, mask_spans) of the conversations with at most ``max_turns`` turns.

    Longer ones keep the row-per-turn form; which those are is for the caller to say.
    """
    short = rotated.groupBy("conv_id", "perspective").agg(F.count("*").alias("n")).where(F.col("n") <= max_turns).select("conv_id", "perspective")
    turns = F.array_sort(F.collect_list(F.struct("position", "segment", "chat_role", "mask_start", "mask_end")))
    joined = rotated.join(short, ["conv_id", "perspective"], "left_semi").groupBy("conv_id", "perspective").agg(turns.alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["chat_role"] == ASSISTANT), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return joined.select("conv_id", "perspective", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("rendering"), spans.alias("mask_spans"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (
  SELECT t.*, p.perspective,
    CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN '{ASSISTANT}' ELSE '{USER}' END AS chat_role,
    regexp_replace(content, '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') AS body
  FROM t JOIN p ON t.conv_id = p.conv_id
), h AS (
  SELECT *, '{OPEN}' || chat_role || CASE WHEN chat_role = '{USER}' THEN ' name=' || regexp_replace(speaker, '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') ELSE '' END || chr(10) AS head FROM r
), s AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS segment,
    row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, content) - 1 AS position FROM h
), c AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM s
)
SELECT conv_id, perspective, turn, position::BIGINT AS position, chat_role, CASE WHEN chat_role = '{USER}' THEN speaker END AS name, segment,
  char_start, (char_start + length(segment))::BIGINT AS char_end, (char_start + length(head))::BIGINT AS mask_start,
  (char_start + length(head) + CASE WHEN chat_role = '{ASSISTANT}' THEN length(body) + {len(CLOSE) - 1} ELSE 0 END)::BIGINT AS mask_end
FROM c
"""
