"""Chat formatting with the perspective rotated over all participants.

Every participant of a conversation is once the assistant: their turns are the
targets, those of all others come as named users, system turns stay. The result
has a row for each turn and perspective, which readers concatenate in order of
turn, so that a conversation of any length is never held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks around a segment; the end mark of a target is a target too.
START, END = "<|im_start|>", "<|im_end|>\n"


def rotate_perspectives(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, role, name, segment, mask_start, mask_end, n_chars) of turns (conv_id, turn, role, text).

    perspective is the participant who is the assistant; role is system, assistant
    or user; segment is the rendered turn; the characters from mask_start to
    mask_end (exclusive, in code points of the segment) are targets, none if they
    are equal. Participants are the distinct roles of a conversation but system. A
    null text is rendered empty and has no target, an empty one has its end mark; a
    null role is a participant named unknown. Rows without conv_id or turn can't be
    placed and are left out. Rows with equal conversation and turn are each
    rendered, equal rows too. Marks in a text or a name are broken by a space, and
    line ends in a name are one, so that no text can end its segment. Extra columns
    are dropped.
    """
    broken = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    name = F.regexp_replace(broken(F.coalesce("role", F.lit("unknown"))), r"[\r\n]+", " ")
    turns = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", name.alias("name"), broken(F.col("text")).alias("text"))
    people = turns.where("name <> 'system'").select("conv_id", F.col("name").alias("perspective")).distinct()
    both = turns.join(people, "conv_id")
    own = F.col("name") == F.col("perspective")
    role = F.when(F.col("name") == "system", "system").when(own, "assistant").otherwise("user")
    head = F.concat(F.lit(START), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("name"))).otherwise(""), F.lit("\n"))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(END))
    begin = F.length(head)
    return both.select(
        "conv_id",
        "perspective",
        "turn",
        role.alias("role"),
        "name",
        F.concat(head, body).alias("segment"),
        begin.cast("long").alias("mask_start"),
        F.when(own & F.col("text").isNotNull(), begin + F.length(body)).otherwise(begin).cast("long").alias("mask_end"),
        (begin + F.length(body)).cast("long").alias("n_chars"),
    )


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\r\n]+', ' ', 'g') AS name, replace(text, '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT DISTINCT conv_id, name AS perspective FROM t WHERE name <> 'system'),
b AS (SELECT t.*, perspective, CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS as_role FROM t JOIN p USING (conv_id)),
h AS (SELECT *, '<|im_start|>' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head, coalesce(text, '') || '<|im_end|>' || chr(10) AS body FROM b)
SELECT conv_id, perspective, turn, as_role AS role, name, head || body AS segment, length(head) AS mask_start,
  CASE WHEN name = perspective AND text IS NOT NULL THEN length(head) + length(body) ELSE length(head) END AS mask_end, length(head) + length(body) AS n_chars FROM h
"""
