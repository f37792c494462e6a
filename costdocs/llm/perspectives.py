"""Operator 8: every participant's view of a multi-party dialogue, with that speaker as assistant.

For each conversation and each of its participants, all messages are rendered in order: the
participant's own as assistant turns, which are trained on, system messages as they are, and all
others as user turns under their speaker's name. A view is a run of segments, one per message, with
their place in the whole text and the spans of it that the loss covers; :func:`dialogues` puts
segments together. Places are running sums that are taken within ranges of the sorted rows first
and over the ranges then, so a conversation of any length is spread over many tasks.

Cases: a null text is an empty message; a null conversation is one of its own; a null or blank
speaker is called ``unknown``; system messages are nobody's view, so a conversation of system
messages only has no rows. Messages come by turn, null last, then speaker and a hash of the
text; equal rows are repeated messages, each rendered. Angle brackets with bars in texts and names are broken up, so a
text cannot end its turn. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costdocs.llm.common import null_safe, staged

UNKNOWN, SYSTEM = "unknown", "system"
BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
SEGMENTS = 256  # messages in a part of a rendered dialogue


def _harmless(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def messages(conversations: DataFrame) -> DataFrame:
    """(conv, turn, speaker, text) without nulls but for the turn and the conversation."""
    speaker = F.trim(F.coalesce(F.col("role").cast("string"), F.lit("")))
    return conversations.select(
        F.col("conv_id").alias("conv"), "turn", F.when(speaker == "", UNKNOWN).otherwise(speaker).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def views(conversations: DataFrame) -> DataFrame:
    """One row per conversation, perspective and message.

    (conv_id, perspective, position, turn, speaker, role, segment, char_start, char_end, loss_start,
    loss_end): ``segment`` is the rendered message, which fills characters char_start to char_end
    of the view, and the loss covers loss_start to loss_end, both null where nothing is trained on.
    """
    rows = messages(conversations)
    people = staged(rows.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("_conv"), F.col("speaker").alias("perspective")).distinct(), "participants")
    order = [F.col("conv"), F.col("turn").isNull(), F.col("turn"), F.col("speaker"), F.xxhash64("text"), F.col("nth")]
    sorted_rows = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(sorted_rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "messages")
    # These tables grow with the conversations, and their file sizes say little: neither is broadcast.
    seen = ranged.join(people.hint("merge"), null_safe(ranged, people, {"conv": "_conv"})).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(role == "user", F.concat(F.lit(" name="), _harmless(F.col("speaker")))).otherwise("")
    head, body = F.concat(F.lit(BEGIN), role, name, F.lit(MIDDLE)), _harmless(F.col("text"))
    seen = staged(
        seen.select("conv", "perspective", "turn", "speaker", role.alias("role"), F.concat(head, body, F.lit(END)).alias("segment"),
                    F.length(head).alias("head"), F.when(own, F.length(body) + len(END.rstrip())).alias("loss"), "part", "at"),
        "views",
    ).withColumn("length", F.length("segment").cast("long"))
    view, places = ["conv", "perspective"], [*[F.col(c) for c in ("conv", "perspective", "part")]]
    sums = seen.groupBy(*view, "part").agg(F.sum("length").alias("chars"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*view).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    bases = staged(sums.select(F.col("conv").alias("_conv"), F.col("perspective").alias("_perspective"), F.col("part").alias("_part"),
                               F.coalesce(F.sum("chars").over(earlier), zero).alias("chars_before"), F.coalesce(F.sum("n").over(earlier), zero).alias("n_before")), "view-bases")
    inside = Window.partitionBy(*places).orderBy("at")
    placed = seen.withColumn("upto", F.sum("length").over(inside)).withColumn("number", F.row_number().over(inside))
    joined = placed.join(bases.hint("merge"), null_safe(placed, bases, {"conv": "_conv", "perspective": "_perspective", "part": "_part"}))
    start = F.col("chars_before") + F.col("upto") - F.col("length")
    loss = start + F.col("head")
    return joined.select(
        F.col("conv").alias("conv_id"), "perspective", (F.col("n_before") + F.col("number") - 1).alias("position"), "turn", "speaker", "role", "segment",
        start.alias("char_start"), (start + F.col("length")).alias("char_end"),
        F.when(F.col("loss").isNotNull(), loss).alias("loss_start"), (loss + F.col("loss")).alias("loss_end"),
    )


def dialogues(segments: DataFrame, per_part: int = SEGMENTS) -> DataFrame:
    """(conv_id, perspective, part, char_start, text, loss_spans): views in parts of bounded length."""
    part = F.floor(F.col("position") / per_part).alias("part")
    piece = F.struct("position", "segment", "char_start", "loss_start", "loss_end")
    grouped = segments.groupBy("conv_id", "perspective", part).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["loss_start"].isNotNull()), lambda p: F.struct(p["loss_start"].alias("start"), p["loss_end"].alias("end")))
    return grouped.select("conv_id", "perspective", "part", F.col("pieces")[0]["char_start"].alias("char_start"), F.array_join("pieces.segment", "").alias("text"), spans.alias("loss_spans"))


ORACLE = """
WITH m AS (SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
s AS (SELECT m.conv_id, perspective, turn, speaker,
 CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
 replace(replace(text, '<|', '< |'), '|>', '| >') AS body, replace(replace(speaker, '<|', '< |'), '|>', '| >') AS name
 FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || '|>' || chr(10) AS head FROM s),
t AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w AS BIGINT) AS char_end FROM t
 WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, speaker, role, segment, char_end - length(segment) AS char_start, char_end,
 CASE WHEN role = 'assistant' THEN char_end - length(segment) + length(head) END AS loss_start,
 CASE WHEN role = 'assistant' THEN char_end - length(segment) + length(head) + length(body) + 7 END AS loss_end
FROM o
"""
